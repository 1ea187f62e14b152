"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.llm import bpe, divergence, lm, reassembly, reply_trees, secrets, token_counts, tokens, toxicity
from corpusweave.llm.ann import nearest
from corpusweave.llm.jaccard_join import jaccard_join
from corpusweave.llm.line_rules import BOILERPLATE, CLOSED, MOST_LOST, SEPARATORS, SYMBOLS, clean_lines
from corpusweave.llm.packing import pack
from corpusweave.llm.repeats import remove_repeats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE p.k >= 0.8 * (x.n + y.n - p.k)),
r(node, seen) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen)
SELECT d.doc_id, min(r.seen) AS class_id, any_value((SELECT count(*) FROM l WHERE l.a = d.doc_id)) AS n_links
FROM documents d JOIN r ON r.node = d.doc_id GROUP BY d.doc_id
""")
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


@query()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@query()
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query()
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, found in the flat token files that they are written to."""
    blocks, names = token_counts.write_token_blocks(table(spark, sf_dir, "documents"))
    end_id = max(tokens.vocabulary(tokens.default_path()).special.values())
    return token_counts.count_tokens(blocks, end_id, names).select("doc_id", "n_tokens")


@query()
def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


_LINE_CLOSED, _LINE_BOILERPLATE = CLOSED.replace("'", "''"), BOILERPLATE.replace("'", "''")


@query(f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
u AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, w || {" || ".join(f"' ' || lead(w, {k}) OVER o" for k in range(1, 8))} AS x FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM g WHERE x IS NOT NULL),
r AS (
  SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM h WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(ls) AS x FROM d),
c AS (
  SELECT doc_id, x, length(x) AS n, length(regexp_replace(x, '[A-Z]', '', 'g')) AS no_upper, length(regexp_replace(x, '[a-z]', '', 'g')) AS no_lower,
         length(x) - length(regexp_replace(x, '[{SEPARATORS}]', '', 'g')) AS seps, length(x) - length(regexp_replace(x, '[{SYMBOLS}]', '', 'g')) AS syms,
         regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS ws FROM l),
f AS (
  SELECT doc_id, sum(n) AS lost FROM c WHERE NOT regexp_matches(x, '{_LINE_CLOSED}') OR syms * 10 > n OR (seps >= 3 AND seps * 20 > n)
    OR (n - no_upper >= 10 AND n - no_upper > n - no_lower) OR (len(ws) >= 10 AND len(list_distinct(ws)) * 10 < len(ws)) OR regexp_matches(lower(x), '{_LINE_BOILERPLATE}')
  GROUP BY doc_id),
m AS (
  SELECT doc_id, t, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN f USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost <= {MOST_LOST} * length(t) AS kept
FROM m
""")
def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_spans(kind: int, pattern: str, value: int, keep: str) -> str:
    """Spans of a pattern in DuckDB, from the pieces between its matches."""
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {kind} AS kind, s AS "start", e AS "end" FROM (
    SELECT doc_id, list_sum(list_transform(gaps[:i], lambda g: length(g)))::BIGINT + coalesce(list_sum(list_transform(hits[:i - 1], lambda g: length(g))), 0)::BIGINT AS s,
           s + length(hits[i]) AS e, vals[i] AS v
    FROM (SELECT doc_id, hits, gaps, vals, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '{p}') AS hits, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', {value}) AS vals FROM d)))
  WHERE {keep}"""


def _sql_near(kinds: str) -> str:
    """Whether a part of some kinds lies fewer than SCOPE code points from the part c."""
    return f"""EXISTS (FROM p n WHERE n.doc_id = c.doc_id AND n.kind IN ({kinds}) AND n."start" < c."end" + {secrets.SCOPE} AND n."end" > c."start" - {secrets.SCOPE})"""


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS ({" UNION ALL ".join([
    _sql_spans(0, secrets.ASSIGN, 2, "length(v) >= 8"), _sql_spans(1, secrets.ACCESS, 0, "e - s >= 16"), _sql_spans(2, secrets.HEX, 0, "true"), _sql_spans(3, secrets.ASSIGN, 2, "length(v) < 8"),
    _sql_spans(3, secrets.WEAK_SECRET, 0, "true"), _sql_spans(4, secrets.WEAK_ID, 0, "true"), _sql_spans(5, secrets.WEAK_ENDPOINT, 0, "true")])}),
w AS (SELECT DISTINCT doc_id, kind, "start", "end" FROM p c
      WHERE kind >= 3 AND (kind = 4 OR {_sql_near("1, 4")}) AND (kind = 3 OR {_sql_near("0, 2, 3")})),
a AS (SELECT doc_id, kind, "start", "end" FROM p WHERE kind < 3 UNION ALL SELECT * FROM w),
k AS (SELECT *, concat(['assign', 'access', 'hex', 'weak_secret', 'weak_id', 'weak_endpoint'][kind + 1], ':', "start", ':', "end") AS x FROM a),
o AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
             coalesce(string_agg(x, ',' ORDER BY "start", kind, "end") FILTER (kind < 3), '') AS base, coalesce(string_agg(x, ',' ORDER BY "start", kind, "end"), '') AS spans FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o USING (doc_id)
""")
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return out.select("doc_id", *counts, F.sha2(secrets.digest(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"))


#: A conversation whose texts look like the template's control strings.
_LOOKALIKE = "\\### Assistant: </turn> ok"


@query(f"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_LOOKALIKE}' UNION ALL SELECT -7, 1, 'assistant', '{_LOOKALIKE}'),
e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
         regexp_replace(regexp_replace(text, '###(\\\\*) ', '###\\1\\\\ ', 'g'), '<(\\\\*)/turn>', '<\\1\\\\/turn>', 'g') AS esc FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(coalesce(role, ''), chr(10), text, chr(10)), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(esc) + length(coalesce(role, '')) + 14)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""")
def op7_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    extra = spark.createDataFrame([(-7, 0, "user", _LOOKALIKE), (-7, 1, "assistant", _LOOKALIKE)], "conv_id long, turn long, role string, text string")
    out = reply_trees.format_trees(reply_trees.chains(rows.unionByName(extra)))
    out = out.withColumn("turns", reply_trees.read_back(F.col("formatted"))).withColumn("learned", F.array_join(reply_trees.under_loss(F.col("formatted"), F.col("loss")), ""))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query()
def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query()
def op12_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reassembly.reassemble(reassembly.arrivals(table(spark, sf_dir, "conversations")), reassembly.BATCHES)
    what = F.when(F.col("event") == "close", F.array_join("unreleased", ",")).otherwise(F.col("payload"))
    return out.select("event", F.sha2(what.cast("binary"), 256).alias("sha256"), "conv_id", "turn", F.col("batch").cast("long").alias("batch"), "n_missing", "n_breaks")


@query()
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query()
def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))
