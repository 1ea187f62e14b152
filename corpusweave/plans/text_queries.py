"""Queries on single texts: ratios, contracts, repeats, diversity and similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusweave.functions import arrays, text
from corpusweave.plans.registry import query
from corpusweave.sources.tables import bounded_batches, dealt, spread, table

WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, dealt out over the cores where they come from few files, in bounded batches."""
    bounded_batches(spark)
    return spread(table(spark, sf_dir, "documents"))


def tokens(df: DataFrame, least: int = 1) -> DataFrame:
    """doc_id and the lower-case runs of a-z and digits."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    return df.select("doc_id", "lang", (F.filter(found, lambda t: F.char_length(t) >= least) if least > 1 else found).alias("t"))


@query("""
SELECT lang, count(*) AS n_docs, sum(length(text) - length(replace(text, ',', '')))::BIGINT AS n_commas,
       avg(1000.0 * (length(text) - length(replace(text, ',', ''))) / greatest(length(text), 1)) AS comma_per_1k_chars
FROM documents GROUP BY lang
""")
def doc_comma_summary_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = text.occurrences(F.col("text"), ",")
    return docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_commas"), F.avg(text.per_1k(n, F.col("text"))).alias("comma_per_1k_chars"))


@query("""
SELECT doc_id, length(regexp_replace(text, '[^a-z]', '', 'g')) / greatest(length(regexp_replace(text, '\\s', '', 'g')), 1) AS of_nonspace,
       length(regexp_replace(text, '[^a-z]', '', 'g')) / greatest(length(text), 1) AS of_all,
       length(regexp_replace(text, '[^a-z]', '', 'g')) / greatest(length(regexp_replace(text, '[^a-zA-Z]', '', 'g')), 1) AS of_letters,
       length(regexp_replace(text, '\\s', '', 'g')) AS compact_chars
FROM documents
""")
def char_ratio_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", *[text.class_ratio(t, "[a-z]", k).alias(f"of_{k}") for k in ("nonspace", "all", "letters")], text.compact_length(t).cast("long").alias("compact_chars"))


CONTRACT_TEXT = """
CASE turn % 6 WHEN 0 THEN '<result>' || text || '</result>' WHEN 1 THEN text WHEN 2 THEN '<result>' || text WHEN 3 THEN text || '</result>'
  WHEN 4 THEN '<result>' || text || '</result> and more' ELSE '<result><result>' || text || '</result>' END"""


CONTRACT_REASONS = f"""
t AS (SELECT conv_id, turn, trim({CONTRACT_TEXT}) AS t FROM conversations),
p AS (SELECT *, strpos(t, '<result>') AS o, strpos(t, '</result>') AS c, (length(t) - length(replace(t, '<result>', ''))) // 8 AS n_o, (length(t) - length(replace(t, '</result>', ''))) // 9 AS n_c FROM t),
q AS (SELECT conv_id, turn, CASE WHEN o = 0 AND c = 0 THEN 'missing_result_tags' WHEN o = 0 THEN 'missing_result_open' WHEN c = 0 THEN 'missing_result_close' WHEN n_o > 1 THEN 'multiple_result_open'
         WHEN n_c > 1 THEN 'multiple_result_close' WHEN trim(substr(t, c + 9)) <> '' THEN 'post_result_text' WHEN length(trim(substr(t, o + 8, c - o - 8))) < 40 THEN 'empty_or_short_result' ELSE 'ok' END AS reason FROM p)"""


@query(f"WITH {CONTRACT_REASONS} SELECT reason, count(*) AS n FROM q GROUP BY 1")
def result_contract_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select(F.expr(CONTRACT_TEXT).alias("t"))
    return t.select(F.coalesce(text.result_contract(F.col("t"))["reason"], F.lit("ok")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query()
def collapse_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(F.coalesce(text.collapse_reason(F.col("text")), F.lit("ok")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT doc_id, unnest(cs) AS ch, unnest(range(1, len(cs) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS cs FROM documents)),
g AS (SELECT doc_id, ch, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS g FROM c), r AS (SELECT doc_id, ch, count(*) AS n FROM g GROUP BY doc_id, ch, g)
SELECT doc_id, coalesce(max(n), 0) AS any_run, coalesce(max(n) FILTER (regexp_matches(ch, '[A-Za-z]')), 0) AS letter_run, coalesce(max(n) FILTER (regexp_matches(ch, '[0-9]')), 0) AS digit_run FROM documents LEFT JOIN r USING (doc_id) GROUP BY doc_id
""")
def longest_char_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", text.longest_run(t).alias("any_run"), text.longest_run(t, "[A-Za-z]").alias("letter_run"), text.longest_run(t, "[0-9]").alias("digit_run"))


@query(f"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n'), lambda x: trim(x)), lambda x: length(x) >= 12) AS ls, regexp_extract_all(text, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]') AS ts FROM documents),
u AS (SELECT doc_id, unnest(ts) AS w, unnest(range(1, len(ts) + 1)) AS i FROM l),
x AS (SELECT doc_id, w || {" || ".join(f"chr(1) || lead(w, {k}) OVER o" for k in range(1, 8))} AS x FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, 1.0::DOUBLE - count(DISTINCT x)::DOUBLE / count(*) AS r FROM x WHERE x IS NOT NULL GROUP BY doc_id)
SELECT doc_id, CASE WHEN len(ls) > 0 THEN 1.0::DOUBLE - len(list_distinct(ls))::DOUBLE / len(ls) ELSE 0 END AS line_rate, coalesce(r, 0) AS ngram_rate FROM l LEFT JOIN g USING (doc_id)
""")
def repeated_lines_and_8grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", text.repeated_line_rate(F.col("text")).alias("line_rate"), text.repeated_ngram_rate(F.col("text")).alias("ngram_rate"))


_TALLY = f"""
WITH t AS (SELECT doc_id, unnest({WORDS}) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY 1, 2)"""


@query(
    _TALLY
    + """,
r AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS lo, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS hi FROM c)
SELECT doc_id, 10000.0 * (sum(n * n) - sum(n)) / (sum(n) * sum(n))::DOUBLE AS yule_k, 2.0 * sum(n * lo) / (count(*) * sum(n)) - (count(*) + 1.0) / count(*) AS gini, sum(n * n) / (sum(n) * sum(n))::DOUBLE AS simpson,
       (sum(n) * sum(n))::DOUBLE / sum(n * n) / count(*) AS hill_d2_norm, -sum(n / t.total * ln(n / t.total)) AS entropy, sum(n) FILTER (hi <= 10) / sum(n)::DOUBLE AS top_10,
       coalesce(sum(n) FILTER (n > 1), 0) / sum(n)::DOUBLE AS repeat_rate, sum(n - 1) / sum(n)::DOUBLE AS repeat_mass
FROM r JOIN (SELECT doc_id, sum(n)::DOUBLE AS total FROM c GROUP BY 1) t USING (doc_id) GROUP BY doc_id
"""
)
def lexical_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = arrays.measures(F.col("t"), "yule_k", "gini", "simpson", "hill_d2_norm", "entropy", "top_10", "repeat_rate", "repeat_mass")
    return tokens(docs(spark, sf_dir)).where(F.size("t") > 0).select("doc_id", F.inline(F.array(m)))  # computed once, not once a field


@query(f"""
WITH u AS (SELECT doc_id, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, {WORDS} AS t FROM documents)),
x AS (SELECT doc_id, w || chr(1) || lead(w, 1) OVER o || chr(1) || lead(w, 2) OVER o AS x FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, x, count(*) AS n FROM x WHERE x IS NOT NULL GROUP BY 1, 2),
r AS (SELECT doc_id, count(*) / sum(n)::DOUBLE AS diversity, coalesce(sum(n) FILTER (n > 1), 0) / sum(n)::DOUBLE AS rate FROM c GROUP BY 1)
SELECT doc_id, coalesce(diversity, 0) AS diversity, coalesce(rate, 0) AS repeat_rate FROM documents LEFT JOIN r USING (doc_id)
""")
def ngram_repeats_and_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tokens(docs(spark, sf_dir)).select("doc_id", arrays.ngrams(F.col("t"), 3).alias("g"))
    return g.select("doc_id", arrays.diversity(F.col("g")).alias("diversity"), arrays.repeated_occurrence_rate(F.col("g")).alias("repeat_rate"))


@query(f"""
WITH t AS (SELECT doc_id, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS i, len(t) AS n FROM (SELECT doc_id, {WORDS} AS t FROM documents)),
l AS (SELECT doc_id, n, i - lag(i) OVER (PARTITION BY doc_id, w ORDER BY i) AS gap FROM t)
SELECT doc_id, coalesce(sum(exp(-gap / 20.0)), 0) / any_value(n) AS burst_mass FROM l GROUP BY doc_id
""")
def repeat_burst_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens(docs(spark, sf_dir)).select("doc_id", F.size("t").alias("n"), F.posexplode("t").alias("i", "w"))
    gap = F.col("i") - F.lag("i").over(Window.partitionBy("doc_id", "w").orderBy("i"))
    return t.withColumn("gap", gap).groupBy("doc_id").agg((F.coalesce(F.sum(F.exp(-F.col("gap") / 20.0)), F.lit(0.0)) / F.first("n")).alias("burst_mass"))


@query(f"""
WITH t AS (SELECT doc_id, {WORDS} AS t FROM documents),
w AS (SELECT doc_id, k, t[k:k + 199] AS w FROM (SELECT doc_id, t, unnest(CASE WHEN len(t) >= 200 THEN range(1, len(t) - 198, 100) WHEN len(t) >= 80 THEN [1] ELSE [] END) AS k FROM t)),
c AS (SELECT doc_id, k, x, count(*) AS n FROM (SELECT doc_id, k, unnest(w) AS x FROM w) GROUP BY 1, 2, 3),
s AS (SELECT doc_id, k, sum(n) FILTER (r <= 5) / sum(n)::DOUBLE AS share FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY n DESC) AS r FROM c) GROUP BY 1, 2)
SELECT doc_id, count(*) AS n_windows, avg(share) AS top_5_share FROM s GROUP BY doc_id
""")
def sliding_window_top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tokens(docs(spark, sf_dir)).select("doc_id", F.explode(arrays.windows(F.col("t"), 200, 100, 80)).alias("w"))
    return w.select("doc_id", arrays.coverage(F.col("w"), 5).alias("s")).groupBy("doc_id").agg(F.count("*").alias("n_windows"), F.avg("s").alias("top_5_share"))


#: Parts that the documents of one word are dealt out to when the benchmark is too large to broadcast.
SALTS = 16


def multiset_overlap(d: DataFrame, b: DataFrame, cut: float = 0.5, least: int = 2) -> DataFrame:
    """Multiset Jaccard and containment of the words of at least `least` characters, for the pairs
    of d(doc_id, text) and b(item_id, text) whose containment reaches `cut`. Rows of one key are one
    text. Only texts are shuffled, into parts of bounded size: a document's words and pairs stay in
    its part unless b must be joined by sorting, so what a task holds doesn't grow with d."""

    def whole(df: DataFrame, key: str, size: str) -> DataFrame:
        found = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.char_length(t) >= least)
        texts = dealt(df.select(key, "text"), key).groupBy(key).agg(F.array_join(F.collect_list("text"), " ").alias("text"))
        return texts.select(key, found.alias("t")).select(key, F.size("t").cast("long").alias(size), F.explode("t").alias("w"))

    x = whole(d, "doc_id", "dn").groupBy("doc_id", "dn", "w").agg(F.count("*").alias("n")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    y = whole(b, "item_id", "bn").groupBy("item_id", "bn", "w").agg(F.count("*").alias("m")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    o = x.join(y, ["w", "salt"]).groupBy("doc_id", "dn", "item_id", "bn").agg(F.sum(F.least("n", "m")).alias("k"))
    smaller = F.least("dn", "bn")
    return o.where(F.col("k") >= cut * smaller).select("doc_id", "item_id", (F.col("k") / (F.col("dn") + F.col("bn") - F.col("k"))).alias("jaccard"), (F.col("k") / smaller).alias("containment"))


@query("""
WITH d AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 2)) AS w FROM documents) GROUP BY 1, 2),
b AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 2)) AS w FROM benchmark) GROUP BY 1, 2),
dt AS (SELECT doc_id, sum(n) AS n FROM d GROUP BY 1), bt AS (SELECT item_id, sum(n) AS n FROM b GROUP BY 1),
o AS (SELECT doc_id, item_id, sum(least(d.n, b.n)) AS k FROM d JOIN b USING (w) GROUP BY 1, 2)
SELECT doc_id, item_id, k / (dt.n + bt.n - k)::DOUBLE AS jaccard, k / least(dt.n, bt.n)::DOUBLE AS containment
FROM o JOIN dt USING (doc_id) JOIN bt USING (item_id) WHERE k >= 0.5 * least(dt.n, bt.n)
""")
def multiset_overlap_all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("""
WITH c AS (SELECT lang, ch, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]')) AS ch FROM documents) GROUP BY 1, 2),
p AS (SELECT lang, ch, n / sum(n) OVER (PARTITION BY lang) AS p FROM c),
j AS (SELECT x.lang AS a, y.lang AS b, x.ch, x.p AS p, y.p AS q FROM p x JOIN p y ON x.ch = y.ch AND x.lang < y.lang)
SELECT l.a, l.b, sqrt(greatest(0, 0.5 * (l.pa + l.pb))) AS js_distance FROM (
  SELECT a.lang AS a, b.lang AS b,
         sum(CASE WHEN coalesce(x.p, 0) > 0 THEN x.p * log2(x.p / (0.5 * (x.p + coalesce(y.p, 0)))) ELSE 0 END) AS pa,
         sum(CASE WHEN coalesce(y.p, 0) > 0 THEN y.p * log2(y.p / (0.5 * (y.p + coalesce(x.p, 0)))) ELSE 0 END) AS pb
  FROM (SELECT DISTINCT lang FROM p) a JOIN (SELECT DISTINCT lang FROM p) b ON a.lang < b.lang CROSS JOIN (SELECT DISTINCT ch FROM p) k
  LEFT JOIN p x ON x.lang = a.lang AND x.ch = k.ch LEFT JOIN p y ON y.lang = b.lang AND y.ch = k.ch GROUP BY 1, 2) l
""")
def js_distance_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = docs(spark, sf_dir).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]"), F.lit(0))).alias("ch")).groupBy("lang", "ch").agg(F.count("*").alias("n"))
    # One row per language: its distribution, at most 26 entries long.
    p = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lang"))).groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("ch", "p"))).alias("m"))
    pairs = p.select(F.col("lang").alias("a"), F.col("m").alias("x")).join(p.select(F.col("lang").alias("b"), F.col("m").alias("y")), F.col("a") < F.col("b"))

    def part(key, own: str, other: str):
        v, w = F.coalesce(F.element_at(own, key), F.lit(0.0)), F.coalesce(F.element_at(other, key), F.lit(0.0))
        return F.when(v > 0, v * F.log2(v / (0.5 * (v + w)))).otherwise(0.0)

    total = F.aggregate(F.array_union(F.map_keys("x"), F.map_keys("y")), F.lit(0.0), lambda acc, k: acc + part(k, "x", "y") + part(k, "y", "x"))
    return pairs.select("a", "b", F.sqrt(F.greatest(F.lit(0.0), 0.5 * total)).alias("js_distance"))


@query("""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[.!?] '), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, len(s) AS n_sentences FROM s
""")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query("""
SELECT doc_id, CASE WHEN position('<turn|>' IN x) > 0 THEN '<turn|>' ELSE '' END AS hit, length(string_split(x, '<turn|>')[1]) AS kept_chars
FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text[:50] || '<turn|>' || text[51:] ELSE text END AS x FROM documents)
""")
def stop_text_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("doc_id") % 2 == 0, F.concat(F.substring("text", 1, 50), F.lit("<turn|>"), F.expr("substring(text, 51)"))).otherwise(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", text.stop_trimmed(x).alias("s")).select("doc_id", F.col("s.hit").alias("hit"), F.char_length("s.kept").cast("long").alias("kept_chars"))


@query("""
SELECT doc_id, length(regexp_replace(text, '[^éèàçßäöüñóúí]', '', 'g')) AS accented, length(regexp_replace(text, '[^(]', '', 'g')) AS opens,
       least(length(regexp_replace(text, '[^(（]', '', 'g')), length(regexp_replace(text, '[^)）]', '', 'g'))) AS pairs,
       length(regexp_replace(text, '[\\p{L}\\p{N}\\s.,!?;:()\\[\\]{}''"“”‘’…—·（），<>/-]', '', 'g')) / greatest(length(text), 1) AS symbol_noise
FROM documents
""")
def script_and_symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", text.count_of(t, "[éèàçßäöüñóúí]").cast("long").alias("accented"), text.count_of(t, "[(]").cast("long").alias("opens"), text.parenthesis_pairs(t).cast("long").alias("pairs"), text.symbol_noise(t).alias("symbol_noise"))


@query("""
SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_chars,
       len(regexp_extract_all(html, '<a[\\s>]')) AS n_links FROM pages
""")
def page_text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " "), r"\s+", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.char_length(F.trim(t)).cast("long").alias("text_chars"), text.count_of(F.col("html"), r"<a[\s>]").cast("long").alias("n_links"))
