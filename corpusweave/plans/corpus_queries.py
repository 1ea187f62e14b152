"""Queries that build corpora: dedupe, joins by position, samples, mixes, chat rows and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions import text
from corpusweave.operators import chat, rows
from corpusweave.plans.registry import query
from corpusweave.plans.text_queries import docs
from corpusweave.sources.tables import table

_PRINT = "substr(sha1(substr(regexp_replace(text, '\\s', '', 'g'), 1, 1800)), 1, 16)"


@query(f"SELECT min(doc_id) AS doc_id, {_PRINT} AS fp FROM documents GROUP BY 2")
def keep_first_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.keep_first_text(docs(spark, sf_dir), "doc_id").select("doc_id", text.fingerprint(F.col("text")).alias("fp"))


@query(f"""
WITH f AS (SELECT lang, {_PRINT} AS fp FROM documents), g AS (SELECT lang, fp, count(*) AS n FROM f GROUP BY 1, 2)
SELECT lang, sum(n)::BIGINT AS n_rows, count(*) AS unique_texts, count(*) FILTER (n > 1) AS duplicate_groups, coalesce(sum(n - 1), 0)::BIGINT AS duplicate_rows, max(n) AS largest_group FROM g GROUP BY lang
""")
def split_quality_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = docs(spark, sf_dir).groupBy("lang", text.fingerprint(F.col("text")).alias("fp")).agg(F.count("*").alias("n"))
    return g.groupBy("lang").agg(F.sum("n").alias("n_rows"), F.count("*").alias("unique_texts"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.sum(F.col("n") - 1).alias("duplicate_rows"), F.max("n").alias("largest_group"))


_PREFERENCE = """
WITH p AS (SELECT a.conv_id, a.turn, a.text AS chosen, b.text AS rejected FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
k AS (SELECT *, length(regexp_replace(chosen, '\\s', '', 'g')) AS c, length(regexp_replace(chosen, '[^a-z]', '', 'g')) / greatest(length(regexp_replace(chosen, '\\s', '', 'g')), 1) AS r, length(chosen) / greatest(length(rejected), 1) AS q, length(regexp_replace(chosen, '[^\\x00-\\x1f]', '', 'g')) / greatest(length(chosen), 1) AS b FROM p)
SELECT conv_id, turn, CASE WHEN c < 200 THEN 'chosen_too_short' WHEN r < 0.8 THEN 'chosen_low_hangul' WHEN b > 0.01 THEN 'chosen_bad_chars' WHEN q < 0.45 THEN 'chosen_much_shorter' WHEN q > 1.80 THEN 'chosen_much_longer' ELSE 'kept' END AS reason FROM k"""


@query(f"SELECT reason, count(*) AS n FROM ({_PREFERENCE}) GROUP BY reason")
def preference_keep_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    p = t.select("conv_id", "turn", F.col("text").alias("chosen")).join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("rejected")), ["conv_id", "turn"])
    return p.groupBy(chat.preference_reason(F.col("chosen"), F.col("rejected"), "[a-z]", least=200, least_ratio=0.8).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT CASE role WHEN 'user' THEN '01' WHEN 'assistant' THEN '02' ELSE '03' END AS split, count(*) AS n FROM conversations GROUP BY 1")
def bucket_routing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.when(F.col("role") == "user", "generate_human_vs_ai").when(F.col("role") == "assistant", "nochange_rejected").otherwise("rewrite")
    return table(spark, sf_dir, "conversations").groupBy(chat.split_of(bucket).alias("split")).agg(F.count("*").alias("n"))


@query("""
WITH m AS (SELECT conv_id, turn, role, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM conversations),
k AS (SELECT conv_id, turn, role, right(text, greatest(0, 900 - after)::BIGINT) AS content FROM m WHERE after < 900)
SELECT conv_id, count(*) AS n_messages, sum(length(content))::BIGINT AS chars, string_agg(role || ':' || content, '|' ORDER BY turn) AS joined FROM k GROUP BY conv_id
""")
def trim_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = chat.conversations(table(spark, sf_dir, "conversations")).select("conv_id", chat.trim_messages(F.col("messages"), 900).alias("m"))
    joined = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")
    return m.select("conv_id", F.size("m").cast("long").alias("n_messages"), F.aggregate("m", F.lit(0), lambda a, x: a + F.char_length(x["content"])).cast("long").alias("chars"), joined.alias("joined"))


@query("SELECT doc_id FROM documents ORDER BY sha256('4808|' || doc_id) LIMIT (SELECT round_even(count(*) * 0.25, 0)::INT FROM documents)")
def hash_share_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.hash_sample(docs(spark, sf_dir).select("doc_id"), F.col("doc_id"), 0.25, 4808)


@query("""
SELECT lang, count(*) AS n, sum(doc_id)::BIGINT AS id_sum FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('3407|' || doc_id), doc_id) AS k FROM documents)
WHERE k <= CASE lang WHEN 'en' THEN 50 WHEN 'fr' THEN 35 WHEN 'de' THEN 15 ELSE 0 END GROUP BY lang
""")
def quota_mix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rows.quota_mix(docs(spark, sf_dir).select("doc_id", "lang"), "lang", {"en": 50, "fr": 35, "de": 15}, "doc_id", 3407)
    return m.groupBy("lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


@query("""
SELECT doc_id, lang, k // w AS cycle, f + k % w AS slot FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k,
  CASE lang WHEN 'en' THEN 3 WHEN 'fr' THEN 2 ELSE 1 END AS w, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 3 ELSE 5 END AS f FROM documents WHERE lang IN ('en', 'fr', 'de'))
""")
def round_robin_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.round_robin(docs(spark, sf_dir).select("doc_id", "lang"), "lang", {"en": 3, "fr": 2, "de": 1}, "doc_id").select("doc_id", "lang", "cycle", F.col("slot").cast("long").alias("slot"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS turn, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS lane FROM documents")
def alternating_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.alternate(docs(spark, sf_dir).select("doc_id", "lang"), "lang", ["en", "fr", "de", "es"], "doc_id").select("doc_id", F.col("turn").cast("long").alias("turn"), F.col("lane").cast("int").alias("lane"))


@query("""
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS j, count(*) OVER () AS n FROM benchmark)
SELECT doc_id, item_id FROM a JOIN b ON i % n = j
""")
def modulo_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id")
    return rows.modulo_join(docs(spark, sf_dir).select("doc_id"), b, "doc_id", "item_id", b.count())


@query("""
WITH l AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM labels)
SELECT l.doc_id, coalesce(k.doc_id, p.doc_id) AS paired, k.doc_id IS NOT NULL AS by_key FROM l LEFT JOIN r k ON k.doc_id = l.doc_id LEFT JOIN r p ON p.i = l.i
""")
def positional_label_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the label of their key, else with the label at their position."""
    left = rows.numbered(docs(spark, sf_dir).select("doc_id"), "i", "doc_id")
    right = rows.numbered(table(spark, sf_dir, "labels").select("doc_id"), "i", "doc_id")
    out = left.join(right.select("doc_id", F.col("doc_id").alias("k")), "doc_id", "left").join(right.select("i", F.col("doc_id").alias("p")), "i", "left")
    return out.select("doc_id", F.coalesce("k", "p").alias("paired"), F.col("k").isNotNull().alias("by_key"))


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS found, coalesce('quality ' || l.quality, 'document ' || d.doc_id) AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their label, or with a name made from their key."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("q"))
    d = docs(spark, sf_dir).select("doc_id").join(labels, F.col("k") == F.col("doc_id"), "left")
    return d.select("doc_id", F.col("k").isNotNull().alias("found"), F.coalesce("q", F.concat(F.lit("document "), F.col("doc_id").cast("string"))).alias("label"))


@query("""
WITH p AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant')
SELECT conv_id, turn, least(400, length(x) + length(y)) AS n_ids, least(400, length(x)) AS n_masked, (ceil(least(400, length(x) + length(y)) / 8.0) * 8)::INT AS n_padded FROM p
""")
def loss_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    p = t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("x")).join(t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y")), ["conv_id", "turn"])
    m = p.select("conv_id", "turn", chat.loss_labels(F.col("x"), F.col("y"), 400).alias("m"))
    return m.select("conv_id", "turn", F.size("m.input_ids").cast("long").alias("n_ids"), F.size(F.filter("m.labels", lambda v: v == -100)).cast("long").alias("n_masked"), F.size(chat.padded(F.col("m.labels"), 8, -100)).alias("n_padded"))


@query("SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY role")
def count_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))
