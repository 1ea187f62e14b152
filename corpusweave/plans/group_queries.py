"""Queries that compare groups, score metrics and shape rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusweave.functions import stats, text
from corpusweave.operators import quantiles, reference, rewards
from corpusweave.plans.registry import query
from corpusweave.plans.text_queries import docs, tokens
from corpusweave.sources.tables import table

METRICS = ["comma_per_1k_chars", "char_len", "word_len"]
_VALUES = """
v AS (SELECT doc_id, quality, m.metric, m.value FROM (
  SELECT doc_id, quality, unnest([{'metric': 'comma_per_1k_chars', 'value': 1000.0 * (length(text) - length(replace(text, ',', ''))) / greatest(length(text), 1)},
    {'metric': 'char_len', 'value': length(text)::DOUBLE}, {'metric': 'word_len', 'value': length(text) / greatest(len(string_split(text, ' ')), 1)}]) AS m
  FROM documents JOIN labels USING (doc_id)))"""


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, quality, metric, value) of the labelled documents."""
    t = F.col("text")
    m = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id",
        "quality",
        text.per_1k(text.occurrences(t, ","), t).alias("comma_per_1k_chars"),
        F.char_length(t).alias("char_len"),
        (F.char_length(t) / F.greatest(F.size(F.split(t, " ")), F.lit(1))).alias("word_len"),
    )
    return reference.long_form(m, ["doc_id", "quality"], METRICS)


@query("""
SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS std, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.1) AS p10,
       quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.75) AS p75, quantile_cont(l_quantity, 0.9) AS p90, min(l_quantity) AS min, max(l_quantity) AS max
FROM lineitem GROUP BY 1, 2
""")
def metric_summary_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.summarized(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


@query(f"""
WITH {_VALUES}, a AS (SELECT metric, value FROM v WHERE quality = 1), b AS (SELECT metric, value FROM v WHERE quality = 0),
d AS (SELECT metric, sum(sign(a.value - b.value)) / count(*) AS cliffs_delta FROM a JOIN b USING (metric) GROUP BY 1)
SELECT metric, (SELECT count(*) FROM a WHERE a.metric = d.metric) AS left_n, (SELECT count(*) FROM b WHERE b.metric = d.metric) AS right_n, cliffs_delta,
       CASE WHEN abs(cliffs_delta) >= 0.474 THEN 'large' WHEN abs(cliffs_delta) >= 0.33 THEN 'medium' WHEN abs(cliffs_delta) >= 0.147 THEN 'small' ELSE 'negligible' END AS effect FROM d
""")
def distribution_tests_cliffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.cliffs_delta(values(spark, sf_dir), "value", F.col("quality") == 1, ["metric"])
    return out.withColumn("effect", stats.effect_label(F.col("cliffs_delta")))


@query(f"""
WITH {_VALUES}, m AS (SELECT metric, avg(value) FILTER (quality = 0) AS base_mean, avg(value) FILTER (quality = 1) AS target_mean, avg(value) FILTER (doc_id % 3 = 0) AS moved_mean FROM v GROUP BY 1),
g AS (SELECT *, CASE WHEN abs(base_mean - target_mean) > 1e-12 THEN (abs(base_mean - target_mean) - abs(moved_mean - target_mean)) / abs(base_mean - target_mean) END AS gap_closure FROM m)
SELECT *, CASE WHEN gap_closure > 0.05 THEN 'improved' WHEN gap_closure < -0.05 THEN 'worse' ELSE 'small' END AS status FROM g
""")
def gap_closure_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reference.closures(values(spark, sf_dir), F.col("quality") == 0, F.col("quality") == 1, F.col("doc_id") % 3 == 0)
    return out.withColumn("status", stats.closure_status(F.col("gap_closure")))


_REFERENCE = f"""{_VALUES},
r AS (SELECT metric, quantile_cont(value, 0.1) FILTER (quality = 1) AS q10, quantile_cont(value, 0.25) FILTER (quality = 1) AS q25, quantile_cont(value, 0.5) FILTER (quality = 1) AS q50,
        quantile_cont(value, 0.75) FILTER (quality = 1) AS q75, quantile_cont(value, 0.9) FILTER (quality = 1) AS q90, avg(value) FILTER (quality = 1) AS hm, avg(value) FILTER (quality = 0) AS am FROM v GROUP BY 1)"""


@query(f"""
WITH {_REFERENCE}
SELECT metric, q10 AS human_q10, q25 AS human_q25, q50 AS human_q50, q75 AS human_q75, q90 AS human_q90, hm AS human_mean, am AS ai_mean,
       (SELECT avg((value BETWEEN q25 AND q75)::INT) FROM v WHERE v.metric = r.metric AND quality = 0) AS ai_in_human_iqr_rate,
       (SELECT avg((value BETWEEN q10 AND q90)::INT) FROM v WHERE v.metric = r.metric AND quality = 0) AS ai_in_human_q10_q90_rate FROM r
""")
def style_reference_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reference.style_reference(values(spark, sf_dir), F.col("quality") == 1)
    return out.drop("human_iqr", "weight", "cliffs_delta_human_vs_ai")


_BANDS = f"""
WITH {_REFERENCE}, s AS (SELECT doc_id, metric, value, q10, q25, q50, q75, q90, hm, am, greatest(1e-9, q25 - q10) AS li, greatest(1e-9, q90 - q75) AS ri, greatest(1e-9, q75 - q25, abs(q50) * 0.05, 1e-6) AS mid FROM v JOIN r USING (metric)),
b AS (SELECT doc_id, metric, CASE
    WHEN value BETWEEN q25 AND q75 THEN greatest(0.08, least(0.22, 0.22 - 0.10 * abs(value - q50) / mid))
    WHEN value >= q10 AND value < q25 THEN greatest(-0.42, least(0, -0.42 * (q25 - value) / li))
    WHEN value > q75 AND value <= q90 THEN greatest(-0.42, least(0, -0.42 * (value - q75) / ri))
    WHEN value < q10 THEN greatest(-1, least(-0.42, -0.42 - 0.58 * least(1, (q10 - value) / li)))
    ELSE greatest(-1, least(-0.42, -0.42 - 0.58 * least(1, (value - q90) / ri))) END::DOUBLE AS band,
  CASE WHEN abs(hm - am) < 1e-9 THEN 0 ELSE greatest(-1, least(1, 2.0 * (value - am) / (hm - am) - 1.0)) END::DOUBLE AS away FROM s)"""


@query(f"""
{_BANDS}
SELECT metric, avg(band) AS mean_band, avg(away) AS mean_away, avg(greatest(-1, least(1, 0.90 * band + 0.10 * 0.25 * away))) AS mean_score FROM b GROUP BY metric
""")
def band_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = values(spark, sf_dir)
    r = v.join(F.broadcast(reference.style_reference(v, F.col("quality") == 1)), "metric")
    q = [F.col(f"human_{n}") for n in ("q10", "q25", "q50", "q75", "q90", "iqr")]
    band, away = stats.banded_reward(F.col("value"), *q), stats.away_score(F.col("value"), F.col("human_mean"), F.col("ai_mean"))
    s = r.select("metric", band.alias("band"), away.alias("away"))
    return s.groupBy("metric").agg(F.avg("band").alias("mean_band"), F.avg("away").alias("mean_away"), F.avg(stats.metric_score(F.col("band"), F.col("away"))).alias("mean_score"))


@query(f"""
{_BANDS},
i AS (SELECT metric, avg((value BETWEEN q25 AND q75)::INT) AS inside FROM v JOIN r USING (metric) WHERE quality = 0 GROUP BY 1),
d AS (SELECT x.metric, abs(sum(sign(x.value - y.value)) / count(*)) AS delta FROM v x JOIN v y ON x.metric = y.metric AND x.quality = 1 AND y.quality = 0 GROUP BY 1),
w AS (SELECT metric, delta * (0.35 + 0.65 * (1 - inside)) AS w, CASE metric WHEN 'comma_per_1k_chars' THEN 'comma' ELSE 'other' END AS family FROM i JOIN d USING (metric)),
f AS (SELECT doc_id, family, sum(greatest(-1, least(1, 0.90 * band + 0.10 * 0.25 * away)) * w) / sum(w) AS f FROM b JOIN w USING (metric) GROUP BY 1, 2)
SELECT doc_id, (sum(f * CASE family WHEN 'comma' THEN 0.22 ELSE 0.05 END) / sum(CASE family WHEN 'comma' THEN 0.22 ELSE 0.05 END))::DOUBLE AS score FROM f GROUP BY doc_id
""")
def family_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = values(spark, sf_dir)
    s = reference.scored(v, reference.style_reference(v, F.col("quality") == 1))
    f = s.groupBy("doc_id", "family").agg((F.sum(F.col("score") * F.col("metric_weight")) / F.nullif(F.sum("metric_weight"), F.lit(0.0))).alias("family_score"))
    w = F.create_map(*[F.lit(x) for kv in stats.FAMILY_WEIGHTS.items() for x in kv])[F.col("family")]
    return f.groupBy("doc_id").agg((F.sum(F.col("family_score") * w) / F.sum(F.when(F.col("family_score").isNotNull(), w))).alias("score"))


@query(f"""
WITH {_VALUES}, m AS (SELECT metric, avg(value) FILTER (quality = 1) AS h, avg(value) FILTER (quality = 0) AS a FROM v GROUP BY 1)
SELECT doc_id, avg((value - h) / (a - h)) AS raw_axis, avg(greatest(0, least(1, (value - h) / (a - h)))) AS clipped_axis, count(*) AS metric_count FROM v JOIN m USING (metric) WHERE abs(a - h) > 1e-9 GROUP BY doc_id
""")
def composite_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = values(spark, sf_dir)
    m = v.groupBy("metric").agg(F.avg(F.when(F.col("quality") == 1, F.col("value"))).alias("h"), F.avg(F.when(F.col("quality") == 0, F.col("value"))).alias("a")).where("abs(a - h) > 1e-9")
    axis = (F.col("value") - F.col("h")) / (F.col("a") - F.col("h"))
    return v.join(F.broadcast(m), "metric").groupBy("doc_id").agg(F.avg(axis).alias("raw_axis"), F.avg(stats.clip(axis, 0.0, 1.0)).alias("clipped_axis"), F.count("*").alias("metric_count"))


@query(f"""
WITH {_VALUES}, m AS (SELECT metric, avg(value) FILTER (quality = 1) AS h, avg(value) FILTER (quality = 0) AS a FROM v GROUP BY 1), g AS (SELECT 'comma' AS part, 'comma_per_1k_chars' AS metric UNION ALL SELECT 'length', 'char_len' UNION ALL SELECT 'length', 'word_len')
SELECT doc_id, part, count(*) AS metric_count, avg(greatest(0, least(1, (value - h) / (a - h)))) AS ai_likeness, avg((value - h) / (a - h)) AS ai_likeness_raw FROM v JOIN m USING (metric) JOIN g USING (metric) WHERE abs(a - h) > 1e-9 GROUP BY 1, 2
""")
def composite_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near each document's groups of metrics are to the second kind of texts."""
    return reference.composites(values(spark, sf_dir), F.col("quality") == 1, "doc_id", {"comma": ["comma_per_1k_chars"], "length": ["char_len", "word_len"]})


@query(f"""
WITH {_VALUES}, m AS (SELECT metric, avg(value) FILTER (quality = 1) AS h, avg(value) FILTER (quality = 0) AS a, avg(value) FILTER (doc_id % 3 = 0) AS r FROM v GROUP BY 1),
c AS (SELECT *, greatest(0, least(1.6, 1 - (abs(a - h) - abs(r - h)) / abs(a - h))) AS severity FROM m WHERE abs(a - h) > 0)
SELECT metric, severity::DOUBLE AS severity, round(greatest(0.05, least(4.0, 1 + 0.55 * severity))::DOUBLE, 4) AS weight FROM c
""")
def pivot_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = values(spark, sf_dir)
    groups = F.explode(F.array_compact(F.array(F.when(F.col("quality") == 1, "human").when(F.col("quality") == 0, "ai"), F.when(F.col("doc_id") % 3 == 0, "rewrite"))))
    p = v.select("metric", "value", groups.alias("g")).groupBy("metric").pivot("g", ["human", "ai", "rewrite"]).agg(F.avg("value"))
    severity = stats.clip(1.0 - stats.gap_closure(F.col("ai"), F.col("human"), F.col("rewrite")), 0.0, 1.6)
    return p.withColumn("severity", severity).where("severity IS NOT NULL").select("metric", "severity", F.bround(stats.clip(1.0 + 0.55 * F.col("severity"), 0.05, 4.0), 4).alias("weight"))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = values(spark, sf_dir).withColumn("g", F.when(F.col("doc_id") % 3 == 0, "rewrite").when(F.col("quality") == 1, "human").otherwise("ai"))
    return reference.bootstrap_closure(v, "g", "doc_id")


_GROUPED = "WITH g AS (SELECT event_id, user_id, (value - 50) / 50 AS r, avg((value - 50) / 50) OVER w AS m, stddev_pop((value - 50) / 50) OVER w AS s, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id))"


def _rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", ((F.col("value") - 50) / 50).alias("r"))


@query(f"{_GROUPED} SELECT event_id, CASE WHEN n >= 2 THEN greatest(-1, least(1, m + (r - m) / pow(greatest(s, 0.10), 0.5))) ELSE r END::DOUBLE AS shaped FROM g")
def std_shaping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewards.std_shaped(_rewards(spark, sf_dir), "user_id", "r", 0.5).select("event_id", "shaped")


@query(f"{_GROUPED} SELECT event_id, w AS weight, m + (r - m) * w AS shrunk FROM (SELECT *, CASE WHEN n >= 2 THEN 0.3 + 0.7 * greatest(0, least(1, (s - 0.3) / 0.6)) ELSE 1 END::DOUBLE AS w FROM g)")
def std_update_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewards.low_std_shrunk(_rewards(spark, sf_dir), "user_id", "r", 0.3, 0.3, 0.9).select("event_id", "weight", "shrunk")


@query("""
WITH g AS (SELECT user_id, stddev_pop(value) / 100 AS s, avg((event_type = 'purchase')::INT) AS c, avg((value < 5)::INT) AS f FROM events GROUP BY 1),
w AS (SELECT user_id, CASE WHEN s <= 0.04 THEN 0 WHEN s >= 0.12 THEN 1 ELSE (s - 0.04) / 0.08 END * CASE WHEN s <= 0.55 THEN 1 WHEN s >= 0.85 THEN 0.25 ELSE 1 - 0.75 * (s - 0.55) / 0.3 END
  * CASE WHEN c <= 0.50 THEN 0 WHEN c >= 0.85 THEN 1 ELSE (c - 0.50) / 0.35 END * CASE WHEN f <= 0.15 THEN 1 WHEN f >= 0.45 THEN 0 ELSE 1 - (f - 0.15) / 0.3 END AS w FROM g)
SELECT user_id, u AS update_index, CASE WHEN u = 0 THEN 1 ELSE w END::DOUBLE AS weight, CASE WHEN u = 0 THEN 'first_update' WHEN w >= 0.75 THEN 'use' WHEN w >= 0.25 THEN 'downweight' ELSE 'skip' END AS decision FROM w, (SELECT unnest([0, 1, 2]) AS u)
""")
def update_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id").agg((F.stddev_pop("value") / 100).alias("s"), F.avg((F.col("event_type") == "purchase").cast("int")).alias("c"), F.avg((F.col("value") < 5).cast("int")).alias("f"))
    none = F.lit(None).cast("double")
    g = g.withColumn("update_index", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    u = F.col("update_index")
    w = rewards.update_gate(F.col("s"), none, none, F.col("c"), F.col("f"), update=u)
    return g.select("user_id", "update_index", w.alias("weight"), rewards.gate_decision(w, u).alias("decision"))


_LEXICON = """
WITH t AS (SELECT unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 2)) AS term, quality FROM documents JOIN labels USING (doc_id)),
c AS (SELECT term, count(*) FILTER (quality = 1) AS h, count(*) FILTER (quality = 0) AS a FROM t GROUP BY 1), s AS (SELECT sum(h) AS sh, sum(a) AS sa FROM c),
l AS (SELECT term, h AS human_count, a AS ai_count, ((a + 0.5) / sa) / ((h + 0.5) / sh) AS lift FROM c, s WHERE h + a >= 5)"""


@query(f"{_LEXICON} SELECT term, human_count, ai_count, lift::DOUBLE AS lift, ln(lift)::DOUBLE AS weight FROM l WHERE lift >= 4 ORDER BY ln(lift) DESC, ai_count DESC, term LIMIT 100")
def lexicon_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens(docs(spark, sf_dir), 2).join(table(spark, sf_dir, "labels"), "doc_id").select("quality", F.explode("t").alias("term"))
    return reference.top_terms(reference.lexicon(t, F.col("quality") == 1, least=5), None, 100, 4.0)


@query("""
WITH p AS (SELECT o_custkey, o_totalprice, o_orderpriority FROM orders), m AS (SELECT avg(o_totalprice) AS m FROM p WHERE o_orderpriority = '1-URGENT'),
b AS (SELECT o_custkey, avg(o_totalprice) AS v FROM p WHERE o_orderpriority = '5-LOW' GROUP BY 1), a AS (SELECT o_custkey, avg(o_totalprice) AS v FROM p WHERE o_orderpriority = '3-MEDIUM' GROUP BY 1)
SELECT count(*) AS n_pairs, avg((abs(a.v - m) < abs(b.v - m))::INT) AS nearer_share, avg(a.v - b.v) AS mean_delta, quantile_cont((b.v - a.v) / b.v, 0.5) AS median_reduction FROM a JOIN b USING (o_custkey), m
""")
def paired_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    side = lambda p, name: o.where(F.col("o_orderpriority") == p).groupBy("o_custkey").agg(F.avg("o_totalprice").alias(name))
    m = o.where(F.col("o_orderpriority") == "1-URGENT").agg(F.avg("o_totalprice").alias("m"))
    p = side("5-LOW", "b").join(side("3-MEDIUM", "a"), "o_custkey").crossJoin(F.broadcast(m))  # m is one row
    nearer = (F.abs(F.col("a") - F.col("m")) < F.abs(F.col("b") - F.col("m"))).cast("int")
    p = p.withColumn("reduction", (F.col("b") - F.col("a")) / F.nullif(F.col("b"), F.lit(0.0)))
    out = p.agg(F.count("*").alias("n_pairs"), F.avg(nearer).alias("nearer_share"), F.avg(F.col("a") - F.col("b")).alias("mean_delta"))
    return out.join(quantiles.quantiles(p, [], "reduction", (0.5,)).select(F.get("q", 0).alias("median_reduction")), F.lit(True), "left")  # one row each


@query("SELECT event_type, count(*) AS n, avg(value) AS mean, avg((value < 10)::INT) AS low_rate, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def reward_means_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg((F.col("value") < 10).cast("int")).alias("low_rate"), F.count_distinct("user_id").alias("n_users"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, avg(value) AS mean_value FROM events GROUP BY 1, 2")
def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.streaming.events import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events"))


@query("SELECT user_id, rank, event_id, value FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3")
def top_events_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))).where("rank <= 3").select("user_id", F.col("rank").cast("long").alias("rank"), "event_id", "value")
