"""Queries on sentence and token metrics, rewrites, prompts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusweave.functions import arrays, lexical, stats, text
from corpusweave.operators import chat, quantiles, reference, rewrite, rows, scorer
from corpusweave.plans.group_queries import _VALUES, values
from corpusweave.plans.registry import query
from corpusweave.plans.text_queries import docs, tokens
from corpusweave.sources.tables import table

_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?]) +', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""
WITH s AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, {_SENTENCES} AS s FROM documents),
l AS (SELECT doc_id, t, greatest(length(t), 1) AS n, s, list_transform(s, lambda x: length(x)) AS ls, list_filter(list_transform(s, lambda x: list_filter(regexp_extract_all(lower(x), '[가-힣a-z0-9]+'), lambda w: length(w) >= 2)), lambda w: len(w) > 0) AS ws FROM s),
e AS (SELECT doc_id, unnest(ws) AS w FROM l),
a AS (SELECT doc_id, coalesce(sum(n) FILTER (n > 1), 0) / sum(n)::DOUBLE AS r FROM (SELECT doc_id, w[1] AS x, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT doc_id, coalesce(sum(n) FILTER (n > 1), 0) / sum(n)::DOUBLE AS r FROM (SELECT doc_id, w[-1] AS x, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT *, {" + ".join(f"len(regexp_extract_all(t, '{p}'))" for p in text.SIMILES)} AS similes FROM l)
SELECT m.doc_id, length(t) AS char_len, len(s) AS sentence_count, len(regexp_extract_all(t, '[가-힣]')) / greatest(1, len(regexp_extract_all(t, '[가-힣A-Za-z]'))) AS hangul_ratio, 1000.0 * len(regexp_extract_all(t, '[,，]')) / n AS comma_per_1k_chars,
       len(list_filter(s, lambda x: regexp_matches(x, '[,，]'))) / greatest(len(s), 1) AS comma_sentence_rate, coalesce(list_avg(ls), 0) AS sentence_length_mean_chars, coalesce(list_stddev_pop(ls), 0) / greatest(1, coalesce(list_avg(ls), 0)) AS sentence_length_cv,
       coalesce((list_aggregate(ls, 'quantile_cont', 0.75) - list_aggregate(ls, 'quantile_cont', 0.25)) / greatest(1, list_aggregate(ls, 'quantile_cont', 0.5)), 0) AS sentence_length_iqr_ratio, coalesce(a.r, 0) AS sentence_initial_token_repeat_rate, coalesce(b.r, 0) AS sentence_final_token_repeat_rate,
       similes AS simile_marker_count, 1000.0 * similes / n AS simile_marker_per_1k_chars, len(list_filter(s, lambda x: regexp_matches(x, '{"|".join(text.SIMILES)}'))) / greatest(len(s), 1) AS simile_sentence_rate
FROM m LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)
""")
def basic_text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = docs(spark, sf_dir).select("doc_id", text.strip(F.col("text")).alias("t")).select("doc_id", "t", text.sentences(F.col("t")).alias("s"))
    s, metrics = scorer.basic_metrics(s, "t", "s")
    return s.select("doc_id", *[c.alias(k) for k, c in metrics.items()])


@query(f"""
WITH s AS (SELECT doc_id, unnest({_SENTENCES}) AS s FROM documents), t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(s), '[a-z0-9]+'), lambda x: length(x) >= 2) AS t FROM s),
e AS (SELECT doc_id, t[1] AS a, t[-1] AS b FROM t WHERE len(t) > 0),
a AS (SELECT doc_id, coalesce(sum(n) FILTER (n > 1), 0) / sum(n)::DOUBLE AS r FROM (SELECT doc_id, a, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT doc_id, coalesce(sum(n) FILTER (n > 1), 0) / sum(n)::DOUBLE AS r FROM (SELECT doc_id, b, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, a.r AS initial_repeat_rate, b.r AS final_repeat_rate FROM a JOIN b USING (doc_id)
""")
def sentence_edge_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = docs(spark, sf_dir).select("doc_id", F.transform(text.sentences(F.col("text")), lambda x: F.filter(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.char_length(t) >= 2)).alias("s"))
    s = s.withColumn("s", F.filter("s", lambda t: F.size(t) > 0)).where(F.size("s") > 0)
    edge = lambda k: F.transform("s", lambda t: F.element_at(t, k))
    return s.select("doc_id", arrays.repeated_occurrence_rate(edge(1)).alias("initial_repeat_rate"), arrays.repeated_occurrence_rate(edge(-1)).alias("final_repeat_rate"))


@query()
def mtld_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(docs(spark, sf_dir)).select("doc_id", lexical.mtld("t").alias("mtld"))


@query()
def normalized_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.char_length(lexical.normalized(F.col("text"))).alias("chars"), F.char_length(text.clean_markup(F.col("text"))).alias("cleaned_chars"))


_TURNS = "SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", F.col("text").alias("x")).join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y")), ["conv_id", "turn"])


@query(f"""
WITH p AS ({_TURNS}), u AS (SELECT conv_id, turn, 0 AS side, unnest(list_filter(regexp_extract_all(lower(x), '[가-힣a-z0-9]+'), lambda t: length(t) >= 2)) AS w FROM p
  UNION ALL SELECT conv_id, turn, 1, unnest(list_filter(regexp_extract_all(lower(y), '[가-힣a-z0-9]+'), lambda t: length(t) >= 2)) FROM p),
c AS (SELECT conv_id, turn, w, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM u GROUP BY 1, 2, 3),
o AS (SELECT conv_id, turn, sum(least(a, b)) / nullif(sum(greatest(a, b)), 0)::DOUBLE AS jaccard, sum(least(a, b)) / nullif(least(sum(a), sum(b)), 0)::DOUBLE AS containment FROM c GROUP BY 1, 2)
SELECT conv_id, turn, length(trim(y)) / greatest(length(trim(x)), 1) AS length_ratio, coalesce(jaccard, 0) AS jaccard, coalesce(containment, 0) AS containment FROM p LEFT JOIN o USING (conv_id, turn)
""")
def rewrite_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.rewrite_metrics(turn_pairs(spark, sf_dir), "x", "y").select("conv_id", "turn", "length_ratio", "jaccard", "containment")


@query("SELECT doc_id, length(text) > 3200 AS is_cut, length(right(text, 3200)) AS chars FROM documents")
def tail_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # No document here has a blank line, at which a tail would start.
    return docs(spark, sf_dir).select("doc_id", (F.char_length("text") > 3200).alias("is_cut"), F.char_length(text.tail_context(F.col("text"))).cast("long").alias("chars"))


@query("SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS k FROM conversations) WHERE k <= 5")
def first_rows_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return t.withColumn("k", F.row_number().over(Window.partitionBy("role").orderBy("conv_id", "turn"))).where("k <= 5").select("conv_id", "turn", "role")


@query("""
SELECT conv_id, string_agg('<' || role || '>' || text || '</' || role || '>', chr(10) ORDER BY turn) || chr(10) || '<assistant>' AS rendered, count(*) FILTER (role = 'user') AS n_user FROM conversations GROUP BY conv_id
""")
def rendered_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chat.conversations(table(spark, sf_dir, "conversations"))
    turn = lambda m: F.concat(F.lit("<"), m["role"], F.lit(">"), m["content"], F.lit("</"), m["role"], F.lit(">"))
    return c.select("conv_id", F.concat(F.array_join(F.transform("messages", turn), "\n"), F.lit("\n<assistant>")).alias("rendered"), F.size(F.filter("messages", lambda m: m["role"] == "user")).cast("long").alias("n_user"))


@query("""
WITH l AS (SELECT conv_id, max(turn) FILTER (role = 'user') AS last, max(turn) AS top FROM conversations GROUP BY 1)
SELECT l.conv_id, (sum(length(text)) + any_value(CASE WHEN last IS NULL THEN 4 ELSE 6 END))::BIGINT AS chars, count(*) + any_value(CASE WHEN last IS NULL THEN 1 ELSE 0 END) AS n FROM l JOIN conversations USING (conv_id) GROUP BY l.conv_id
""")
def decorated_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chat.conversations(table(spark, sf_dir, "conversations")).select("conv_id", chat.decorate_last_user(F.col("messages"), "@@@@").alias("m"))
    return c.select("conv_id", F.aggregate("m", F.lit(0).cast("long"), lambda a, m: a + F.char_length(m["content"])).alias("chars"), F.size("m").cast("long").alias("n"))


@query("SELECT DISTINCT text FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM (SELECT text FROM conversations WHERE role = 'user') u WHERE u.text = c.text)")
def unseen_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of turns that no user said."""
    t = table(spark, sf_dir, "conversations").select("role", "text", F.to_json(F.struct("text")).alias("p"))
    return t.join(t.where("role = 'user'").select("p").distinct(), "p", "left_anti").select("text").distinct()


@query(f"""
WITH {_VALUES}, a AS (SELECT metric, value, doc_id % 3 AS g FROM v),
d AS (SELECT x.metric, x.g AS left_group, y.g AS right_group, sum(sign(x.value - y.value)) / count(*) AS cliffs_delta FROM a x JOIN a y ON x.metric = y.metric AND x.g < y.g GROUP BY 1, 2, 3)
SELECT metric, left_group, right_group, cliffs_delta FROM d ORDER BY abs(cliffs_delta) DESC, metric, left_group, right_group LIMIT 4
""")
def top_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = values(spark, sf_dir).withColumn("g", F.col("doc_id") % 3)
    out = None
    for a, b in ((0, 1), (0, 2), (1, 2)):
        part = stats.cliffs_delta(v.where(F.col("g").isin(a, b)), "value", F.col("g") == a, ["metric"]).select("metric", F.lit(a).cast("long").alias("left_group"), F.lit(b).cast("long").alias("right_group"), "cliffs_delta")
        out = part if out is None else out.unionByName(part)
    return out.orderBy(F.abs("cliffs_delta").desc(), "metric", "left_group", "right_group").limit(4)


@query("""
WITH g AS (SELECT user_id, count(*) AS n, stddev_pop(value) AS std, avg((event_type = 'purchase')::INT) AS ok_rate, avg((value < 0)::INT) AS negative_rate, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75 FROM events GROUP BY 1)
SELECT * FROM g
""")
def group_risk_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    g = e.groupBy("user_id").agg(F.count("*").alias("n"), F.stddev_pop("value").alias("std"), F.avg((F.col("event_type") == "purchase").cast("int")).alias("ok_rate"), F.avg((F.col("value") < 0).cast("int")).alias("negative_rate"))
    g = g.join(quantiles.quantiles(e, ["user_id"], "value", (0.25, 0.75)).select("user_id", "q"), "user_id", "left")
    return g.select("user_id", "n", "std", "ok_rate", "negative_rate", F.get("q", 0).alias("p25"), F.get("q", 1).alias("p75"))


@query("""
SELECT count(*) AS n, count(*) FILTER (contains(text, '<|')) AS stop_hits, count(*) FILTER (contains(text, chr(65533))) AS broken, count(*) FILTER (length(text) < 40) AS too_short, max(length(text)) AS longest, avg(length(text)) AS mean_chars FROM conversations
""")
def gate_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length("text")
    return table(spark, sf_dir, "conversations").agg(
        F.count("*").alias("n"),
        F.count_if(F.contains("text", F.lit("<|"))).alias("stop_hits"),
        F.count_if(F.contains("text", F.lit("�"))).alias("broken"),
        F.count_if(n < 40).alias("too_short"),
        F.max(n).cast("long").alias("longest"),
        F.avg(n).alias("mean_chars"),
    )


@query("""
WITH c AS (SELECT lang, g, count(*) AS n FROM (SELECT lang, unnest(list_transform(range(1, greatest(length(text) - 1, 1)), lambda i: substr(lower(text), i, 2))) AS g FROM documents WHERE lang IN ('en', 'fr')) WHERE regexp_matches(g, '^[a-z][a-z]$') GROUP BY 1, 2),
p AS (SELECT g, coalesce(sum(n) FILTER (lang = 'en'), 0) / (SELECT sum(n) FROM c WHERE lang = 'en') - coalesce(sum(n) FILTER (lang = 'fr'), 0) / (SELECT sum(n) FROM c WHERE lang = 'fr') AS gap FROM c GROUP BY 1)
SELECT g, gap FROM p ORDER BY abs(gap) DESC, g LIMIT 16
""")
def usage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).where("lang IN ('en', 'fr')").withColumn("t", F.lower("text"))
    # Pairs that start at odd and at even places: two linear cuts instead of one substring a place.
    halves = lambda t, n: F.filter(F.regexp_extract_all(t, F.lit("(?s).."), F.lit(0)), lambda x: F.char_length(x) == n)
    whole = F.substring(F.col("t"), F.lit(1), F.char_length("t") - 1)
    pairs = F.concat(halves(whole, 2), halves(F.substring(whole, F.lit(2), F.char_length("t")), 2))
    c = d.where(F.char_length("t") > 2).select("lang", F.explode(pairs).alias("g")).where(F.rlike("g", F.lit("^[a-z][a-z]$"))).groupBy("lang", "g").agg(F.count("*").alias("n"))
    c = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    gap = F.coalesce(F.sum(F.when(F.col("lang") == "en", F.col("p"))), F.lit(0.0)) - F.coalesce(F.sum(F.when(F.col("lang") == "fr", F.col("p"))), F.lit(0.0))
    return c.groupBy("g").agg(gap.alias("gap")).orderBy(F.abs("gap").desc(), "g").limit(16)


@query("""
WITH p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('7|' || doc_id), doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IN ('en', 'fr', 'de')),
s AS (SELECT range AS pos, ['en', 'en', 'fr', 'de'][range % 4 + 1] AS lang, CASE range % 4 WHEN 0 THEN 2 * (range // 4) WHEN 1 THEN 2 * (range // 4) + 1 ELSE range // 4 END AS k FROM range(400))
SELECT pos, s.lang, p.doc_id FROM s JOIN p ON p.lang = s.lang AND p.k = s.k % p.n
""")
def balanced_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """400 positions over a type pattern; each type walks its hash-ordered pool round and round. Types
    that the pattern doesn't name take no part, as the sampler has it."""
    pool = docs(spark, sf_dir).where("lang IN ('en', 'fr', 'de')").withColumn("h", F.sha2(F.concat(F.lit("7|"), F.col("doc_id").cast("string")), 256))
    pool = rows.numbered_within(pool.select("lang", "h", "doc_id"), "lang", "k", "h", "doc_id")
    sizes = pool.groupBy("lang").agg(F.count("*").alias("n"))
    pattern = F.array(*[F.lit(x) for x in ("en", "en", "fr", "de")])
    q, r = F.floor(F.col("id") / 4), F.pmod("id", F.lit(4))
    slots = spark.range(400).select(F.col("id").alias("pos"), F.get(pattern, r.cast("int")).alias("lang"), F.when(r == 0, 2 * q).when(r == 1, 2 * q + 1).otherwise(q).alias("slot"))
    slots = slots.join(F.broadcast(sizes), "lang").withColumn("k", F.pmod("slot", "n"))  # one row per type
    return slots.join(pool.select("lang", "k", "doc_id"), ["lang", "k"]).select("pos", "lang", "doc_id")


@query(f"""
WITH {_VALUES}, r AS (SELECT metric, avg(value) FILTER (quality = 1) AS h, avg(value) FILTER (quality = 0) AS a FROM v GROUP BY 1)
SELECT doc_id, avg(greatest(0, least(100, (1 - greatest(-1, least(1, 2.0 * (value - a) / (h - a) - 1))) * 50)))::DOUBLE AS likeness FROM v JOIN r USING (metric) WHERE abs(h - a) > 1e-9 GROUP BY doc_id
""")
def likeness_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = values(spark, sf_dir)
    r = reference.closures(v, F.col("quality") == 0, F.col("quality") == 1, F.col("quality") == 1).where("abs(base_mean - target_mean) > 1e-9")
    s = v.join(F.broadcast(r), "metric")  # one row per metric
    away = stats.away_score(F.col("value"), F.col("target_mean"), F.col("base_mean"))
    return s.groupBy("doc_id").agg(F.avg(stats.clip((1.0 - away) * 50.0, 0.0, 100.0)).alias("likeness"))


@query("""
SELECT conv_id, turn, contains(text, 'the of') AS literal_hit, len(list_filter(range(1, len(t)), lambda i: t[i] = 'the' AND t[i + 1] = 'of')) > 0 AS run_hit
FROM (SELECT conv_id, turn, lower(text) AS text, regexp_extract_all(lower(text), '[a-z]+') AS t FROM conversations)
""")
def token_run_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").withColumn("text", F.lower("text"))
    run = F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))
    return t.select("conv_id", "turn", F.contains("text", F.lit("the of")).alias("literal_hit"), arrays.contains_run(run, ["the", "of"]).alias("run_hit"))
