"""Queries on tags, full metric rows, scores, rewards and audits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusweave.functions import stats, tag_arrays, tagging, text
from corpusweave.operators import analysis, lexicon, linear, quantiles, reference, rewards, rewrite, rows, scorer, tagger
from corpusweave.plans.metric_queries import turn_pairs
from corpusweave.plans.registry import query
from corpusweave.plans.text_queries import CONTRACT_REASONS, CONTRACT_TEXT, docs
from corpusweave.sources.tables import settled, table

_FORMS = f"regexp_extract_all(text, '{tagging.TOKEN}')"
_TAGGED = f"""
f AS (SELECT doc_id, unnest(fs) AS form, unnest(range(1, len(fs) + 1)) AS i FROM (SELECT doc_id, {_FORMS} AS fs FROM documents)),
t AS (SELECT doc_id, i, form, {tagging.sql_tag("form")} AS tag FROM f)"""
_TAGS = f"{_TAGGED}, m AS (SELECT doc_id, tag, form, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM t WHERE NOT starts_with(tag, 'S'))"


def _counted_forms(counts: DataFrame) -> DataFrame:
    forms = counts.groupBy("lang", "tag", F.lower("form").alias("form")).agg(F.sum("n").alias("n"))
    return forms.groupBy("lang", "tag").agg(F.sum("n").alias("n"), F.count("*").alias("n_forms"))


@query(f"WITH {_TAGGED} SELECT lang, tag, count(*) AS n, count(DISTINCT lower(form)) AS n_forms FROM t JOIN documents USING (doc_id) GROUP BY 1, 2")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted_forms(tagger.form_counts(docs(spark, sf_dir), "lang"))


def _gram(n: int) -> str:
    shown = " || '/' || ".join(["tag", *(f"lead(tag, {k}) OVER o" for k in range(1, n))])
    return f"""
x{n} AS (SELECT doc_id, {shown} AS x FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c{n} AS (SELECT doc_id, count(*) / sum(n)::DOUBLE AS d, coalesce(sum(n) FILTER (n > 1), 0) / sum(n)::DOUBLE AS r FROM (SELECT doc_id, x, count(*) AS n FROM x{n} WHERE x IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""


_N = range(1, 7)


@query(f"""
WITH {_TAGS}, {", ".join(_gram(n) for n in _N)},
w AS (SELECT doc_id, form || '/' || tag AS w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m WHERE tag IN ('MAG', 'MAJ', 'MM')),
q AS (SELECT doc_id, sum(n - 1) / sum(n)::DOUBLE AS mass FROM (SELECT doc_id, w, count(*) AS n FROM w GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT doc_id, k - lag(k) OVER (PARTITION BY doc_id, w ORDER BY k) AS gap FROM w), b AS (SELECT doc_id, coalesce(sum(exp(-gap / 20.0)), 0) / count(*) AS burst FROM g GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1), p AS (SELECT doc_id, count(*) AS n FROM m GROUP BY 1)
SELECT d.doc_id, coalesce(s.n, 0) AS morph_count, coalesce(p.n, 0) AS pos_token_count, coalesce(q.mass, 0) AS modifier_repetition_mass, coalesce(b.burst, 0) AS modifier_repeat_burst_mass,
       {", ".join(f"coalesce(c{n}.d, 0) AS pos_{n}gram_diversity, coalesce(c{n}.r, 0) AS pos_{n}gram_repeat_rate" for n in _N)}
FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id) LEFT JOIN b USING (doc_id) {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in _N)}
""")
def tag_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = docs(spark, sf_dir).select("doc_id", tag_arrays.tag_measures(tagging.tagged(F.col("text"))).alias("m"))
    return t.select("doc_id", *[c.alias(k) for k, c in tagging.tag_metrics("m").items()])


@query(f"""
WITH {_TAGS}, w AS (SELECT doc_id, CASE WHEN starts_with(tag, 'N') THEN 'content_noun' WHEN starts_with(tag, 'V') THEN 'content_predicate' WHEN starts_with(tag, 'M') THEN 'content_modifier' END AS family, form || '/' || tag AS w FROM m WHERE tag <> 'NNP'),
c AS (SELECT doc_id, family, w, count(*) AS n FROM w WHERE family IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, family ORDER BY n) AS lo, row_number() OVER (PARTITION BY doc_id, family ORDER BY n DESC) AS hi FROM c)
SELECT doc_id, family, sum(n)::BIGINT AS token_count, coalesce(sum(n) FILTER (n > 1), 0) / sum(n)::DOUBLE AS repeat_occurrence_rate, count(*) FILTER (n = 1) / count(*)::DOUBLE AS hapax_rate, sum(n) FILTER (hi <= 10) / sum(n)::DOUBLE AS top_10_coverage,
       sum(n) FILTER (hi <= 20) / sum(n)::DOUBLE AS top_20_coverage, max(n) / sum(n)::DOUBLE AS max_frequency_rate, sum(n * n) / (sum(n) * sum(n))::DOUBLE AS simpson_concentration,
       2.0 * sum(n * lo) / (count(*) * sum(n)) - (count(*) + 1.0) / count(*) AS gini_frequency, 10000.0 * (sum(n * n) - sum(n)) / (sum(n) * sum(n))::DOUBLE AS yule_k
FROM r GROUP BY doc_id, family
""")
def tag_group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = docs(spark, sf_dir).select("doc_id", tagging.tagged(F.col("text")).alias("t"))
    groups = F.array(*[F.struct(F.lit(name).alias("family"), tagging.content(F.col("t"), starts=(start,)).alias("items")) for name, start in tagging.CONTENT_GROUPS.items()])
    t = t.select("doc_id", F.explode(groups).alias("g")).select("doc_id", "g.family", F.size("g.items").cast("long").alias("token_count"), tagging.distribution_metrics(F.col("g.items")).alias("m"))
    return t.where("token_count > 0").select("doc_id", "family", "token_count", "m.*")


@query()
def analyzed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full metric row of every document; tests hold it against plain Python."""
    d = docs(spark, sf_dir)
    return analysis.analyzed(d, ["doc_id"], tagger=tagger.train(d))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")


def usage(rows: DataFrame, human: str = "quality = 1", most: int = scorer.MOST_GRAM, model: tagger.Model | None = None) -> DataFrame:
    """Tag n-gram shares of the texts of rows(text) by side: n, key, human_p, ai_p, weight."""
    t = rows.select(F.expr(human).alias("human"), tagging.tags(tagging.unmarked((model or tagging).tagged(F.col("text")))).alias("t"))
    g = t.select("human", F.explode(tag_arrays.tag_grams(F.col("t"), most)).alias("x")).select("human", "x.*")
    of = lambda held: F.coalesce(F.sum(F.when(held, F.col("c"))), F.lit(0))
    c = g.groupBy("n", "key").agg(of(F.col("human")).alias("h"), of(~F.col("human")).alias("a"))
    total = c.groupBy("n").agg(F.sum("h").alias("h_all"), F.sum("a").alias("a_all"))
    c = c.join(F.broadcast(total), "n")  # one row for each n
    return c.select("n", "key", (F.col("h") / F.nullif("h_all", F.lit(0))).alias("human_p"), (F.col("a") / F.nullif("a_all", F.lit(0))).alias("ai_p"), F.lit(0.5).alias("weight"))


_USAGE = f"""
{_TAGS}, y AS (SELECT m.*, quality = 1 AS human FROM m JOIN labels USING (doc_id)),
u AS (SELECT n, x, count(*) FILTER (human) AS h, count(*) FILTER (NOT human) AS a FROM (
  {" UNION ALL ".join(f"SELECT '{n}' AS n, human, " + " || '/' || ".join(["tag", *(f"lead(tag, {k}) OVER o" for k in range(1, n))]) + " AS x FROM y WINDOW o AS (PARTITION BY doc_id ORDER BY i)" for n in range(1, 4))}) WHERE x IS NOT NULL GROUP BY 1, 2),
v AS (SELECT n, x, h / sum(h) OVER (PARTITION BY n) AS p, a / sum(a) OVER (PARTITION BY n) AS q FROM u)"""


@query(f"""
WITH {_USAGE},
j AS (SELECT n, sqrt(greatest(0, 0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / (0.5 * (p + q))) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / (0.5 * (p + q))) ELSE 0 END))) AS js_distance, count(*) FILTER (p > 0) AS human_types, count(*) FILTER (q > 0) AS ai_types FROM v GROUP BY n),
g AS (SELECT n, x, p - q AS gap, row_number() OVER (PARTITION BY n ORDER BY p - q DESC, x DESC) AS hi, row_number() OVER (PARTITION BY n ORDER BY q - p DESC, x DESC) AS lo FROM v)
SELECT n::INT AS n, js_distance, human_types, ai_types, string_agg(x, ' ' ORDER BY hi) FILTER (hi <= 8 AND gap > 0) AS human_high_ngrams, string_agg(x, ' ' ORDER BY lo) FILTER (lo <= 8 AND gap < 0) AS ai_high_ngrams FROM j JOIN g USING (n) GROUP BY ALL
""")
def tag_usage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reference.usage_audit(usage(_labelled(spark, sf_dir), most=3))
    names = lambda c: F.nullif(F.array_join(F.transform(c, lambda x: x["key"]), " "), F.lit(""))
    return out.select(F.col("n").cast("int").alias("n"), "js_distance", "human_types", "ai_types", names(F.col("human_high")).alias("human_high_ngrams"), names(F.col("ai_high")).alias("ai_high_ngrams"))


@query(f"""
WITH {_USAGE}, k AS (SELECT doc_id, n, x, count(*) AS c FROM (
  {" UNION ALL ".join(f"SELECT doc_id, '{n}' AS n, " + " || '/' || ".join(["tag", *(f"lead(tag, {k}) OVER o" for k in range(1, n))]) + " AS x FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY i)" for n in range(1, 4))}) WHERE x IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT doc_id, n, x, c / sum(c) OVER (PARTITION BY doc_id, n) AS r FROM k), b AS (SELECT n, sum(p) AS ps, sum(q) AS qs FROM v GROUP BY 1),
e AS (SELECT doc_id, n, r, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM r LEFT JOIN v USING (n, x)),
z AS (SELECT doc_id, n, sum(r * log2(r / (0.5 * (r + p))) + CASE WHEN p > 0 THEN p * log2(p / (0.5 * (r + p))) ELSE 0 END) - sum(p) AS jh, sum(r * log2(r / (0.5 * (r + q))) + CASE WHEN q > 0 THEN q * log2(q / (0.5 * (r + q))) ELSE 0 END) - sum(q) AS ja FROM e GROUP BY 1, 2),
w AS (SELECT doc_id, n, sqrt(greatest(0, 0.5 * (jh + ps))) AS human_distance, sqrt(greatest(0, 0.5 * (ja + qs))) AS ai_distance FROM z JOIN b USING (n))
SELECT doc_id, n, human_distance, ai_distance, greatest(-1, least(1, 0.85 * greatest(-1, least(1, 0.20 - 1.70 * human_distance)) + 0.15 * greatest(-1, least(1, (ai_distance - human_distance) / greatest(1e-6, ai_distance + human_distance)))))::DOUBLE AS score FROM w
""")
def tag_usage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = docs(spark, sf_dir).select("doc_id", tagging.tags(tagging.unmarked(tagging.tagged(F.col("text")))).alias("_tags"))
    return scorer.usage_scores(t, ["doc_id"], settled(usage(_labelled(spark, sf_dir), most=3), "usage")).select("doc_id", "n", "human_distance", "ai_distance", "score")


def style_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, tagger.Model, np.ndarray]:
    """A reference, tag usage, a lexicon, a tagger and a classifier of style, made of the labelled
    documents: by their quality, and the classifier without those it is tested on."""
    rows = _labelled(spark, sf_dir)
    model = tagger.train(rows)
    weights = classifier(rows, model)
    terms = rows.select("quality", F.explode(lexicon.feature_tokens(F.col("text"))).alias("term"))
    words = reference.lexicon(terms, F.col("quality") == 1, least=5).where("lift >= 4").select(F.lit("unigram").alias("kind"), F.lit(0).alias("skip"), F.col("term").alias("key"), F.greatest(F.lit(0.05), "weight").alias("weight"))
    words = settled(words, "lexicon")
    m = scorer.measured(rows, ["doc_id", "quality"], "text", words, model, weights).drop("_tags")
    v = settled(reference.long_form(m, ["doc_id", "quality"], [c for c in m.columns if c not in ("doc_id", "quality")]), "values")
    return settled(reference.style_reference(v, F.col("quality") == 1), "reference"), settled(usage(rows, model=model), "usage"), words, model, weights


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that the classifier never learns from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _tokens(model: tagger.Model, column: str = "text") -> list[Column]:
    t = model.tagged(F.col(column))
    return [F.transform(t, lambda x: x["form"]).alias("forms"), F.transform(t, lambda x: x["tag"]).alias("tags")]


def classifier(rows: DataFrame, model: tagger.Model) -> np.ndarray:
    """Weights that tell rows(doc_id, text, quality) of quality 1 (above 0) from the others."""
    known = rows.where(~held_out(F.col("doc_id")))
    return linear.fit(known.select("text", (F.col("quality") == 1).alias("label"), *_tokens(model)))


@query()
def style_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier's decision value of every document; above 0 as those of quality 1. Tests hold
    the values against plain Python on the same weights, and the accuracy on held-out rows."""
    rows, d = _labelled(spark, sf_dir), docs(spark, sf_dir)
    model = tagger.train(d)
    weights = classifier(rows, model)
    d = d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", *_tokens(model))
    return d.select("doc_id", "held_out", linear.decision(weights, F.col("text"), F.col("forms"), F.col("tags")).alias("value"))


@query()
def trained_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the trained tagger gives each tag, by language, and to how many forms."""
    d = docs(spark, sf_dir)
    return _counted_forms(tagger.form_counts(d, "lang", tagger.train(d)))


@query()
def trained_tag_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tag_metrics on the trained tagger's tags."""
    d = docs(spark, sf_dir)
    t = d.select("doc_id", tagger.train(d).tagged(F.col("text")).alias("t")).select("doc_id", tag_arrays.tag_measures(F.col("t")).alias("m"))
    return t.select("doc_id", *[c.alias(k) for k, c in tagging.tag_metrics("m").items()])


@query()
def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored against the labelled ones; tests hold the parts against plain Python."""
    rows = docs(spark, sf_dir).select("doc_id", "text", F.lit("generate").alias("task"), F.lit("").alias("source_text"))
    out = scorer.score_texts(rows, "doc_id", *style_tables(spark, sf_dir), required=False)
    families = [F.element_at("family_scores", f).alias(f"family_{f}") for f in ("anti_slop", "comma", "pos_4_6", "pos_3", "pos_1_2", "pos_usage", "modifier", "sentence_edge", "sentence_length", "other")]
    return out.select("doc_id", "score", "result_contract_reason", "collapse_reason", F.size("metric_scores").alias("n_metrics"), *families)


@query()
def batch_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a completion for its conversation; an assistant's turn rewrites the turn before."""
    t = table(spark, sf_dir, "conversations")
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source_text"))
    rows = t.join(before, ["conv_id", "turn"], "left").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.col("conv_id").cast("string").alias("row_id"), F.when(F.col("role") == "assistant", "rewrite").otherwise("generate").alias("task"), "text", F.when(F.col("role") == "assistant", F.col("source_text")).otherwise("").alias("source_text"))
    scored = scorer.score_texts(rows, "k", *style_tables(spark, sf_dir), required=False).join(rows.select("k", "row_id"), "k")
    quartiles = tuple(F.lit(x) for x in (0.22, 0.38, 0.52))
    out = scorer.rewards(scored, "k", quartiles, least=200, most=4000, power=0.5, shrink=(0.3, 0.04, 0.12), rewrite={"edit": 0.3, "improvement": 0.3, "families": {"comma": 0.2, "pos_4_6": 0.2}})
    return out.select("k", "row_id", "task", "failed", "contract_penalty", "length_penalty", "diversity_bonus", "valid_count", "total_count", "update_weight", "reward")


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, (CASE WHEN n < 1000 THEN -0.20 * (1 - n / 1000.0) WHEN n > 4500 THEN -0.10 * least(1, (n - 4500) / 4500.0) ELSE 0 END)::DOUBLE AS penalty FROM (SELECT doc_id, length({_STRIP.format('text')}) AS n FROM documents)")
def length_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", rewards.length_penalty(F.char_length(text.strip(F.col("text"))), 1000, 4500).cast("double").alias("penalty"))


@query(f"""
WITH {CONTRACT_REASONS}
SELECT conv_id, turn, reason, CASE reason WHEN 'ok' THEN 0 {" ".join(f"WHEN '{k}' THEN {v}" for k, v in scorer.PENALTIES.items())} ELSE {scorer.OTHER_PENALTY} END::DOUBLE AS penalty FROM q
""")
def contract_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn's text loses for the way it keeps its contract."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(CONTRACT_TEXT).alias("t"))
    t = t.withColumn("reason", F.coalesce(text.result_contract(F.col("t"))["reason"], F.lit("")))
    return t.select("conv_id", "turn", F.when(F.col("reason") == "", "ok").otherwise(F.col("reason")).alias("reason"), scorer.contract_penalty(F.col("reason")).alias("penalty"))


@query()
def smoke_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scorer.smoke_reward(F.col("text"), False, 400).alias("reward"))


@query()
def rewrite_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of how far each turn is from the one before."""
    return scorer.rewrite_reference(turn_pairs(spark, sf_dir).select(F.col("x").alias("source_text"), F.col("y").alias("reference_text")))


@query()
def edit_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rewrite.rewrite_metrics(turn_pairs(spark, sf_dir), "x", "y")
    score = scorer.rewrite_edit_score(F.col("edit_amount"), *[F.lit(None).cast("double")] * 3)
    return m.select("conv_id", "turn", "char_ratio", "tag_jaccard", "edit_amount", score.alias("edit_score"))


# Similarity and diversity of turns.

_SQL_SETS = f"""
WITH a AS (SELECT conv_id, turn, text, regexp_extract_all(lower(text), '[가-힣a-z0-9]+') AS v, {_FORMS} AS fs FROM conversations),
b AS (SELECT *, list_transform(fs, lambda f: {tagging.sql_tag("f")}) AS ts FROM a),
d AS (SELECT *, list_transform(list_filter(range(1, len(fs) + 1), lambda i: starts_with(ts[i], 'N') OR starts_with(ts[i], 'V') OR starts_with(ts[i], 'M')), lambda i: lower(fs[i])) AS ns FROM b),
t AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, length(text) - 3), lambda i: substr(text, i, 5))) AS c, list_distinct(list_transform(range(1, len(v) - 1), lambda i: v[i:i + 2])) AS w,
       list_distinct(list_transform(range(1, len(ns) - 1), lambda i: ns[i:i + 2])) AS n, list_distinct(list_transform(range(1, len(ts) - 2), lambda i: ts[i:i + 3])) AS p FROM d),
j AS (SELECT x.conv_id, x.turn, y.turn AS other, {", ".join(f"CASE WHEN len(x.{c}) + len(y.{c}) = 0 THEN 1 ELSE len(list_intersect(x.{c}, y.{c})) / (len(x.{c}) + len(y.{c}) - len(list_intersect(x.{c}, y.{c}))) END AS {c}" for c in "cwnp")}, len(x.p) + len(y.p) AS np
      FROM t x JOIN t y ON x.conv_id = y.conv_id AND x.turn <> y.turn),
p AS (SELECT conv_id, turn, other, CASE WHEN np > 0 THEN 0.30 * c + 0.25 * w + 0.25 * n + 0.20 * p ELSE 0.35 * c + 0.30 * w + 0.35 * n END AS similarity FROM j)"""


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorer.similarity(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")


@query(f"{_SQL_SETS} SELECT * FROM p")
def turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir)


@query(f"{_SQL_SETS}, m AS (SELECT conv_id, turn, avg(1 - similarity) AS d, avg(similarity) AS s FROM p GROUP BY 1, 2), r AS (SELECT *, 1 / (0.10 + s) AS q FROM m) SELECT conv_id, turn, 0.03 * greatest(-1, least(1, (d - avg(d) OVER g) / 0.55)) AS leave_one_out, 0.03 * least(1, d / 0.55) AS threshold, 0.03 * greatest(-1, least(1, q / (avg(q) OVER g) - 1)) AS density FROM r WINDOW g AS (PARTITION BY conv_id)")
def diversity_bonuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewards.diversity_bonuses(_similar(spark, sf_dir), "conv_id", "turn")


@query(f"{_SQL_SETS}, l AS (SELECT conv_id, turn, length(text) AS r FROM conversations), n AS (SELECT p.conv_id, p.turn, x.r, 1 - coalesce(max(similarity) FILTER (y.r >= x.r), max(similarity)) AS nov FROM p JOIN l x ON x.conv_id = p.conv_id AND x.turn = p.turn JOIN l y ON y.conv_id = p.conv_id AND y.turn = p.other GROUP BY 1, 2, 3) SELECT conv_id, turn, 0.03 * greatest(-1, least(1, CASE WHEN max(r) OVER g > min(r) OVER g THEN 0.25 + 0.75 * (r - min(r) OVER g) / (max(r) OVER g - min(r) OVER g) ELSE 0.5 END * (nov - avg(nov) OVER g) / 0.55)) AS bonus FROM n WINDOW g AS (PARTITION BY conv_id)")
def mmr_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").cast("double").alias("reward"))
    return rewards.mmr_bonus(_similar(spark, sf_dir), r, "conv_id", "turn")


@query("""
WITH v AS (SELECT conv_id, turn, role <> 'system' AS made, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 150 AND role <> 'system' AS ok FROM conversations)
SELECT conv_id, count(*) FILTER (ok) AS valid_count, count(*) FILTER (made) AS total_count FROM v GROUP BY 1 HAVING count(*) FILTER (made) > 0
""")
def diversity_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", F.col("conv_id").cast("string").alias("row_id"), F.col("turn").alias("k"), F.when(F.col("role") != "system", "generate").otherwise("x").alias("task"), F.lit(False).alias("failed"), F.col("text").alias("result_text"))
    return scorer.eligible(t, "k", 8, 150).where("task = 'generate'").groupBy("conv_id").agg(F.max("valid_count").alias("valid_count"), F.max("total_count").alias("total_count"))


# Lexicon features.

_FEATURES = """
f AS (SELECT doc_id, unnest(list_concat(
  list_transform(t, lambda x: 'unigram|0|' || x), list_transform(range(1, len(t)), lambda i: 'bigram|0|' || t[i] || chr(9) || t[i + 1]), list_transform(range(1, len(t) - 1), lambda i: 'skip_bigram|1|' || t[i] || chr(9) || t[i + 2]),
  list_transform(range(1, len(t) - 2), lambda i: 'skip_bigram|2|' || t[i] || chr(9) || t[i + 3]), list_transform(range(1, len(t) - 3), lambda i: 'skip_bigram|3|' || t[i] || chr(9) || t[i + 4]),
  list_transform(range(1, len(t) - 2), lambda i: 'skip_trigram|1|' || t[i] || chr(9) || t[i + 1] || chr(9) || t[i + 3]), list_transform(range(1, len(t) - 2), lambda i: 'skip_trigram|1|' || t[i] || chr(9) || t[i + 2] || chr(9) || t[i + 3]),
  list_transform(range(1, len(t) - 3), lambda i: 'skip_trigram|1|' || t[i] || chr(9) || t[i + 2] || chr(9) || t[i + 4]))) AS f FROM (SELECT doc_id, regexp_extract_all(lower(text), '[가-힣a-z0-9]+') AS t FROM documents))"""


@query(f"WITH {_FEATURES} SELECT split_part(f, '|', 1) AS kind, split_part(f, '|', 2)::INT AS skip, count(*) AS n, count(DISTINCT f) AS n_distinct FROM f GROUP BY 1, 2")
def skip_gram_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.feature_counts(docs(spark, sf_dir), []).groupBy("kind", "skip").agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"))


@query(f"""
WITH {_FEATURES}, c AS (SELECT f, count(*) FILTER (quality = 1) AS h, count(*) FILTER (quality = 0) AS a FROM f JOIN labels USING (doc_id) GROUP BY 1), s AS (SELECT sum(h) AS sh, sum(a) AS sa FROM c),
l AS (SELECT f, greatest(0.05, ln(((a + 0.5) / sa) / ((h + 0.5) / sh))) AS w FROM c, s WHERE h + a >= 5 AND ((a + 0.5) / sa) / ((h + 0.5) / sh) >= 4), n AS (SELECT doc_id, count(*) AS n FROM f GROUP BY 1)
SELECT doc_id, (sum(1000.0 * w) / any_value(n.n))::DOUBLE AS density FROM f JOIN l USING (f) JOIN n USING (doc_id) GROUP BY doc_id
""")
def lexicon_feature_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all features of a text those of a lexicon over (kind, skip, key), weighted at least 0.05."""
    sides, totals = lexicon.strong_sides(_labelled(spark, sf_dir), F.col("quality") == 1, 5, 4.0)
    found = reference.rated(sides, least=5, of=totals).where("lift >= 4")
    found = found.select("kind", "skip", "key", F.greatest(F.lit(0.05), "weight").alias("weight"))
    return lexicon.density(docs(spark, sf_dir), ["doc_id"], found).select("doc_id", F.col("anti_slop_density").alias("density"))


@query(f"""
WITH {_FEATURES}, c AS (SELECT f, count(*) FILTER (quality = 1) AS h, count(*) FILTER (quality = 0) AS a FROM f JOIN labels USING (doc_id) GROUP BY 1), s AS (SELECT sum(h) AS sh, sum(a) AS sa FROM c),
l AS (SELECT split_part(f, '|', 1) AS kind, split_part(f, '|', 2) || '|' || split_part(f, '|', 3) AS term, h, a, ((a + 0.5) / sa) / ((h + 0.5) / sh) AS lift FROM c, s WHERE h + a >= 5)
SELECT kind, term, h AS human_count, a AS ai_count FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY lift DESC, a DESC, term) AS k FROM l WHERE lift >= 2) WHERE k <= 20
""")
def lexicon_terms_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest terms of each kind of feature, which are named by skip and tokens."""
    sides, totals = lexicon.strong_sides(_labelled(spark, sf_dir), F.col("quality") == 1, 5, 2.0)
    found = reference.rated(sides, least=5, of=totals)
    found = found.withColumn("term", F.concat_ws("|", F.col("skip").cast("string"), "key"))
    return reference.top_terms(found, "kind", 20, 2.0).select("kind", "term", "human_count", "ai_count")


# Reports and audits.

_LONG = """
v AS (SELECT doc_id, quality, lang, m.metric, m.value FROM (
  SELECT doc_id, quality, lang, unnest([{'metric': 'comma_per_1k_chars', 'value': 1000.0 * (length(text) - length(replace(text, ',', ''))) / greatest(length(text), 1)},
    {'metric': 'char_len', 'value': length(text)::DOUBLE}, {'metric': 'word_len', 'value': length(text) / greatest(len(string_split(text, ' ')), 1)}]) AS m
  FROM documents JOIN labels USING (doc_id)))"""
_SUMMARY = "count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90, min(value) AS min, max(value) AS max"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.plans.group_queries import METRICS

    t = F.col("text")
    m = _labelled(spark, sf_dir).select("doc_id", "quality", "lang", text.per_1k(text.occurrences(t, ","), t).alias("comma_per_1k_chars"), F.char_length(t).alias("char_len"), (F.char_length(t) / F.greatest(F.size(F.split(t, " ")), F.lit(1))).alias("word_len"))
    return reference.long_form(m, ["doc_id", "quality", "lang"], METRICS)


@query(f"WITH {_LONG} SELECT lang AS eval_task, quality AS grp, metric, {_SUMMARY} FROM v GROUP BY 1, 2, 3")
def group_summary_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _values(spark, sf_dir).withColumnsRenamed({"lang": "eval_task", "quality": "grp"})
    return quantiles.summarized(v, ["eval_task", "grp", "metric"], "value")


@query(f"""
WITH {_LONG}, g AS (SELECT lang AS eval_task, metric, value, doc_id % 3 AS grp FROM v), n AS (SELECT eval_task, metric, grp, count(*) AS n, avg(value) AS m FROM g GROUP BY 1, 2, 3),
d AS (SELECT a.eval_task, a.metric, a.grp AS left_group, b.grp AS right_group, sum(sign(a.value - b.value)) / count(*) AS cliffs_delta FROM g a JOIN g b ON a.eval_task = b.eval_task AND a.metric = b.metric AND a.grp < b.grp GROUP BY 1, 2, 3, 4)
SELECT d.eval_task, d.metric, left_group, right_group, x.n AS left_n, y.n AS right_n, x.m AS left_mean, y.m AS right_mean, x.m - y.m AS mean_delta, cliffs_delta FROM d
JOIN n x ON x.eval_task = d.eval_task AND x.metric = d.metric AND x.grp = left_group JOIN n y ON y.eval_task = d.eval_task AND y.metric = d.metric AND y.grp = right_group WHERE x.n >= 2 AND y.n >= 2
""")
def distribution_tests_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _values(spark, sf_dir).select(F.col("lang").alias("eval_task"), "metric", "value", (F.col("doc_id") % 3).alias("grp"))
    return reference.distribution_tests(v, ["eval_task", "metric"], "grp", [(0, 1), (0, 2), (1, 2)])


@query(f"""
WITH {_LONG}, r AS (SELECT metric, quantile_cont(value, 0.1) FILTER (quality = 1) AS q10, quantile_cont(value, 0.25) FILTER (quality = 1) AS q25, quantile_cont(value, 0.75) FILTER (quality = 1) AS q75, quantile_cont(value, 0.9) FILTER (quality = 1) AS q90,
  avg(value) FILTER (quality = 1) AS h, avg(value) FILTER (quality = 0) AS a FROM v GROUP BY 1),
i AS (SELECT metric, avg((value BETWEEN q25 AND q75)::INT) AS iqr, avg((value BETWEEN q10 AND q90)::INT) AS wide FROM v JOIN r USING (metric) WHERE quality = 0 GROUP BY 1),
d AS (SELECT x.metric, sum(sign(x.value - y.value)) / count(*) AS delta FROM v x JOIN v y ON x.metric = y.metric AND x.quality = 1 AND y.quality = 0 GROUP BY 1)
SELECT metric, h - a AS human_minus_ai, CASE WHEN h - a < 0 THEN 'ai_higher' ELSE 'human_higher' END AS ai_direction, abs(delta) * (0.35 + 0.65 * greatest(0, least(1, 1 - iqr))) AS effective_weight, abs(delta) AS abs_cliffs_delta,
  CASE WHEN abs(delta) >= 0.75 AND iqr <= 0.20 THEN 'strong' WHEN abs(delta) >= 0.55 AND iqr <= 0.35 THEN 'useful' WHEN abs(delta) >= 0.35 AND wide <= 0.75 THEN 'weak_but_usable' WHEN abs(delta) >= 0.25 THEN 'weak_or_redundant' ELSE 'low_signal' END AS signal,
  CASE metric WHEN 'comma_per_1k_chars' THEN 'punctuation' ELSE 'other' END AS family
FROM r JOIN i USING (metric) JOIN d USING (metric)
""")
def reference_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _values(spark, sf_dir)
    out = reference.reference_audit(reference.style_reference(v, F.col("quality") == 1))
    return out.select("metric", "human_minus_ai", "ai_direction", "effective_weight", "abs_cliffs_delta", "signal", "family")


@query(f"""
WITH e AS (SELECT event_type AS metric, value - 50 AS value FROM events)
SELECT metric, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75, min(value) AS min, max(value) AS max, avg((value < 0)::INT) AS negative_rate FROM e GROUP BY 1
""")
def reward_sample_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference.reward_audit(table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), (F.col("value") - 50).alias("value")))


@query("""
SELECT role AS task, CASE WHEN length(text) < 40 THEN 'short' ELSE '' END AS reason, count(*) AS n, avg(length(text)) AS mean, quantile_cont(length(text), 0.5) AS median FROM conversations GROUP BY 1, 2
""")
def scored_output_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length("text")
    t = table(spark, sf_dir, "conversations").select(F.col("role").alias("task"), F.when(n < 40, "short").otherwise("").alias("reason"), n.alias("chars"))
    return quantiles.summarized(t, ["task", "reason"], "chars").select("task", "reason", "n", "mean", "median")


@query("""
WITH t AS (SELECT lang, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS a, least(1536, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS b FROM documents)
SELECT lang, max(a) AS max_before, avg(a) AS mean_before, max(b) AS max_after, avg(b) AS mean_after, count(*) FILTER (b < a) AS trimmed_rows FROM t GROUP BY lang
""")
def token_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.char_length(text.strip(F.col("text"))).cast("long")
    return reference.token_length_stats(docs(spark, sf_dir).select("lang", a.alias("before"), F.least(a, F.lit(1536)).cast("long").alias("after")), "lang")


@query("""
SELECT conv_id, sum(x)::DOUBLE AS logprob_sum, avg(x) AS logprob_mean, count(*) AS logprob_count FROM (SELECT conv_id, unnest(list_transform(range(3, len(string_split(text, ' ')) + 1), lambda i: -length(string_split(text, ' ')[i]) / 10.0)) AS x FROM conversations) GROUP BY 1
""")
def logprob_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths stand in for log-probabilities; a text's first two words are its prompt."""
    t = table(spark, sf_dir, "conversations").select("conv_id", F.transform(F.split("text", " "), lambda w: -F.char_length(w) / F.lit(10.0)).alias("l"))
    return reference.logprob_summary(t, "conv_id", "l", F.lit(2))


@query("SELECT event_type AS mode, sum(value) AS total, max(abs(value)) AS largest FROM events WHERE isfinite(value) GROUP BY 1")
def probe_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference.probe_totals(table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), F.col("value").alias("bonus")), "mode")


@query(f"""
WITH {_LONG}, c AS (SELECT lang, metric, avg(value) FILTER (quality = 1) AS h, avg(value) FILTER (quality = 0) AS a, avg(value) FILTER (doc_id % 3 = 0) AS r FROM v GROUP BY 1, 2),
g AS (SELECT lang, metric, CASE WHEN abs(a - h) > 1e-12 THEN (abs(a - h) - abs(r - h)) / abs(a - h) END AS closure, abs(a - h) AS size FROM c)
SELECT lang, metric, row_number() OVER (PARTITION BY lang ORDER BY coalesce(closure > 0, false) DESC, closure DESC NULLS LAST, size DESC, metric) AS place FROM g
""")
def report_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by improvement, closure and size of the gap; what has no closure comes last."""
    v = _values(spark, sf_dir)
    m = v.groupBy("lang", "metric").agg(F.avg(F.when(F.col("quality") == 1, F.col("value"))).alias("h"), F.avg(F.when(F.col("quality") == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("doc_id") % 3 == 0, F.col("value"))).alias("r"))
    m = m.withColumn("gap_closure", stats.gap_closure(F.col("a"), F.col("h"), F.col("r"))).withColumn("delta", F.abs(F.col("a") - F.col("h")))
    return m.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*reference.report_order("gap_closure", "delta"), "metric")).cast("long")).select("lang", "metric", "place")


@query(f"WITH {_LONG}, m AS (SELECT metric, avg(value) FILTER (quality = 0) AS source, avg(value) FILTER (quality = 1) AS output FROM v GROUP BY 1) SELECT metric, source, output, round_even(output - source, 1) AS delta FROM m")
def source_output_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _values(spark, sf_dir).groupBy("metric", "quality").agg(F.avg("value").alias("value"))
    side = lambda q, name: v.where(F.col("quality") == q).select("metric", F.col("value").alias(name))
    return side(0, "source").join(side(1, "output"), "metric").withColumn("delta", F.bround(F.col("output") - F.col("source"), 1))


@query("SELECT doc_id, metric, coalesce(text, '') AS sample FROM (SELECT doc_id, 'char_len' AS metric FROM labels) LEFT JOIN documents USING (doc_id)")
def sample_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", F.lit("char_len").alias("metric"))
    return rows.join(docs(spark, sf_dir).select("doc_id", "text"), "doc_id", "left").select("doc_id", "metric", F.coalesce("text", F.lit("")).alias("sample"))


@query(f"WITH {_LONG} SELECT metric, quality, doc_id, row_number() OVER (PARTITION BY metric, quality ORDER BY value, doc_id) - 1 AS place, avg(value) OVER (PARTITION BY metric, quality) AS mean, stddev_samp(value) OVER (PARTITION BY metric, quality) AS std FROM v")
def group_value_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's values in order, one row a value, with the group's mean and deviation."""
    v = _values(spark, sf_dir).withColumn("grp", F.concat_ws("|", "metric", F.col("quality").cast("string")))
    stat = v.groupBy("grp").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    placed = rows.numbered_within(v, "grp", "place", "value", "doc_id").join(stat, "grp")
    return placed.select("metric", "quality", "doc_id", "place", "mean", "std")
