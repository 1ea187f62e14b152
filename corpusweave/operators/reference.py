"""Style references and lexicons from two groups of texts, composites and reports over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corpusweave.functions.stats import away_score, banded_reward, cliffs_delta, gap_closure, metric_family, metric_score, separation_weight
from corpusweave.operators.quantiles import quantiles, summarized
from corpusweave.sources.tables import settled


def long_form(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Finite values as rows (keys, metric, value)."""
    out = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, metrics, "metric", "value")
    return out.where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('infinity')")


def style_reference(values: DataFrame, human: Column) -> DataFrame:
    """Per metric of values(metric, value): quantiles and mean of the rows where `human` holds, mean
    of the others, their share within the first group's quartiles and deciles, Cliff's delta, and
    a weight (its size)."""
    v = values.withColumn("_human", human)
    q = quantiles(v.where("_human"), ["metric"], "value", (0.1, 0.25, 0.5, 0.75, 0.9)).select("metric", F.col("q").alias("_q"))
    ref = v.groupBy("metric").agg(F.avg(F.when(F.col("_human"), F.col("value"))).alias("human_mean"), F.avg(F.when(~F.col("_human"), F.col("value"))).alias("ai_mean"))
    ref = ref.join(q, "metric", "left").select("metric", *[F.get("_q", k).alias(f"human_{n}") for k, n in enumerate(("q10", "q25", "q50", "q75", "q90"))], "human_mean", "ai_mean")
    ref = ref.withColumn("human_iqr", F.col("human_q75") - F.col("human_q25"))
    bounds = F.broadcast(ref.select("metric", "human_q10", "human_q25", "human_q75", "human_q90"))  # one row per metric
    inside = v.where(~F.col("_human")).join(bounds, "metric").groupBy("metric").agg(
        F.avg(F.col("value").between(F.col("human_q25"), F.col("human_q75")).cast("double")).alias("ai_in_human_iqr_rate"),
        F.avg(F.col("value").between(F.col("human_q10"), F.col("human_q90")).cast("double")).alias("ai_in_human_q10_q90_rate"),
    )
    delta = cliffs_delta(v, "value", F.col("_human"), ["metric"]).withColumnRenamed("cliffs_delta", "cliffs_delta_human_vs_ai")
    return ref.join(inside, "metric", "left").join(delta.select("metric", "cliffs_delta_human_vs_ai"), "metric", "left").withColumn("weight", F.abs("cliffs_delta_human_vs_ai"))


def scored(values: DataFrame, reference: DataFrame) -> DataFrame:
    """values(.., metric, value) with each metric's score, family and weight."""
    r = values.join(F.broadcast(reference), "metric")
    q = [F.col(f"human_{n}") for n in ("q10", "q25", "q50", "q75", "q90", "iqr")]
    score = metric_score(banded_reward(F.col("value"), *q), away_score(F.col("value"), F.col("human_mean"), F.col("ai_mean")))
    return r.withColumn("score", score).withColumn("family", metric_family(F.col("metric"))).withColumn("metric_weight", separation_weight(F.col("weight"), F.col("ai_in_human_iqr_rate")))


def composites(values: DataFrame, human: Column, key: str, groups: dict[str, list[str]]) -> DataFrame:
    """Of values(key, metric, value), by key and group of metrics (part): how many metrics it has, and
    the mean of their places between the first kind's mean (0) and the others' (1), clipped and raw.
    Metrics whose means are the same say nothing."""
    v = values.withColumn("_human", human)
    m = v.groupBy("metric").agg(F.avg(F.when(F.col("_human"), F.col("value"))).alias("h"), F.avg(F.when(~F.col("_human"), F.col("value"))).alias("a")).where("abs(a - h) > 1e-9")
    parts = F.explode(F.array(*[F.struct(F.lit(g).alias("part"), F.lit(name).alias("metric")) for g, names in groups.items() for name in names]))
    m = m.join(values.sparkSession.range(1).select(parts.alias("x")).select("x.*"), "metric")  # a row for each metric and group
    axis = (F.col("value") - F.col("h")) / (F.col("a") - F.col("h"))
    found = v.join(F.broadcast(m), "metric").groupBy(key, "part")
    return found.agg(F.count("*").alias("metric_count"), F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), axis))).alias("ai_likeness"), F.avg(axis).alias("ai_likeness_raw"))


def closures(values: DataFrame, base: Column, target: Column, moved: Column) -> DataFrame:
    """Per metric: the three groups' means and how far `moved` closes base's gap to target."""
    m = values.groupBy("metric").agg(F.avg(F.when(base, F.col("value"))).alias("base_mean"), F.avg(F.when(target, F.col("value"))).alias("target_mean"), F.avg(F.when(moved, F.col("value"))).alias("moved_mean"))
    return m.withColumn("gap_closure", gap_closure(F.col("base_mean"), F.col("target_mean"), F.col("moved_mean")))


def lexicon(tokens: DataFrame, human: Column, least: int = 2, eps: float = 0.5, by: tuple[str, ...] = ("term",), n: str | None = None) -> DataFrame:
    """Terms of tokens(*by), of which each row stands for n: counts by group and lift, the ratio of smoothed rates per 1,000 (ours
    to define; the weight is its logarithm). The terms are counted and written once; the totals of both
    groups, which include terms that are too rare, are observed on the way."""
    times = F.col(n) if n else F.lit(1)
    of = lambda held: F.coalesce(F.sum(F.when(held, times)), F.lit(0))
    c = tokens.withColumn("_human", human).groupBy(*by).agg(of(F.col("_human")).alias("human_count"), of(~F.col("_human")).alias("ai_count"))
    return rated(c, least, eps)


def rated(c: DataFrame, least: int = 2, eps: float = 0.5, of: tuple[int, int] | None = None) -> DataFrame:
    """lexicon() of terms that are counted: each once, with human_count and ai_count. `of` has the totals
    of both groups where c lacks terms."""
    totals = Observation()
    c = c.observe(totals, F.sum("human_count").alias("h"), F.sum("ai_count").alias("a"))
    out = settled(c.where(F.col("human_count") + F.col("ai_count") >= least), "terms")
    n_of = dict(zip("ha", of, strict=True)) if of else totals.get
    rate = lambda n, total: 1000.0 * (F.col(n) + eps) / max(n_of[total] or 0, 1)
    return out.withColumn("lift", rate("ai_count", "a") / rate("human_count", "h")).withColumn("weight", F.ln("lift"))


def top_terms(terms: DataFrame, kind: str | None, k: int, least_lift: float) -> DataFrame:
    order = [F.desc("weight"), F.desc("ai_count"), "term"]
    kept = terms.where(F.col("lift") >= least_lift)
    if kind is None:
        return kept.orderBy(*order).limit(k)
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def bootstrap_closure(values: DataFrame, group: str, key: str, rounds: int = 300, seed: int = 17) -> DataFrame:
    """The 2.5 and 97.5 percentiles of the gap closure over resamples by Poisson weights, seeded by
    a hash of key and round. Sums are by round, so rows spread over all tasks."""
    weights = F.sequence(F.lit(0), F.lit(rounds - 1))
    u = (F.pmod(F.xxhash64(F.lit(seed), key, "round"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    w = F.when(u < 0.36788, 0).when(u < 0.73576, 1).when(u < 0.91970, 2).when(u < 0.98101, 3).when(u < 0.99634, 4).otherwise(5)
    r = values.select("metric", group, key, "value", F.explode(weights).alias("round")).withColumn("w", w)
    mean = lambda g: F.sum(F.when(F.col(group) == g, F.col("value") * F.col("w"))) / F.nullif(F.sum(F.when(F.col(group) == g, F.col("w"))), F.lit(0))
    m = r.groupBy("metric", "round").agg(mean("ai").alias("a"), mean("human").alias("h"), mean("rewrite").alias("m"))
    q = F.percentile(gap_closure(F.col("a"), F.col("h"), F.col("m")), F.array(F.lit(0.025), F.lit(0.975)))
    return m.groupBy("metric").agg(q.alias("q")).select("metric", F.get("q", 0).alias("low"), F.get("q", 1).alias("high"))


def distribution_tests(values: DataFrame, by: list[str], group: str, pairs: list[tuple]) -> DataFrame:
    """Of each pair of groups of values(by, group, value): sizes, means, their difference and Cliff's
    delta, where both have two values at least."""
    m = values.groupBy(*by, group).agg(F.count("value").alias("n"), F.avg("value").alias("m"))
    out = None
    for a, b in pairs:
        delta = cliffs_delta(values.where(F.col(group).isin(a, b)), "value", F.col(group) == a, by).select(*by, "cliffs_delta")
        side = lambda g, name: m.where(F.col(group) == g).select(*by, F.col("n").alias(f"{name}_n"), F.col("m").alias(f"{name}_mean"))
        part = delta.join(side(a, "left"), by).join(side(b, "right"), by).where("left_n >= 2 AND right_n >= 2")
        kind = values.schema[group].dataType
        part = part.select(*by, F.lit(a).cast(kind).alias("left_group"), F.lit(b).cast(kind).alias("right_group"), "left_n", "right_n", "left_mean", "right_mean", (F.col("left_mean") - F.col("right_mean")).alias("mean_delta"), "cliffs_delta")
        out = part if out is None else out.unionByName(part)
    return out


def audit_family(name: Column) -> Column:
    """The families of an audit, which are others than those of scores."""
    return (
        F.when(name.isin("anti_slop", "translationese"), name)
        .when(F.rlike(name, F.lit("^(comma|parenthes[ie]s)")), "punctuation")
        .when(name.startswith("pos_") & F.rlike(name, F.lit("diversity|entropy")), "pos_diversity_entropy")
        .when(name.startswith("pos_") & name.contains("repeat"), "pos_recurrence")
        .when(name.startswith("pos_"), "pos")
        .when(name.startswith("content_modifier"), "modifier_shape")
        .when(name.startswith("content_"), "content_lexical")
        .when(F.rlike(name, F.lit("^sentence_(initial|final)")), "sentence_edge")
        .when(name.startswith("sentence_length"), "sentence_rhythm")
        .otherwise("other")
    )


def signal_label(delta: Column, in_iqr: Column, in_deciles: Column) -> Column:
    """How well a metric parts two groups, by its effect and the overlap; unknown without values."""
    return (
        F.when(delta.isNull() | in_iqr.isNull() | in_deciles.isNull(), "unknown")
        .when((delta >= 0.75) & (in_iqr <= 0.20), "strong")
        .when((delta >= 0.55) & (in_iqr <= 0.35), "useful")
        .when((delta >= 0.35) & (in_deciles <= 0.75), "weak_but_usable")
        .when(delta >= 0.25, "weak_or_redundant")
        .otherwise("low_signal")
    )


def reference_audit(reference: DataFrame) -> DataFrame:
    """A style reference with gap, direction, effective weight, family and signal, the heaviest
    first."""
    gap, size = F.col("human_mean") - F.col("ai_mean"), F.abs("cliffs_delta_human_vs_ai")
    out = reference.withColumns({
        "family": audit_family(F.col("metric")),
        "human_minus_ai": gap,
        "ai_direction": F.when(gap < 0, "ai_higher").otherwise("human_higher"),
        "abs_cliffs_delta": size,
        "effective_weight": separation_weight(F.col("weight"), F.col("ai_in_human_iqr_rate")),
        "signal": signal_label(size, F.col("ai_in_human_iqr_rate"), F.col("ai_in_human_q10_q90_rate")),
    })
    return out.orderBy(F.desc_nulls_last("effective_weight"), F.desc_nulls_last("abs_cliffs_delta"), "metric")


def usage_audit(usage: DataFrame, top: int = 8) -> DataFrame:
    """Of usage(n, key, human_p, ai_p): the Jensen-Shannon distance and the number of keys by n, and
    the `top` keys that each side uses more, with their gaps."""
    h, a = F.coalesce("human_p", F.lit(0.0)), F.coalesce("ai_p", F.lit(0.0))
    part = lambda x, y: F.when(x > 0, x * F.log2(x / (0.5 * (x + y)))).otherwise(0.0)
    whole = usage.groupBy("n").agg(F.sqrt(F.greatest(F.lit(0.0), 0.5 * F.sum(part(h, a) + part(a, h)))).alias("js_distance"), F.count_if(h > 0).alias("human_types"), F.count_if(a > 0).alias("ai_types"))

    def high(gap: Column, name: str) -> DataFrame:
        # The limit is applied before the shuffle, so a task sends `top` keys at most.
        ranked = usage.withColumn("gap", gap).where("gap > 0").withColumn("k", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("gap"), F.desc("key")))).where(F.col("k") <= top)
        return ranked.groupBy("n").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "key", "gap"))), lambda x: F.struct(x["key"].alias("key"), x["gap"].alias("gap"))).alias(name))

    return whole.join(high(h - a, "human_high"), "n", "left").join(high(a - h, "ai_high"), "n", "left")


def reward_audit(samples: DataFrame) -> DataFrame:
    """Of samples(metric, value): count, mean, quartiles, extremes and the share below 0."""
    some = samples.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    negative = some.groupBy("metric").agg(F.avg((F.col("value") < 0).cast("int")).alias("negative_rate"))
    out = summarized(some, ["metric"], "value").join(negative, "metric")
    return out.select("metric", "n", "mean", "median", "p25", "p75", "min", "max", "negative_rate")


def sample_overview(rows: DataFrame) -> DataFrame:
    """Of a reward log's rows (post_result_chars, text_truncated): how many there are, and with text
    behind the result or a cut text, with their shares."""
    post, cut = F.coalesce("post_result_chars", F.lit(0)) > 0, F.coalesce("text_truncated", F.lit(False))
    return rows.agg(F.count("*").alias("rows"), F.count_if(post).alias("post_result_rows"), F.avg(post.cast("int")).alias("post_result_rate"), F.count_if(cut).alias("text_truncated_rows"), F.avg(cut.cast("int")).alias("text_truncated_rate"))


#: The numbers of a stored comparison.
DIAGNOSTICS = ("latest", "ai_mean", "human_mean", "latest_minus_ai", "latest_minus_human", "latest_percentile_in_ai", "latest_percentile_in_human", "human_p25", "human_p50", "human_p75")


def diagnostics(documents: DataFrame) -> DataFrame:
    """The comparison of stored diagnostics, documents(comparison: array of JSON strings), by metric;
    what isn't an object is left out, what isn't a number is null."""
    kind = "metric string, " + ", ".join(f"{c} double" for c in DIAGNOSTICS)
    rows = documents.select(F.explode("comparison").alias("x")).where(F.rlike(F.trim("x"), F.lit(r"(?s)^\{.*\}$"))).select(F.from_json("x", kind).alias("d"))
    return rows.where("d IS NOT NULL").select("d.*")


def token_length_stats(rows: DataFrame, by: str) -> DataFrame:
    """Largest and mean token counts of rows(by, before, after), and how many rows were cut."""
    return rows.groupBy(by).agg(F.max("before").alias("max_before"), F.avg("before").alias("mean_before"), F.max("after").alias("max_after"), F.avg("after").alias("mean_after"), F.count_if(F.col("after") < F.col("before")).alias("trimmed_rows"))


def logprob_summary(rows: DataFrame, key: str, logprobs: str, prompt: Column) -> DataFrame:
    """Sum, mean and number of the finite log-probabilities behind the prompt's."""
    x = rows.select(key, F.explode(F.slice(logprobs, prompt + 1, F.greatest(F.size(logprobs) - prompt, F.lit(0)))).alias("x")).where("x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')")
    return x.groupBy(key).agg(F.sum("x").alias("logprob_sum"), F.avg("x").alias("logprob_mean"), F.count("*").alias("logprob_count"))


def probe_totals(rows: DataFrame, by: str) -> DataFrame:
    """The sum and the largest size of the finite bonuses of each mode."""
    some = rows.where(F.col("bonus").isNotNull() & ~F.isnan("bonus") & (F.abs("bonus") < float("inf")))
    return some.groupBy(by).agg(F.sum("bonus").alias("total"), F.max(F.abs("bonus")).alias("largest"))


def report_order(closure: str, delta: str) -> list[Column]:
    """Improved metrics first, then by closure and size of the effect; what isn't a number is last."""
    c = F.when(~F.isnan(closure), F.col(closure))
    return [F.coalesce(c > 0, F.lit(False)).desc(), c.desc_nulls_last(), F.desc_nulls_last(delta)]
