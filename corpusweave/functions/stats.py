"""Scalar scores of metrics against reference statistics, and group effect sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of metric families.
FAMILY_WEIGHTS = {
    "anti_slop": 0.42,
    "translationese": 0.32,
    "comma": 0.22,
    "pos_4_6": 0.36,
    "pos_3": 0.12,
    "pos_1_2": 0.02,
    "pos_usage": 0.16,
    "modifier": 0.08,
    "sentence_edge": 0.04,
    "sentence_length": 0.025,
    "other": 0.05,
}


def finite(value: Column, default: float | None = None) -> Column:
    """The value as a finite double, or the default."""
    x = value.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(F.coalesce(x, F.lit(default)))


def clip(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ramp_up(x: Column, low: float, high: float) -> Column:
    return F.when(x <= low, 0.0).when(x >= high, 1.0).otherwise((x - low) / (high - low))


def ramp_down(x: Column, low: float, high: float, floor: float = 0.0) -> Column:
    return F.when(x <= low, 1.0).when(x >= high, floor).otherwise(1.0 - (1.0 - floor) * (x - low) / (high - low))


def _span(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(1e-9), b - a)


def band_score(x: Column, q10: Column, q25: Column, q50: Column, q75: Column, q90: Column, iqr: Column, mean: Column | None = None) -> Column:
    """1 inside the quartiles, falling to 0 at the outer deciles and below 0 beyond them; with
    missing quantiles, by the distance from the median, for which the mean stands in."""
    q50 = q50 if mean is None else F.coalesce(q50, mean)
    spread = F.when(iqr.isNull() | (iqr <= 1e-9), F.when(q50.isNull(), 1.0).otherwise(F.greatest(F.abs(q50) * 0.10, F.lit(1e-6)))).otherwise(iqr)
    return (
        F.when(x.isNull(), None)
        .when(x.between(q25, q75), 1.0)
        .when((x < q25) & (x >= q10), clip((x - q10) / _span(q10, q25)))
        .when((x < q25) & q10.isNotNull(), clip(-F.least(F.lit(1.0), (q10 - x) / _span(q10, q25))))
        .when((x > q75) & (x <= q90), clip((q90 - x) / _span(q75, q90)))
        .when((x > q75) & q90.isNotNull(), clip(-F.least(F.lit(1.0), (x - q90) / _span(q75, q90))))
        .when(q50.isNotNull(), clip(1.0 - F.abs(x - q50) / F.greatest(F.lit(1e-9), spread)))
    )


def banded_reward(x: Column, q10: Column, q25: Column, q50: Column, q75: Column, q90: Column, iqr: Column, mean: Column | None = None) -> Column:
    """Weak inside the quartiles, strong outside the outer deciles."""
    q50 = q50 if mean is None else F.coalesce(q50, mean)
    middle = F.greatest(F.lit(1e-9), q75 - q25, F.abs(q50) * 0.05, F.lit(1e-6))
    whole = q10.isNotNull() & q25.isNotNull() & q50.isNotNull() & q75.isNotNull() & q90.isNotNull()
    return (
        F.when(x.isNull(), None)
        .when(~whole, band_score(x, q10, q25, q50, q75, q90, iqr))
        .when(x.between(q25, q75), clip(0.22 - 0.10 * F.abs(x - q50) / middle, 0.08, 0.22))
        .when((x >= q10) & (x < q25), clip(-0.42 * (q25 - x) / _span(q10, q25), -0.42, 0.0))
        .when((x > q75) & (x <= q90), clip(-0.42 * (x - q75) / _span(q75, q90), -0.42, 0.0))
        .when(x < q10, clip(-0.42 - 0.58 * F.least(F.lit(1.0), (q10 - x) / _span(q10, q25)), -1.0, -0.42))
        .otherwise(clip(-0.42 - 0.58 * F.least(F.lit(1.0), (x - q90) / _span(q75, q90)), -1.0, -0.42))
    )


def away_score(x: Column, near: Column, far: Column) -> Column:
    """-1 at the far mean, 1 at the near mean, clipped."""
    gap = near - far
    return F.when(F.abs(gap) < 1e-9, 0.0).otherwise(clip(2.0 * (x - far) / F.nullif(gap, F.lit(0.0)) - 1.0))


def metric_score(band: Column, away: Column) -> Column:
    """The band and the away score, 0.90 to 0.10 (the latter at a quarter), of those that exist."""
    return F.when(band.isNotNull() & away.isNotNull(), clip(0.90 * band + 0.10 * 0.25 * away)).when(band.isNotNull(), clip(band)).when(away.isNotNull(), clip(0.25 * away))


def separation_weight(weight: Column, inside: Column) -> Column:
    base = F.abs(F.coalesce(weight, F.lit(1.0)))
    return F.greatest(F.lit(0.0), base * F.when(inside.isNull(), 1.0).otherwise(0.35 + 0.65 * (1.0 - clip(inside, 0.0, 1.0))))


def metric_family(name: Column) -> Column:
    return (
        F.when(name == "anti_slop_density", "anti_slop")
        .when(name == "translationese_raw", "translationese")
        .when(name.startswith("comma_"), "comma")
        .when(F.rlike(name, F.lit("^pos_[456]gram")), "pos_4_6")
        .when(name.startswith("pos_3gram"), "pos_3")
        .when(name.startswith("pos_"), "pos_1_2")
        .when(name.contains("modifier"), "modifier")
        .when(name.startswith("sentence_initial") | name.startswith("sentence_final"), "sentence_edge")
        .when(name.startswith("sentence_length"), "sentence_length")
        .otherwise("other")
    )


def effect_label(delta: Column) -> Column:
    d = F.abs(delta)
    return F.when(d >= 0.474, "large").when(d >= 0.33, "medium").when(d >= 0.147, "small").otherwise("negligible")


def closure_status(closure: Column) -> Column:
    return F.when(closure > 0.05, "improved").when(closure < -0.05, "worse").otherwise("small")


def gap_closure(base: Column, target: Column, moved: Column) -> Column:
    gap = F.abs(base - target)
    return F.when(gap <= 1e-12, None).otherwise((gap - F.abs(moved - target)) / F.nullif(gap, F.lit(0.0)))


def cliffs_delta(df: DataFrame, value: str, left: Column, by: list[str]) -> DataFrame:
    """Cliff's delta of rows where `left` holds against the others, by group: by ranks of distinct
    values, so neither pairs nor whole groups of rows meet in one task."""
    n = df.select(*by, F.col(value).cast("double").alias("_x"), left.alias("_left")).where(F.col("_x").isNotNull() & F.col("_left").isNotNull())
    at = n.groupBy(*by, "_x").agg(F.count_if("_left").alias("a"), F.count_if(~F.col("_left")).alias("b"))
    below = Window.partitionBy(*by).orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("below", F.coalesce(F.sum("b").over(below), F.lit(0)))
    out = at.groupBy(*by).agg(F.sum("a").alias("left_n"), F.sum("b").alias("right_n"), F.sum(F.col("a") * (2 * F.col("below") + F.col("b"))).alias("u2"))
    pairs = F.col("left_n").cast("double") * F.col("right_n")
    return out.select(*by, "left_n", "right_n", F.when(pairs > 0, F.col("u2") / pairs - 1.0).alias("cliffs_delta"))
