"""Deduplication, positional joins, samples and mixes over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.functions.text import fingerprint, text_of
from corpusweave.sources.tables import settled


def keep_first(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key. The rank limit is applied before the shuffle, so a key that many
    rows share costs one row a task."""
    at = Window.partitionBy("_key").orderBy(*order)
    return df.withColumn("_key", key).withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_key", "_n")


def keep_first_text(df: DataFrame, *order: str, text: str = "text", window: int = 1800) -> DataFrame:
    return keep_first(df, fingerprint(text_of(F.col(text)), window), *order)


def _ranged(df: DataFrame, *order: str) -> DataFrame:
    """Rows dealt out by ranges of an order, with their range as _part. They are written, as what reads
    them twice has to find every row in the same range; bounds are drawn anew each time."""
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return settled(df.repartitionByRange(int(parts), *order).withColumn("_part", F.spark_partition_id()), "ranged")


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Rows with their position from 0 in a total order: ranges are numbered by themselves and
    offset by the counts of the ranges before, so no task orders all rows."""
    ranged = _ranged(df, *order)
    within = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    offsets = sizes.select("_part", (F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_offset"))
    return within.join(offsets, "_part").withColumn(name, F.col("_offset") + F.col("_k") - 1).drop("_part", "_k", "_offset")


def numbered_within(df: DataFrame, by: str, name: str, *order: str) -> DataFrame:
    """Rows with their position from 0 within their group, for groups of any size: like numbered(), by
    ranges of group and order, so a large group is spread over many tasks."""
    ranged = _ranged(df, by, *order)
    within = ranged.withColumn("_k", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order)))
    sizes = ranged.groupBy(by, "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = sizes.select(F.col(by).alias("_by"), F.col("_part").alias("_at"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    out = within.join(offsets, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_at")))
    return out.withColumn(name, F.col("_offset") + F.col("_k") - 1).drop("_part", "_k", "_offset", "_by", "_at")


def modulo_join(left: DataFrame, right: DataFrame, left_order: str, right_order: str, n: int) -> DataFrame:
    """Row i of left with row i mod n of right, both by position; n is right's size."""
    a = numbered(left, "_i", left_order).withColumn("_slot", F.pmod("_i", F.lit(n)))
    b = numbered(right, "_slot", right_order)
    return a.join(b, "_slot").drop("_i", "_slot")


def hash_order(df: DataFrame, key: Column, seed: int) -> DataFrame:
    """The rows in the order of a salted SHA-256 of their key, then the key."""
    return df.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256), key)


def hash_sample(df: DataFrame, key: Column, share: float, seed: int) -> DataFrame:
    """The rows with the lowest salted SHA-256, rounded half-even to a share of all."""
    k = round(df.count() * share)
    return df.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256)).orderBy("_h").limit(k).drop("_h")


def quota_mix(df: DataFrame, kind: str, quotas: dict[str, int], key: str, seed: int) -> DataFrame:
    """At most a quota of rows of each kind, chosen by a salted hash."""
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)
    at = Window.partitionBy(kind).orderBy("_h", key)
    most = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    some = df.where(F.col(kind).isin(list(quotas))).withColumn("_h", h)
    # Below the largest quota, a task sends that many rows of a kind at most; larger quotas need the long way.
    largest = max(quotas.values(), default=0)
    if largest <= 1000:
        ranked = some.withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= largest)
    else:
        ranked = numbered_within(some, kind, "_n", "_h", key).withColumn("_n", F.col("_n") + 1)
    return ranked.where(F.col("_n") <= most[F.col(kind)]).drop("_h", "_n")


def round_robin(df: DataFrame, kind: str, weights: dict[str, int], *order: str) -> DataFrame:
    """Rows with cycle and slot such that each cycle takes weights[kind] rows of each kind in the
    weights' order. Kinds without a weight take no part."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    first = F.create_map(*[F.lit(x) for k in weights for x in (k, sum(v for q, v in list(weights.items())[: list(weights).index(k)]))])
    out = numbered_within(df.where(F.col(kind).isin(list(weights))), kind, "_n", *order).withColumn("_w", w[F.col(kind)])
    return out.withColumn("cycle", F.floor(F.col("_n") / F.col("_w"))).withColumn("slot", first[F.col(kind)] + F.pmod("_n", "_w")).drop("_n", "_w")


def alternate(df: DataFrame, kind: str, kinds: list[str], *order: str) -> DataFrame:
    """Rows with turn (their place within their kind) and lane (the kind's place), the order in
    which kinds take turns."""
    lane = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(kind)) - 1
    return numbered_within(df.where(F.col(kind).isin(kinds)), kind, "turn", *order).withColumn("lane", lane)
