"""Streams with state give what the same rows give as a table, also over restarts from a checkpoint."""

import math
import random

from pyspark.sql import functions as F

from corpusweave.streaming import events

KIND = "at timestamp, text string, grp string, reward double"


def arriving(seed=1, n=60):
    rng = random.Random(seed)
    return [(k, rng.choice(["a", "A ", "b", "c", "d"]) + str(k // 30), rng.choice("xyz"), rng.choice([float("nan"), None, rng.random()])) for k in range(n)]


def fed(spark, folder, rows):
    """The rows as one more file of a folder."""
    df = spark.createDataFrame([(None, *r[1:], r[0]) for r in rows], KIND + ", s long")
    df.withColumn("at", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(folder)


def test_first_of_each(spark, tmp_path):
    rows, folder = arriving(), str(tmp_path / "in")
    key = F.lower(F.trim("text"))
    for k in range(0, 60, 15):  # a new start for each part
        fed(spark, folder, rows[k : k + 15])
        stream = events.first_of_each(spark.readStream.schema(KIND).parquet(folder), key, "at")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    key_of = lambda df: sorted(r["k"] for r in df.select(key.alias("k")).collect())
    table = events.first_of_each(spark.read.schema(KIND).parquet(folder), key, "at")
    out = spark.read.schema(KIND).parquet(str(tmp_path / "out"))
    assert key_of(out) == key_of(table) == sorted({r[1].strip().lower() for r in rows})
    order = {r[0]: k for k, r in enumerate(rows)}
    part = lambda r: order[int(r["at"].timestamp())] // 15
    first = {r["text"].strip().lower(): part(r) for r in table.collect()}
    assert {r["text"].strip().lower(): part(r) for r in out.collect()} == first


def test_running_means(spark, tmp_path):
    rows, folder = arriving(2), str(tmp_path / "in")
    for k in range(0, 60, 20):
        fed(spark, folder, rows[k : k + 20])
        stream = spark.readStream.schema(KIND).parquet(folder)
        events.follow_means(stream, "grp", "reward", str(tmp_path / "means"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        got = {r["step"]: (r["n"], r["mean"]) for r in spark.read.schema("step string, n long, mean double").parquet(str(tmp_path / "means")).collect()}
        want = {r["grp"]: (r["n"], r["mean"]) for r in events.running_means(spark.read.schema(KIND).parquet(folder), "grp", "reward").collect()}
        assert got.keys() == want.keys()
        assert all(got[g][0] == want[g][0] and math.isclose(got[g][1], want[g][1]) for g in want)
