"""Quantiles and positions of groups of any size against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusweave.operators import quantiles, rows
from corpusweave.sources import tables

WANTED = (0.5, 0.0, 0.1, 0.25, 1.0, 0.999)


def grouped(seed=3):
    rng = random.Random(seed)
    out = [("big", rng.choice([rng.gauss(0, 1), float(rng.randrange(5)), rng.random() * 1e12])) for _ in range(3000)]
    out += [("one", 7.5), (None, 1.0), (None, 2.0), ("same", 3.0), ("same", 3.0), ("none", None), ("wide", -1.7e308), ("wide", 1.7e308), ("wide", 0.0), ("tiny", 5e-324), ("tiny", 0.0), ("tiny", 1.0)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("cell", "parts"), [(10_000, 1024), (3, 4), (1, 2)])
def test_quantiles(spark, cell, parts):
    data = grouped() if cell > 1 else [x for x in grouped() if x[0] != "big"] + [("big", float(k % 17)) for k in range(200)]
    df = spark.createDataFrame(data, "g string, v double").repartition(4)
    got = {r["g"]: r for r in quantiles.quantiles(df, ["g"], "v", WANTED, cell, parts).collect()}
    values = {}
    for g, v in data:
        if v is not None:
            values.setdefault(g, []).append(v)
    assert got.keys() == values.keys()
    for g, v in values.items():
        assert got[g]["n"] == len(v)
        v = sorted(v)
        for q, x in zip(WANTED, got[g]["q"], strict=True):
            at = (len(v) - 1) * q
            low, high = v[int(np.floor(at))], v[int(np.ceil(at))]
            with np.errstate(over="ignore"):
                np.testing.assert_allclose(x, low + (high - low) * (at - np.floor(at)), rtol=1e-12)


def test_quantiles_of_a_table(spark):
    df = spark.range(1001).select((F.col("id") * 2).alias("v"))
    assert quantiles.quantiles(df, [], "v", (0.5, 0.1)).collect()[0].asDict() == {"n": 1001, "q": [1000.0, 200.0]}
    assert quantiles.quantiles(df.where("v < 0"), [], "v", (0.5,)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_positions(spark, n):
    rng = random.Random(n)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(10**6), k) for k in range(n)]
    df = spark.createDataFrame(data, "g string, x long, k long").repartition(5)
    want = {}
    for g in {d[0] for d in data}:
        want |= {k: i for i, (_, k) in enumerate(sorted((x, k) for h, x, k in data if h == g))}
    got = rows.numbered_within(df, "g", "i", "x", "k")
    assert got.columns == ["g", "x", "k", "i"]
    assert {r["k"]: r["i"] for r in got.collect()} == want
    whole = {k: i for i, (_, k) in enumerate(sorted((x, k) for _, x, k in data))}
    assert {r["k"]: r["i"] for r in rows.numbered(df, "i", "x", "k").collect()} == whole


def test_quotas_beyond_the_limit_before_the_shuffle(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("kind"))
    got = {r["kind"]: r["count"] for r in rows.quota_mix(df, "kind", {"a": 5, "b": 1500}, "id", 1).groupBy("kind").count().collect()}
    assert got == {"a": 5, "b": 1500}
    same = [{r["id"] for r in rows.quota_mix(df, "kind", {"a": a, "b": 10}, "id", 1).where(F.col("kind") == "b").collect()} for a in (5, 1500)]
    assert same[0] == same[1]


def test_settled_tables_can_be_cleared(spark, tmp_path):
    df = tables.settled(spark.range(3), "x")
    folder = df.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    import os

    assert os.path.isdir(folder)
    tables.clear(spark)
    assert not os.path.isdir(folder)
