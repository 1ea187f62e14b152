"""Word overlap with the benchmark, over all words of two or more characters."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusweave.plans import queries as plans
from corpusweave.plans.text_queries import multiset_overlap


def by_force(docs, items, cut=0.5):
    def tally(rows):
        out = {}
        for key, t in rows:
            out.setdefault(key, Counter()).update(w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) >= 2)
        return out

    out = {}
    for i, x in tally(docs).items():
        for j, y in tally(items).items():
            k, n, m = (x & y).total(), x.total(), y.total()
            if k and k >= cut * min(n, m):
                out[i, j] = (k / (n + m - k), k / min(n, m))
    return out


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_short_words_count(spark, tmp_path, threshold):
    rng = random.Random(9)
    words = ["a", "to", "be", "or", "not", "The", "cat", "sat", "on", "mats", "elephant", "umbrella", "42", "é"]
    docs = [(k % 70, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for k in range(80)] + [(900, "to be or not to be"), (901, "a é a")]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for k in range(12)] + [(50, "To be, or not to be!")]
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        spark.createDataFrame(rows, f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = plans.QUERIES["multiset_overlap_all_words"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    assert {(r["doc_id"], r["item_id"]): (r["jaccard"], r["containment"]) for r in got} == by_force(docs, items)
    assert (900, 50) in by_force(docs, items)
    assert multiset_overlap(*(spark.createDataFrame([], f"{k} long, text string").select(k, F.col("text")) for k in ("doc_id", "item_id"))).isEmpty()
