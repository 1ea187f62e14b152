"""Steps that the fifth session of findings replaced."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusweave.functions import tagging
from corpusweave.operators import scorer
from corpusweave.plans.text_queries import multiset_overlap
from corpusweave.sources.tables import BATCH_BYTES, SIZES, bounded_batches, dealt


def test_long_texts_go_to_python_in_batches_of_bounded_bytes(spark):
    spark.conf.unset(SIZES)
    bounded_batches(spark)
    texts = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("é"), 500_000).alias("text"))
    size = F.arrow_udf(lambda x: pa.array([x.nbytes] * len(x)), "long")(F.col("text"))
    assert texts.select(size.alias("n")).agg(F.max("n")).first()[0] <= 2 * BATCH_BYTES
    spark.conf.set(SIZES, "123456")
    bounded_batches(spark)
    assert spark.conf.get(SIZES) == "123456"
    spark.conf.unset(SIZES)


def test_gram_sets_of_turns_are_made_by_arrays(spark, tmp_path):
    texts = ["one two three four five six one two three", None, "", "abcd", "One, two three four five SIX!", "ÀÉ 가나 다라 마바 사아 x😀yz", "x😀yz"]
    rows = [(k % 3, k, texts[k % len(texts)]) for k in range(60)]
    spark.createDataFrame(rows, "g long, i long, text string").repartition(3).write.parquet(f"{tmp_path}/turns")
    out = scorer.similarity(spark.read.parquet(f"{tmp_path}/turns"), "g", "i")
    got = {(r["g"], r["i"], r["other"]): r["similarity"] for r in out.collect()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "array_union" not in plan and "xxhash64" not in plan
    assert set(got) == {(g, i, j) for g, i, _ in rows for h, j, _ in rows if g == h and i != j}

    def sets(t):
        forms = re.findall(tagging.TOKEN, t or "")
        words, tags = re.findall("[가-힣a-z0-9]+", (t or "").lower()), [tagging.word_tag(f) for f in forms]
        content = [f.lower() for f, x in zip(forms, tags, strict=True) if x[0] in "NVM"]
        return [{tuple(a[k : k + n]) for k in range(len(a) - n + 1)} for a, n in ((t or "", 5), (words, 3), (content, 3), (tags, 4))]

    def want(a, b):
        x, y = sets(a), sets(b)
        c, w, n, p = (len(u & v) / len(u | v) if u | v else 1.0 for u, v in zip(x, y, strict=True))
        return 0.30 * c + 0.25 * w + 0.25 * n + 0.20 * p if x[3] | y[3] else 0.35 * c + 0.30 * w + 0.35 * n

    assert got == pytest.approx({(g, i, j): want(texts[i % len(texts)], texts[j % len(texts)]) for g, i, j in got})


def test_texts_are_dealt_out_in_parts_of_bounded_size(spark):
    cores = spark.sparkContext.defaultParallelism
    long = spark.range(100).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 200_000).alias("text"))
    short = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    for d, parts in ((long, 12), (short, 20), (long.limit(1), cores)):
        assert dealt(d, "doc_id").rdd.getNumPartitions() == max(cores, parts)
    out = multiset_overlap(long.union(spark.createDataFrame([(0, "one"), (200, None)], "doc_id long, text string")), items)
    got = {r["doc_id"]: (r["jaccard"], r["containment"]) for r in out.collect()}
    assert got == {k: (1 / (200_001 if k == 0 else 200_000), 1.0) for k in range(100)}
    # Spark may put small parts of an exchange of its own together, up to what no longer fits a task.
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
