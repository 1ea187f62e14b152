"""Joins by key and by position over whole tables."""

from pyspark.sql import functions as F

from corpusweave.plans import queries as plans

SF = "/root/testdata/sf0.001"


def test_all_documents_are_paired(spark):
    ids = sorted(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    labels = sorted(r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id").collect())
    got = {r["doc_id"]: (r["paired"], r["by_key"]) for r in plans.QUERIES["positional_label_fallback"](spark, SF).collect()}
    at = dict(enumerate(labels))
    assert got == {d: (d, True) if d in set(labels) else (at.get(i), False) for i, d in enumerate(ids)}
    assert {d % 2 for d in got} == {0, 1} and {k for _, k in got.values()} == {True, False}


def test_all_documents_are_looked_up(spark):
    found = plans.QUERIES["label_lookup"](spark, SF).groupBy("found", (F.col("doc_id") % 2).alias("odd")).count().collect()
    assert len(found) == 4 and sum(r["count"] for r in found) == spark.read.parquet(f"{SF}/documents.parquet").count()
