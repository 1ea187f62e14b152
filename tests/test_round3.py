"""What the findings of the third round ask for."""

import math
import time

import duckdb
import pyarrow as pa
from pyarrow import parquet
from pyspark.sql import functions as F

from corpusweave.functions import tagging, text
from corpusweave.operators import lexicon, scorer, tagger
from corpusweave.plans import queries as plans
from corpusweave.plans.text_queries import docs


def test_prompt_numbers_of_five_digits(spark, tmp_path):
    t = duckdb.sql("SELECT i AS conv_id, 0 AS turn, 'user' AS role, 'text ' || i AS text FROM range(10_050) r(i)").to_arrow_table()
    parquet.write_table(t, tmp_path / "conversations.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS FROM '{tmp_path}/conversations.parquet'")
    want = set(duckdb.sql(plans.SQL["normalized_prompts"]).fetchall())
    got = plans.QUERIES["normalized_prompts"](spark, str(tmp_path)).select("id", "task", "source_text").collect()
    assert {tuple(r) for r in got} == want and len(want) == 10_050


def test_texts_go_to_python_in_bounded_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    most = F.arrow_udf(lambda x: pa.array([len(x)] * len(x)), "long")(F.col("text"))
    assert docs(spark, "/root/testdata/sf0.01").coalesce(1).select(most.alias("n")).agg(F.max("n")).first()[0] <= 500


def test_form_counts(spark):
    rows = spark.createDataFrame([("a", "The cat, the CAT"), (None, "the"), ("a", None), ("b", "")], "lang string, text string")
    got = {(r["lang"], r["tag"], r["form"]): r["n"] for r in tagger.form_counts(rows, "lang").groupBy("lang", "tag", "form").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert got == {("a", "MM", "The"): 1, ("a", "MM", "the"): 1, ("a", "NNG", "cat"): 1, ("a", "NNG", "CAT"): 1, ("a", "SP", ","): 1, (None, "MM", "the"): 1}
    assert tagging.word_tag("The") == "MM"


def test_usage_scores_keep_texts_where_they_are(spark):
    """No exchange of a text's n-grams by n-gram: keys that all texts have would meet in one task."""
    usage = spark.createDataFrame([("1", "NNG", 0.5, 0.25, 0.5), ("1", "VV", 0.5, 0.75, 0.5)], "n string, key string, human_p double, ai_p double, weight double")
    texts = spark.createDataFrame([(1, ["NNG", "NNG", "VV", "JKB"]), (2, [])], "k int, _tags array<string>")
    out = scorer.usage_scores(texts, ["k"], usage)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Window" not in plan
    found = out.collect()
    part = lambda p, q: p * math.log2(p / (0.5 * (p + q))) if p else 0.0
    want = (0.5 * sum(part(p, q) + part(q, p) for p, q in ((0.5, 0.5), (0.25, 0.5), (0.25, 0.0)))) ** 0.5
    assert [(r["k"], r["n"]) for r in found] == [(1, "1")] and abs(found[0]["human_distance"] - want) < 1e-12


def test_budget_trim_reads_the_start_of_a_text(spark):
    """A text far over the budget takes no longer than its start, whatever follows."""
    start, t = "One. Two words. " * 200, F.col("text")
    rows = spark.createDataFrame([(start + "Three. " * 300_000,), (" \n" * 4000 + "a" * 20 + " \n x. \n" * 4000,)], "text string")
    began = time.monotonic()
    long, blank = [r[0] for r in rows.coalesce(1).select(text.budget_trimmed(t, 1536, 256)).collect()]
    assert time.monotonic() - began < 20
    assert long == ("One.Two words." * 200)[: 1536 - 1536 % 14 + 4] and blank.startswith("a" * 20) and len(blank) <= 1536


def test_features_of_all_batches_meet_once(spark):
    """Each feature is one row of feature_counts(), counted over all batches and tasks, and goes through one exchange."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    rows = spark.range(3000).select((F.col("id") % 2).alias("g"), F.concat(F.lit("same five words every time "), F.col("id").cast("string")).alias("text")).repartition(4)
    found = lexicon.feature_counts(rows, []).collect()
    assert len({(r["kind"], r["skip"], r["key"]) for r in found}) == len(found)
    n = {(r["kind"], r["key"]): r["n"] for r in found}
    assert n["unigram", "same"] == n["bigram", "every\ttime"] == n["skip_trigram", "same\tfive\tevery"] == 3000 and n["unigram", "17"] == 1
    sides = lexicon.feature_sides(rows.withColumn("g", F.when(F.col("text") != "same five words every time 3", F.col("g"))), F.col("g") == 1)
    assert {(r["human_count"], r["ai_count"]) for r in sides.where("key = 'same'").collect()} == {(1499, 1500)}
    assert sides._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
