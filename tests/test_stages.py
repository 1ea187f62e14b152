"""Line numbers across splits, nested values that aren't finite, resumable stages and the step log."""

import json

import pytest
from pyspark.sql import functions as F

from corpusweave.operators.stages import Stages, content_fingerprint
from corpusweave.sources import files
from corpusweave.streaming import events


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "100", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_of_a_file_in_many_splits(spark, tmp_path, small_splits):
    lines = [json.dumps({"id": k, "x": "é" * (k % 40)}, ensure_ascii=False) if k % 7 else "" for k in range(300)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "b.jsonl").write_text("one\r\ntwo\n\nfour", encoding="utf-8")
    assert spark.read.text(str(tmp_path / "a.jsonl")).rdd.getNumPartitions() > 20
    got = sorted((r["path"].rpartition("/")[2], r["line"], r["value"]) for r in files.read_lines(spark, str(tmp_path)).collect())
    assert got == [("a.jsonl", k, x) for k, x in enumerate(lines, 1)] + [("b.jsonl", k, x) for k, x in enumerate(["one", "two", "", "four"], 1)]


@pytest.mark.parametrize(("bad", "error"), [("{'a': 1}", "invalid JSON"), ("[1]", "expected object, got array"), ('"x"', "expected object, got string"), ("12", "expected object, got number"), ("null", "expected object, got null"), ('{"id": 1', "invalid JSON")])
def test_the_first_bad_line_is_named(spark, tmp_path, small_splits, bad, error):
    lines = [json.dumps({"id": k}) for k in range(200)]
    lines[150], lines[180] = "  " + bad, bad
    (tmp_path / "a.jsonl").write_text("\n".join(lines), encoding="utf-8")
    with pytest.raises(ValueError, match=rf"a\.jsonl:151: {error}$"):
        files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id int", located=True)
    (tmp_path / "a.jsonl").write_text("\n".join(lines[:150] + ["", " \t"]), encoding="utf-8")
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id int", located=True).count() == 150


def test_nested_values_that_are_not_finite(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    row = (1, nan, [1.0, inf], {"a": nan, "b": 2.0}, (nan, [(inf, 1.5)]), None)
    kind = "k int, x double, l array<double>, m map<string,double>, s struct<y:double,z:array<struct<u:double,v:double>>>, n struct<w:double>"
    files.write_jsonl(spark.createDataFrame([row], kind), str(tmp_path / "o"))
    text = "".join(p.read_text() for p in (tmp_path / "o").glob("part-*"))
    assert "NaN" not in text and "Infinity" not in text
    back = spark.read.schema(kind).json(str(tmp_path / "o")).first().asDict(True)
    assert back == {"k": 1, "x": None, "l": [1.0, None], "m": {"a": None, "b": 2.0}, "s": {"y": None, "z": [{"u": None, "v": 1.5}]}, "n": None}


def test_content_fingerprints(spark):
    rows = [(1, "a", [1, 2]), (2, None, None), (2, None, None)]
    df = spark.createDataFrame(rows, "a int, b string, c array<int>")
    same = df.repartition(3).select("c", "b", "a")
    assert content_fingerprint(df) == content_fingerprint(same)
    others = [df.distinct(), df.withColumn("a", F.col("a") + 1), df.withColumnRenamed("a", "d"), df.withColumn("a", F.col("a").cast("long"))]
    assert len({content_fingerprint(x) for x in [df, *others]}) == 5


def test_only_what_changed_is_computed_again(spark, tmp_path):
    a, b = spark.range(5).toDF("x"), spark.range(3).toDF("x")

    def recipe(first, second, factor):
        s = Stages(spark, str(tmp_path / "recipe"))
        doubled = s.run("scaled", lambda t, by: t.select((F.col("x") * by).alias("x")), {"t": first}, by=factor)
        both = s.run("joined", lambda t, u: t.union(u), {"t": doubled, "u": second})
        total = s.run("total", lambda t: t.agg(F.sum("x").alias("n")), {"t": both})
        return s.ran, total.first()["n"], s.finished()

    every = ["scaled", "joined", "total"]
    assert recipe(a, b, 2) == (every, 23, sorted(every))
    assert recipe(a.repartition(4), b, 2)[:2] == ([], 23)
    assert recipe(a, b.limit(2), 2)[:2] == (["joined", "total"], 21)
    assert recipe(a, b, 3)[:2] == (every, 33)
    assert recipe(a, b, 2)[:2] == ([], 23)
    assert recipe(a.withColumn("x", F.lit(0).cast("long")), b, 5)[0] == every
    assert recipe(a.withColumn("x", F.lit(0).cast("long")), b, 7)[0] == ["scaled"]  # the same zeros


def test_a_failed_stage_leaves_no_marker(spark, tmp_path):
    s, df = Stages(spark, str(tmp_path / "r")), spark.range(3)
    with pytest.raises(Exception, match="broken"):
        s.run("x", lambda t: t.select(F.raise_error(F.lit("broken")).alias("a")), {"t": df})
    assert s.finished() == []
    assert s.run("x", lambda t: t, {"t": df}).count() == 3 and s.ran == ["x"]


def test_a_repeated_batch_leaves_one_row_for_each_step(spark, tmp_path):
    path, kind = str(tmp_path / "log"), "step long, metric string, value double"
    log = lambda: {(r["step"], r["metric"]): r["value"] for r in spark.read.schema(kind).parquet(path).collect()}
    first = spark.createDataFrame([(1, "loss", 0.5), (1, "reward", 1.0), (2, "loss", 0.4)], kind)
    for _ in range(2):
        events.upsert_steps(first, path)
        assert spark.read.parquet(path).count() == 3
    events.upsert_steps(spark.createDataFrame([(2, "loss", 0.3), (2, "reward", 2.0), (3, "loss", 0.1)], kind), path)
    assert log() == {(1, "loss"): 0.5, (1, "reward"): 1.0, (2, "loss"): 0.3, (2, "reward"): 2.0, (3, "loss"): 0.1}


def test_stream_into_the_step_log(spark, tmp_path):
    kind = "step long, metric string, value double"
    for k in range(3):
        spark.createDataFrame([(k, "loss", float(k)), (k + 1, "loss", -1.0)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        events.log_steps(stream, str(tmp_path / "log"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["step"], r["value"]) for r in spark.read.schema(kind).parquet(str(tmp_path / "log")).collect())
    assert got == [(0, 0.0), (1, 1.0), (2, 2.0), (3, -1.0)]


def test_ready_folders(spark, tmp_path):
    for name, done in (("b", True), ("a", True), ("c", False)):
        (tmp_path / name).mkdir()
        if done:
            (tmp_path / name / "_READY").write_text("")
    assert [x.rpartition("/")[2] for x in events.ready_folders(spark, str(tmp_path))] == ["a", "b"]
