"""Streams of events and of reward logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.operators.rows import keep_first
from corpusweave.sources.tables import settled


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and means of events(ts, event_type, value) by tumbling window; works on streams (with
    a watermark) and on tables."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)  # watermarks need a zoned type
    out = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "mean_value")


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A folder as a stream; a file counts once it is there, whole (writers rename into place)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(folder)


def append_by_batch(stream: DataFrame, path: str, checkpoint: str):
    """Write each micro-batch to a folder of its own, so that a retried batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def upsert_steps(rows: DataFrame, path: str, key: str = "metric") -> None:
    """Write rows(step, key, ..) to a log by step. What the log has of a (step, key) is replaced, its
    other rows stay; so a repeated batch leaves one row for each. Only the steps of `rows` are rewritten."""
    spark = rows.sparkSession
    new = rows.dropDuplicates(["step", key])
    try:
        old = spark.read.schema(rows.schema).parquet(path).join(new.select("step").distinct(), "step", "left_semi").select(*rows.columns)
        new = new.unionByName(old.join(new.select("step", key), ["step", key], "left_anti"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new = settled(new, "steps")  # what it reads is what it overwrites
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(path)


def log_steps(stream: DataFrame, path: str, checkpoint: str, key: str = "metric"):
    """A stream of metrics by step, upserted into a log in each micro-batch."""
    return stream.writeStream.foreachBatch(lambda batch, _: upsert_steps(batch, path, key)).option("checkpointLocation", checkpoint)


def ready_folders(spark: SparkSession, folder: str, marker: str = "_READY") -> list[str]:
    """The subfolders of a folder that hold a marker file, which writers put there last, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    found = path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path(f"{folder}/*/{marker}"))
    return sorted(x.getPath().getParent().toString() for x in (found or []))


def first_of_each(rows: DataFrame, key: Column, at: str, late: str = "1 hour") -> DataFrame:
    """The first arrival of each key, by which a stream keeps one of equal texts: a key is remembered
    until the watermark has left its first time by `late`, so state doesn't grow with the stream. On a
    table, the earliest row of each key."""
    if not rows.isStreaming:
        return keep_first(rows, key, at)
    return rows.withColumn("_key", key).withWatermark(at, late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def running_means(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Count and mean of a value by group; a stream in update mode gives a group's new row whenever it
    changes. What isn't finite is left out."""
    some = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    return some.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def follow_means(stream: DataFrame, by: str, value: str, path: str, checkpoint: str):
    """Keep a table of running_means() of a stream: a group has one row, its latest."""

    def put(batch: DataFrame, _: int) -> None:
        upsert_steps(batch.withColumnRenamed(by, "step").withColumn("metric", F.lit(value)), path)

    return running_means(stream, by, value).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
