"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCHES, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a session whose executors are threads of the
    driver may leave that unset, and uses its warehouse then."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share: intermediate tables are written there.")
    return (found or spark.conf.get("spark.sql.warehouse.dir") + "/corpusweave").rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no result that reads them is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path(spark, "")).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: one computation, a short
    lineage, and files that outlive any executor."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of at most BATCH_ROWS rows for the rest of the session: a
    batch lies in the executor's and in the worker's memory at once, for every running task."""
    now = int(spark.conf.get(BATCHES))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(BATCHES, str(BATCH_ROWS))


def text_bytes(docs: DataFrame) -> int:
    """The bytes of all texts, by which data is dealt out in parts of bounded size."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
