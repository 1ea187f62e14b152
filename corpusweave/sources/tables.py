"""Tables of a data folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Texts of a batch that goes to Python, some MB with what is made of them, and its bytes where texts are long.
BATCHES, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500
SIZES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Send texts to Python in batches of at most so many rows and bytes for the rest of the session (one
    longer text is a batch; a size that the session has set stays). A batch lies in the executor's and in the worker's memory at once, for
    every running task; with larger ones that memory grows with the rows of a task, up to 10,000, and
    with the length of its texts."""
    now = int(spark.conf.get(BATCHES))
    if now <= 0 or now > rows:
        spark.conf.set(BATCHES, str(rows))
    if spark.conf.get(SIZES, None) is None:
        spark.conf.set(SIZES, str(size))


def spread(df: DataFrame) -> DataFrame:
    """The rows of df for all cores: rows of fewer files than there are cores are dealt out, as a small
    file is one task however much work its rows are. More files stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


#: Bytes of text and rows of a part whose words, or pairs with a few hundred texts, one task holds at once.
PART_BYTES, PART_ROWS = 8 << 20, 2048


def dealt(df: DataFrame, key: str, size: int = PART_BYTES, rows: int = PART_ROWS) -> DataFrame:
    """The rows of df(key, text) dealt out by key in parts of about so many bytes of text and rows, at least
    one for each core. The number of parts grows with df and their size doesn't, whatever the number
    of shuffle partitions is and however many of them Spark would put together."""
    n_bytes, n_rows = df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // size), -(-n_rows // rows)), key)


def _settled_dir(spark: SparkSession) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    return f"{(top or spark.conf.get('spark.sql.warehouse.dir') + '/corpusweave').rstrip('/')}/settled-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete this application's settled tables, once no result that reads them is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_settled_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a table that later steps read instead of computing it again. It is written to the folder
    of spark.checkpoint.dir, which the driver and all executors share, or, where executors are
    threads of the driver and that is unset, to the warehouse; it outlives any executor. clear() deletes
    all tables of an application."""
    spark = df.sparkSession
    path = f"{_settled_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
