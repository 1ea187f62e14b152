"""Stages of a recipe that are computed once for the same inputs and arguments.

A stage's result lies in a folder named by a fingerprint of its name, its arguments and the contents of
its inputs. A marker file is written behind the result, by one rename; a rerun reads what has a marker and
computes only what changed, or what a failure left without one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "_stage.json"


def content_fingerprint(df: DataFrame) -> str:
    """A fingerprint of a table's columns and rows, in any order and partitioning: the rows' number and
    the sums of two hashes of each. Rows of a map are hashed by their JSON."""
    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("r"))
    sums = rows.agg(F.count("*"), *(F.sum(F.xxhash64(F.lit(seed), "r").cast("decimal(38,0)")) for seed in (1, 2))).first()
    return hashlib.sha256(json.dumps([sorted(df.dtypes), [str(x) for x in sums]]).encode()).hexdigest()


class Stages:
    """Runs stages below a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.ran: list[str] = []
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def run(self, name: str, compute: Callable[..., DataFrame], inputs: dict[str, DataFrame], **arguments) -> DataFrame:
        """compute(**inputs, **arguments) as a table, from an earlier run if nothing has changed. The
        arguments are values that JSON can hold; `ran` lists the stages that were computed."""
        noted = {"stage": name, "arguments": arguments, "inputs": {k: content_fingerprint(v) for k, v in sorted(inputs.items())}}
        where = f"{self.folder}/{name}/{hashlib.sha256(json.dumps(noted, sort_keys=True).encode()).hexdigest()[:32]}"
        if not self._files.exists(self._path(f"{where}/{MARKER}")):
            compute(**inputs, **arguments).write.mode("overwrite").parquet(f"{where}/data")
            self._mark(where, noted)
            self.ran.append(name)
        return self.spark.read.parquet(f"{where}/data")

    def _mark(self, where: str, noted: dict) -> None:
        out = self._files.create(self._path(f"{where}/.{MARKER}"), True)
        out.write(bytearray(json.dumps(noted, ensure_ascii=False, indent=2).encode()))
        out.close()
        self._files.rename(self._path(f"{where}/.{MARKER}"), self._path(f"{where}/{MARKER}"))

    def finished(self) -> list[str]:
        """The stages that have a result, by name."""
        found = self._files.globStatus(self._path(f"{self.folder}/*/*/{MARKER}"))
        return sorted({x.getPath().getParent().getParent().getName() for x in (found or [])})
