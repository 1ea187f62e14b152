"""Token counts of documents in flat, unindexed token files, by a separator scan.

A flat file is a sequence of blocks of little-endian token ids in which only an end id separates
documents. Each block is searched for the end id with one vectorised comparison; documents that
cross blocks are stitched by a prefix scan over one small row per block, in two steps: among
GROUP_BLOCKS neighbouring blocks, and among the groups of a file. What is open at a block's start is
the sum of the tails since the last block that held a separator. No block is read twice and no file
needs an index.

write_token_blocks() also notes which document is a file's n-th; names() reads these notes, and they
are joined to what the scan found by file and ordinal.

Defined cases: an empty document is two neighbouring separators and counts 0; ids after a file's
last separator form a last row with `terminated` false; empty blocks and empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusweave.llm import tokens
from corpusweave.llm.store import bounded_batches, table_path, written

BLOCK_TOKENS = 1 << 16
#: Blocks whose rows one step of the prefix scan sorts together; documents of one note.
GROUP_BLOCKS, NOTE_DOCS = 4096, 4096
BLOCKS = "file string, block long, width int, data binary"
#: What a partition writes: blocks, and notes (doc_ids from the file's ordinal `block` on).
WRITTEN = BLOCKS + ", doc_ids array<long>"


def _flatten(path: str, block_tokens: int, width: int):
    kind = f"<u{width}"

    def rows(name: str, first: int, data: list[bytes] | None = None, ids: list[int] | None = None) -> pa.RecordBatch:
        n = 1 if data is None else len(data)
        cols = {"file": [name] * n, "block": range(first, first + n), "width": pa.array([width] * n, pa.int32()), "data": pa.array(data or [None], pa.binary()), "doc_ids": pa.array([ids] * n, pa.list_(pa.int64()))}
        return pa.RecordBatch.from_pydict(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([max(tokens.vocabulary(path).special.values())], kind)
        name = f"part-{TaskContext.get().partitionId():08d}"
        held, size, block, noted = [], 0, 0, 0
        docs: list[int | None] = []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                held += [tokens.encode(path, text.as_py() or "", added=False).astype(kind), end]
                size += len(held[-2]) + 1
                docs.append(doc_id)
                if len(docs) == NOTE_DOCS:
                    yield rows(name, noted, ids=docs)
                    noted, docs = noted + len(docs), []
                if size >= 16 * block_tokens:
                    flat = np.concatenate(held)
                    whole = size // block_tokens
                    yield rows(name, block, [flat[k * block_tokens : (k + 1) * block_tokens].tobytes() for k in range(whole)])
                    held, size, block = [flat[whole * block_tokens :]], size - whole * block_tokens, block + whole
        if docs:
            yield rows(name, noted, ids=docs)
        if size:
            flat = np.concatenate(held)
            yield rows(name, block, [flat[k : k + block_tokens].tobytes() for k in range(0, size, block_tokens)])

    return run


def write_token_blocks(docs: DataFrame, path: str | None = None, block_tokens: int = BLOCK_TOKENS, name: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """Write docs(doc_id, text) as flat token files into the shared folder: one file for each
    partition, as a table of its blocks, and apart from them which document is a file's n-th. The
    blocks (file, block, width, data) and the names (file, ordinal, doc_id)."""
    path = path or tokens.default_path()
    spark = docs.sparkSession
    bounded_batches(spark)
    width = 2 if tokens.vocabulary(path).size <= 1 << 16 else 4
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_flatten(path, block_tokens, width), WRITTEN)
    to = table_path(spark, name)
    flat.write.option("compression", "zstd").parquet(to)
    out = spark.read.schema(WRITTEN).parquet(to)
    notes = out.where("data IS NULL").select("file", "block", F.posexplode("doc_ids").alias("k", "doc_id"))
    return out.where("data IS NOT NULL").drop("doc_ids"), notes.select("file", (F.col("block") + F.col("k")).alias("ordinal"), "doc_id")


def read_token_files(spark: SparkSession, path: str, width: int, block_tokens: int = BLOCK_TOKENS, range_blocks: int = 256) -> DataFrame:
    """The blocks of raw binary token files of any size. Spark lists the files; each task opens its
    ranges of `range_blocks` blocks by their offsets, in stores that pyarrow reaches."""
    step = block_tokens * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name, first, length in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "length")), strict=True):
                store, place = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name)
                with store.open_input_file(place) as f:
                    for block in range(first, min(first + range_blocks, -(-length // step))):
                        data = f.read_at(min(step, length - block * step), block * step)
                        yield pa.RecordBatch.from_pydict({"file": [name], "block": pa.array([block], pa.int64()), "width": pa.array([width], pa.int32()), "data": pa.array([data], pa.binary())})

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("length", F.lit(1)) - 1) / step), F.lit(range_blocks).cast("long"))).alias("first"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(parts, "path", "first").mapInArrow(run, BLOCKS)


def _scan(end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, seps, tails = [], [], []
            for width, data in zip(batch.column("width").to_pylist(), batch.column("data"), strict=True):
                ids = np.frombuffer(data.as_buffer() or b"", f"<u{width}") if data.is_valid else np.zeros(0, np.int32)
                at = np.flatnonzero(ids == end_id)
                lengths.append(np.diff(at, prepend=-1) - 1)
                seps.append(len(at))
                tails.append(len(ids) - 1 - (at[-1] if len(at) else -1))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(seps, pa.int64()), pa.array(tails, pa.int64()), pa.array(lengths, pa.list_(pa.int64()))], names=["file", "block", "seps", "tail", "lengths"])

    return run


def _before(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """rows(seps, tail) with what the rows before hold: first (their separators), all (the sum of
    their tails) and carry (the tails since the last row with a separator)."""
    ahead = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("first", F.coalesce(F.sum("seps").over(ahead), zero)).withColumn("all", F.coalesce(F.sum("tail").over(ahead), zero))
    # `all` grows, so its largest value at a separator is the last one.
    return rows.withColumn("carry", F.col("all") - F.coalesce(F.max(F.when(F.col("seps") > 0, F.col("all"))).over(ahead), zero))


def count_tokens(blocks: DataFrame, end_id: int, names: DataFrame | None = None) -> DataFrame:
    """Documents found in blocks(file, block, width, data): file, ordinal (from 0 in the file),
    doc_id (by names(file, ordinal, doc_id); null without them), n_tokens without the end id,
    terminated."""
    found = written(blocks.mapInArrow(_scan(end_id), "file string, block long, seps long, tail long, lengths array<long>"), "found")
    small = found.select("file", "block", "seps", "tail", F.floor(F.col("block") / GROUP_BLOCKS).alias("part"))
    inner = _before(small, ["file", "part"], "block")
    last = F.coalesce(F.max(F.when(F.col("seps") > 0, F.col("all"))), F.lit(0))
    parts = inner.groupBy("file", "part").agg(F.sum("seps").alias("seps"), (F.sum("tail") - last).alias("tail"))
    parts = _before(parts, ["file"], "part")
    outer = parts.select("file", "part", F.col("first").alias("first0"), F.col("carry").alias("carry0"))
    starts = inner.join(outer, ["file", "part"]).select(
        "file", "block", (F.col("first0") + F.col("first")).alias("first"), (F.col("carry") + F.when(F.col("first") > 0, F.lit(0)).otherwise(F.col("carry0"))).alias("carry")
    )
    docs = found.where("seps > 0").select("file", "block", "lengths").join(starts, ["file", "block"]).select("file", "first", "carry", F.posexplode("lengths").alias("k", "n"))
    docs = docs.select("file", (F.col("first") + F.col("k")).alias("ordinal"), (F.col("n") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("terminated"))
    ends = parts.groupBy("file").agg(F.max_by(F.struct((F.col("first") + F.col("seps")).alias("ordinal"), (F.col("tail") + F.when(F.col("seps") > 0, F.lit(0)).otherwise(F.col("carry"))).alias("n_tokens")), "part").alias("e"))
    docs = docs.unionByName(ends.select("file", "e.ordinal", "e.n_tokens", F.lit(False).alias("terminated")).where("n_tokens > 0"))
    docs = docs.withColumn("doc_id", F.lit(None).cast("long")) if names is None else docs.join(names, ["file", "ordinal"], "left")
    return docs.select("file", "ordinal", "doc_id", "n_tokens", "terminated")
