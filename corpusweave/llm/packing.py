"""Best-fit decreasing packing of token sequences into windows of a fixed length.

A document's ids (with an end id) are first cut into full windows, each a sequence of its own. The
remainders are dealt out to shards by a hash, as many as hold about `shard_bytes` of text each, and
each shard packs its remainders, longest first: a segment tree indexed by remaining capacity finds
the tightest open window that still has room, else a new one opens. Nothing is dropped and every id
lies in exactly one piece.

Defined cases: a null or empty text has only the end id; rows with equal doc_id are packed one by
one; an empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm import tokens
from corpusweave.llm.store import bounded_batches, text_bytes

WINDOW = 1024
END_ID = 0
#: Text of a shard, which is one task's table. The ids of a text take about as many bytes.
SHARD_BYTES = 16 << 20
#: Values that a batch's rows get in turn, so that equal rows go to several shards.
SALTS = 1 << 16
NO_ID = -(1 << 63)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """A segment tree over remaining capacities 1..size; each leaf holds its open windows."""

    def __init__(self, size: int) -> None:
        self.leaves = 1
        while self.leaves < size + 1:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        if capacity <= 0:
            return
        self.open[capacity].append(window)
        k = self.leaves + capacity
        while k:
            self.count[k] += 1
            k >>= 1

    def tightest(self, need: int) -> int:
        """The smallest capacity of an open window that is at least `need`, or -1."""
        count, k = self.count, self.leaves + need
        if count[k]:
            return need
        while k > 1:
            if not k & 1 and count[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if count[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return -1

    def take(self, capacity: int) -> int:
        k = self.leaves + capacity
        while k:
            self.count[k] -= 1
            k >>= 1
        return self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset there of each length; lengths are between 1 and `window`."""
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = CapacityTree(window), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        left = tree.tightest(need) if need < window else -1
        if left < 0:
            at, left = opened, window
            opened += 1
        else:
            at = tree.take(left)
        place[k], offset[k] = at, window - left
        tree.add(left - need, at)
    return place, offset


def _pieces(path: str, window: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows: list[tuple] = []
                blobs: list[bytes] = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    ids = np.concatenate([tokens.encode(path, text.as_py() or ""), end])
                    data = ids.tobytes()
                    for start in range(0, len(ids), window):
                        part = data[4 * start : 4 * (start + window)]
                        rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), len(ids)))
                        if keep_ids:
                            blobs.append(part)
                cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                cols.append(pa.array(np.arange(len(rows)) % SALTS))
                yield pa.RecordBatch.from_arrays(cols + [pa.array(blobs, pa.binary())] * keep_ids, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"] + ["ids"] * keep_ids)

    return run


def _place(window: int):
    def run(table: pa.Table) -> pa.Table:
        length, doc, start, crc = (table.column(c).combine_chunks().fill_null(NO_ID).to_numpy() for c in ("length", "doc_id", "start", "ids_crc32"))
        order = np.lexsort((crc, start, doc, -length))  # ids stay where they are
        place, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        place[order], offset[order] = best_fit_decreasing(length[order], window)
        shard = table.column("shard")[0].as_py() if table.num_rows else 0
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array(place + (shard << 32))).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, keep_ids: bool = False) -> DataFrame:
    """The pieces of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id
    and offset; with keep_ids also ids, the piece's ids as little-endian unsigned 32-bit values."""
    path = path or tokens.default_path()
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = max(1, -(-text_bytes(docs) // shard_bytes))
    kind = PIECES + ", ids binary" * keep_ids
    pieces = docs.mapInArrow(_pieces(path, window, end_id, keep_ids), PIECES + ", salt long" + ", ids binary" * keep_ids)
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), F.lit(shards))).drop("salt")
    return pieces.groupBy("shard").applyInArrow(_place(window), f"{kind}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pack(..., keep_ids=True): sequence_id, n_tokens,
    pieces (doc_id, start, length, offset) in order, and ids, the joined binary ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    out = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p"))
    return out.select(
        "sequence_id",
        "n_tokens",
        F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"), x["offset"].alias("offset"))).alias("pieces"),
        F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"),
    )
