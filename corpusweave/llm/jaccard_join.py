"""N-gram Jaccard self-join by a MinHash LSH forest and exact verification.

Each text becomes the set of its runs of five words (words are separated by blanks, tabs and line
ends; a text of one to four words has one shingle of all its words). Equal texts form one class,
so copies cost one row. The forest has `trees` sorted prefix tries of `depth` MinHash values each.
Every class is a query: in the first round it meets the classes that share a whole path of a trie,
and in each later round, one value shorter, only the queries take part whose estimated recall is
still below `recall`. A pair of similarity s shares d values in one of n tries with the probability
p = 1 - (1 - s**d)**n; each found neighbour so stands for 1 / p neighbours, and besides them one
pair at the threshold is assumed, so a query without neighbours goes on until such a pair would be
found (4 of 6 values by default), and a text with many close copies stops at longer prefixes.

A round's classes are dealt out by shared prefixes and sorted by them, so a run of equal prefixes is
a subtree of a trie; large subtrees are dealt out as tiles of two blocks, so that no task holds a
whole group and no pair is written. Candidates whose MinHash estimate is at most `slack` below the
threshold join one candidate component, and in each component all pairs are verified exactly, again
in tiles, which are bounded by rows and by shingles. Only link counts and spanning edges leave a
tile.

Defined cases: null and empty texts, and texts without words, link to nothing and are their own
class. Rows that share a doc_id count as one node of the graph. Rows without a doc_id are one node
for each different text; the nodes' numbers lie below all ids from -2**62 on. Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm import flat
from corpusweave.llm.components import components
from corpusweave.llm.store import bounded_batches, written

SIZE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 16, 6, 0.9995
SLACK = 0.2
#: Rows, and shingles of the rows, of a block.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
#: Tasks that the classes of one prefix are dealt out to before their tiles are known.
SALTS = 8
NO_ID = -(1 << 63)


def node_of(docs: DataFrame) -> Column:
    """The number of a row's node."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(F.coalesce(docs["text"], F.lit("")), F.lit(21)), F.lit(1 << 62)))


def found_share(similarity: np.ndarray | float, trees: int, depth: int) -> np.ndarray | float:
    """The probability that a pair shares `depth` values in one of the tries."""
    return 1 - (1 - similarity**depth) ** trees


def signatures(shingles: np.ndarray, offsets: np.ndarray, count: int, seed: int = 77) -> np.ndarray:
    """MinHash values (n, count) of 32 bits; texts without shingles get zeros."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, count, dtype=np.uint32)
    out = np.zeros((len(offsets) - 1, count), np.uint32)
    has = np.flatnonzero(np.diff(offsets))
    if not len(has):
        return out
    x, at = (shingles >> flat.U64(32)).astype(np.uint32), offsets[:-1][has]
    for k in range(count):
        y = x * a[k]
        y += b[k]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out[has, k] = np.minimum.reduceat(y, at)
    return out


def _sketch(size: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = flat.text_buffer(batch.column("text"))
            ids = batch.column("doc_id")
            for i, j in flat.blocks(at):
                part, off = raw[at[i] : at[j]], at[i : j + 1] - at[i]
                shingles, by = flat.shingle_hashes(part, off, size)
                sig = signatures(shingles, by, count)
                keys = [hashlib.blake2b(part[off[k] : off[k + 1]], digest_size=16).digest() if by[k + 1] > by[k] else None for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array(keys, pa.binary()), pa.array(np.diff(by)), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary())], names=["doc_id", "key", "shingles", "sig", "low"])
            flat.release_powers()

    return run


def _prefixes(trees: int, depth: int, matched: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            rep = batch.column("rep").to_numpy(zero_copy_only=False)
            for t in range(trees):
                h = np.full(len(sig), t + 1, flat.U64)
                for k in range(matched):
                    h = flat.mix(h ^ sig[:, t * depth + k].astype(flat.U64)) + flat.U64(k)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rep)], names=["bucket", "rep"])

    return run


def tiles(df: DataFrame, blocks: Column, node: str) -> DataFrame:
    """Deal the rows of every group out as tiles of two of its blocks: a group of one block is one
    tile; of a larger one, each row goes to one tile per block. Adds tile_i, tile_j and blk."""
    df = df.withColumn("_n", blocks.cast("int")).withColumn("blk", F.pmod(F.xxhash64(node, F.lit(5)), F.col("_n")).cast("int"))
    df = df.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return df.withColumn("tile_i", F.least("blk", "_j")).withColumn("tile_j", F.greatest("blk", "_j")).drop("_n", "_j")


def salted_join(rows: DataFrame, groups: DataFrame, key: str, node: str) -> DataFrame:
    """Each row with its group's one row; a group's rows are dealt out to several tasks by `node`."""
    rows = rows.withColumn("_s", F.pmod(F.xxhash64(node, F.lit(9)), F.lit(SALTS)).cast("int"))
    return rows.join(groups.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "_s"]).drop("_s")


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys, from batches sorted by these keys, with the n + 1
    bounds of the runs."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last != tuple(c[0] for c in cols)
        last = tuple(c[-1] for c in cols)
        cut = int(change.nonzero()[0][-1]) if change.any() else 0
        if cut or (change[0] and held):
            held.append(batch.slice(0, cut))
            yield _bounded(held, keys)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _bounded(held, keys)


def _bounded(held: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(held)
    change = np.zeros(table.num_rows, bool)
    for k in keys:
        c = table.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return table, np.concatenate([[0], np.flatnonzero(change), [table.num_rows]])


class Forest:
    """Union-find over 0..n-1 that keeps the smaller index as the root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _near(threshold: float, slack: float, trees: int, depth: int):
    """Of the queries of a tile and the other classes there: spanning edges of the pairs whose
    estimates reach the threshold less the slack; and for each query the neighbours found and those
    they stand for, each counted by its share of the tries in which it is met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_runs(batches, ["bucket", "tile_i", "tile_j"]):
            rep, side, asks = (t.column(c).to_numpy() for c in ("rep", "blk", "asks"))
            cross = t.column("tile_i").to_numpy() != t.column("tile_j").to_numpy()
            sig = np.frombuffer(b"".join(t.column("low").to_pylist()), np.uint8).reshape(len(rep), -1)
            edges, found, stand = [], np.zeros(len(rep)), np.zeros(len(rep))
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if b - a < 2 or not asks[a:b].any():
                    continue
                forest, mine, ask, left = Forest(b - a), sig[a:b], asks[a:b], side[a:b]
                place = np.arange(b - a)
                for x in np.flatnonzero(ask).tolist():
                    there = np.flatnonzero((~ask | (place > x)) & ((left != left[x]) if cross[a] else (place != x)))
                    s = (mine[there] == mine[x]).mean(1)
                    near = s >= threshold - slack
                    for y in there[near].tolist():
                        if forest.join(x, y):
                            edges.append((a + x, a + y))
                    s = np.clip((s[near] - 1 / 256) / (1 - 1 / 256), 0, 1)
                    there, s = there[near][s >= threshold], s[s >= threshold]
                    weight = 1 / (trees * s**depth)
                    share = weight * found_share(s, trees, depth)
                    for sums, each in ((found, share), (stand, weight)):
                        sums[a + x] += each.sum()
                        sums[a + there] += each
            ab, who = np.array(edges, np.int64).reshape(-1, 2), np.flatnonzero((stand > 0) & asks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([rep[ab[:, 0]], rep[who]])), pa.array([*rep[ab[:, 1]].tolist(), *[None] * len(who)], pa.int64()), pa.array(np.concatenate([np.zeros(len(ab)), found[who]])), pa.array(np.concatenate([np.zeros(len(ab)), stand[who]]))],
                names=["a", "b", "found", "stand"],
            )

    return run


def forest_edges(classes: DataFrame, threshold: float, trees: int, depth: int, recall: float, slack: float, block: int) -> list[DataFrame]:
    """The candidate edges (a, b) of classes(rep, sig, low), one table for each round of the forest."""
    spark, edges, done = classes.sparkSession, [], None
    for matched in range(depth, 0, -1):
        keys = classes.select("rep", "sig").mapInArrow(_prefixes(trees, depth, matched), "bucket long, rep long")
        groups = keys.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
        rows = salted_join(keys, groups, "bucket", "rep").join(classes.select("rep", "low"), "rep")
        rows = rows.withColumn("asks", F.lit(True)) if done is None else rows.join(done.withColumn("asks", F.lit(False)), "rep", "left").withColumn("asks", F.coalesce("asks", F.lit(True)))
        rows = _dealt(spark, tiles(rows, F.ceil(F.col("members") / F.lit(block)), "rep"), "bucket", "tile_i", "tile_j")
        met = written(rows.mapInArrow(_near(threshold, slack, trees, matched), "a long, b long, found double, stand double"), f"near{matched}")
        edges.append(met.where("b IS NOT NULL").select("a", "b"))
        least = found_share(threshold, trees, matched)
        if least >= recall:  # of every query
            break
        ended = met.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("found").alias("found"), F.sum("stand").alias("stand"))
        ended = ended.where((F.col("found") + F.lit(float(least))) / (F.col("stand") + F.lit(1.0)) >= recall).select("rep")
        done = written(ended if done is None else done.unionByName(ended).distinct(), f"done{matched}")
    return edges


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = flat.text_buffer(batch.column("text"))
            keys = batch.column("key").to_pylist()
            for i, j in flat.blocks(at):
                part, off = raw[at[i] : at[j]], at[i : j + 1] - at[i]
                shingles, by = flat.shingle_hashes(part, off, size)
                sets, mine = [], []
                for k in range(j - i):
                    if hashlib.blake2b(part[off[k] : off[k + 1]], digest_size=16).digest() == keys[i + k]:
                        mine.append(i + k)
                        sets.append(np.unique(shingles[by[k] : by[k + 1]]).tobytes())
                took = batch.take(pa.array(mine, pa.int64()))
                yield pa.RecordBatch.from_arrays([took.column("rep"), took.column("copies"), took.column("root"), took.column("blocks"), pa.array(sets, pa.binary())], names=["rep", "copies", "root", "blocks", "shingles"])
            flat.release_powers()

    return run


def links_of(sets: list[np.ndarray], threshold: float, first: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """For each set, the later sets (with `first`: those of the other side) whose Jaccard
    similarity with it reaches the threshold."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, flat_ids = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(sizes, kind="stable") if first is None else np.concatenate([np.flatnonzero(first), np.flatnonzero(~first)])
    marks = np.zeros(int(flat_ids.max()) + 1 if len(flat_ids) else 1, bool)
    for place, x in enumerate(order):
        if first is None:
            there = order[place + 1 :]
        elif first[x]:
            there = order[int(first.sum()) :]
        else:
            break
        low, high = np.minimum(sizes[there], sizes[x]), np.maximum(sizes[there], sizes[x])
        there = there[low >= threshold * high - 1e-9]
        if not len(there):
            continue
        own = flat_ids[at[x] : at[x + 1]]
        marks[own] = True
        n = sizes[there]
        hits = marks[flat.gather(flat_ids, at[there], n)]
        both = np.add.reduceat(hits, np.concatenate([[0], np.cumsum(n)[:-1]]), dtype=np.int64)
        marks[own] = False
        yield int(x), there[both >= threshold * (n + sizes[x] - both) - 1e-9]


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in (part.slice(a, b - a) for part, at in whole_runs(batches, ["root", "tile_i", "tile_j"]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if b - a > 1):
            rep, copies, side = (t.column(k).to_numpy() for k in ("rep", "copies", "blk"))
            sets = [np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()]
            cross = t.column("tile_i")[0].as_py() != t.column("tile_j")[0].as_py()
            first = side == side.min() if cross else None
            if cross and first.all():
                continue
            links, forest, edges = np.zeros(len(rep), np.int64), Forest(len(rep)), []
            for x, there in links_of(sets, threshold, first):
                links[x] += copies[there].sum()
                links[there] += copies[x]
                for y in there.tolist():
                    if forest.join(x, y):
                        edges.append((int(rep[x]), int(rep[y])))
            if not edges:
                continue
            linked = np.flatnonzero(links)
            ab = np.array(edges, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([rep[linked], ab[:, 0]])), pa.array(np.concatenate([rep[linked], ab[:, 1]])), pa.array(np.concatenate([links[linked], np.zeros(len(ab), np.int64)]))],
                names=["a", "b", "links"],
            )

    return run


def joined_nodes(
    docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, slack: float = SLACK, block: int = BLOCK
) -> DataFrame:
    """jaccard_join() with the rows' nodes for doc_ids."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(node_of(docs).alias("doc_id"), "text")
    sketch = written(docs.mapInArrow(_sketch(size, trees * depth), "doc_id long, key binary, shingles long, sig binary, low binary"), "sketch")
    classes = written(sketch.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("shingles").alias("shingles"), F.first("sig").alias("sig"), F.first("low").alias("low")), "classes")

    edges = forest_edges(classes, threshold, trees, depth, recall, slack, block)
    near = components(reduce(DataFrame.unionByName, edges), "near").withColumnRenamed("node", "rep")
    near = written(near.join(classes.select("rep", "key", "copies", "shingles"), "rep"), "candidates")
    parts = F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("shingles") / F.lit(BLOCK_SHINGLES)))
    grouped = salted_join(near, near.groupBy("root").agg(parts.alias("blocks")), "root", "rep")
    texts = docs.join(grouped, docs["doc_id"] == grouped["rep"])
    sets = texts.select("rep", "copies", "root", "blocks", "key", "text").mapInArrow(_sets(size), "rep long, copies long, root long, blocks long, shingles binary")
    sets = _dealt(spark, tiles(sets, F.col("blocks"), "rep"), "root", "tile_i", "tile_j")
    checked = written(sets.mapInArrow(_verify(threshold), "a long, b long, links long"), "links")
    roots = components(checked.select("a", "b"), "linked")
    links = checked.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))

    out = classes.select("key", "rep", "copies").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.select("key", F.coalesce("root", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))
    alone = sketch.where("key IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    out = sketch.where("key IS NOT NULL").select("doc_id", "key").join(out, "key").drop("key").unionByName(alone)
    return out.select("doc_id", "class_id", "n_links")


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, class_id (the smallest node that a chain of
    links reaches, which is a doc_id wherever all have one) and n_links (other rows whose Jaccard
    similarity is at least `threshold`, copies included). The options are those of joined_nodes():
    shingle size, threshold, trees and their depth, recall, slack, and rows of a block."""
    out = joined_nodes(docs, **options)
    return out.withColumn("doc_id", F.when(F.col("doc_id") >= NO_ID + (1 << 62), F.col("doc_id")))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, without those that a chain of links joins to a smaller doc_id
    (a row without an id counts as smaller); of repeated rows (doc_id and text), one stays."""
    classes = written(joined_nodes(docs, **options).select(F.col("doc_id").alias("_doc"), "class_id"), "kept")
    stay = classes.where(F.col("_doc") == F.col("class_id")).select("_doc").distinct()
    out = docs.join(stay, node_of(docs) == stay["_doc"], "left_semi")
    repeated = not classes.groupBy("_doc").count().where("count > 1").isEmpty()
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out


def _dealt(spark, df: DataFrame, *keys: str) -> DataFrame:
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys)
