"""Audit of sources: how far the sources of a language differ in their terms, and which terms stand out.

Each task counts the terms of its documents in a radix trie over bytes for every language, with counters
by source at the leaves, and gives its tries away as subtrees below their first bytes. Range partitions
by language and prefix bring equal subtrees together, in order; they are merged one after the other, so
that a task holds one prefix's trie. Its walk in byte order, which is the order of UTF-8, gives the terms
that enough documents use. A second walk over these, with the totals known, streams the sums of all pairs
of sources and the best terms of each source, where equal values keep the order of the walk.

With count the occurrences of a term in a source and N their sum over all V kept terms, a share is
p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)); two shares differ by floor((p - q)**2 / (p + q)).
All of it is whole-number arithmetic.

Defined cases: a null text, language or source is ''; a repeated row is a document of its own; sources
without terms take part with counts of 0; a language without kept terms has pairs of value 0; an empty
table gives no rows. Other columns of the input are ignored.

What grows: leaves are counters of (term, source); a kept term costs as much as its language has pairs
of sources, and that many pairs are the result. A language's list of sources with their totals goes with
each row of 4,096 terms, so it is as long as one source's part of the result.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.llm.flat import gather
from corpusweave.llm.packed import pack, unpack
from corpusweave.llm.store import bounded_batches, written

LEAST_DOCS = 10
BEST = 10
SCALE = 10**9
#: Bytes of the prefix below which a subtree is handed on as a whole.
PREFIX = 3
#: Terms in a task's tries at which it hands them on, which bounds its memory.
TASK_TERMS = 4 << 20
CHUNK = 4096
#: Letters A-Z become small, other bytes below 0x80 that aren't letters end a term.
_FOLD = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
SUBTREE = "lang string, prefix binary, suffixes binary, docs binary, fans binary, places binary, counts binary, sources array<string>"
CHUNKS = "lang string, n_terms long, terms binary, fans binary, places binary, counts binary, sources array<string>, sums array<long>"
FOUND = "part string, lang string, source string, item string, value long"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text."""
    return text.translate(_FOLD).split()


class RadixTrie:
    """A byte trie whose edges are labels; a node is [label, children by their first byte, leaf]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]

    def node(self, term: bytes) -> list:
        """The node of a term, which is made if it isn't there."""
        node, at, n = self.root, 0, len(term)
        while at < n:
            children, first = node[1], term[at]
            child = children.get(first)
            if child is None:
                children[first] = child = [term[at:], {}, None]
                return child
            label = child[0]
            if term.startswith(label, at):
                node, at = child, at + len(label)
                continue
            k, most = 1, min(len(label), n - at)
            while k < most and label[k] == term[at + k]:
                k += 1
            children[first] = node = [label[:k], {label[k]: child}, None]
            child[0] = label[k:]
            at += k
        return node

    def walk(self) -> Iterator[tuple[bytes, object]]:
        """Terms with leaves, in byte order."""
        todo = [(b"", self.root)]
        while todo:
            above, (label, children, leaf) = todo.pop()
            term = above + label
            if leaf is not None:
                yield term, leaf
            todo.extend((term, children[b]) for b in sorted(children, reverse=True))


class _Counted:
    """Terms of the documents of one language, until they go into a trie."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = defaultdict(count().__next__)
        self.sources: dict[str, int] = defaultdict(count().__next__)
        self.runs: list[np.ndarray] = []
        self.places: list[int] = []

    def add(self, source: str, terms: list[bytes]) -> None:
        self.runs.append(np.fromiter(map(self.ids.__getitem__, terms), np.int64, len(terms)))
        self.places.append(self.sources[source])

    def subtrees(self, lang: str) -> Iterator[tuple]:
        """The trie's subtrees below each prefix, in order."""
        ids, sizes = np.concatenate(self.runs), np.array([len(r) for r in self.runs])
        n_terms, n_sources = len(self.ids), len(self.sources)
        docs = np.bincount(np.unique(np.repeat(np.arange(len(sizes)), sizes) * n_terms + ids) % max(1, n_terms), minlength=n_terms)
        key, counts = np.unique(ids * n_sources + np.repeat(np.array(self.places, np.int64), sizes), return_counts=True)
        places, first = key % n_sources, np.searchsorted(key // n_sources, np.arange(n_terms + 1))
        trie = RadixTrie()
        for term, k in self.ids.items():
            trie.node(term)[2] = k
        names = list(self.sources)
        for prefix, leaves in groupby(trie.walk(), lambda x: x[0][:PREFIX]):
            terms, order = zip(*leaves, strict=True)
            at = np.array(order)
            fans = first[at + 1] - first[at]
            here, where = np.unique(gather(places, first[at], fans), return_inverse=True)
            suffixes = b" ".join(t[len(prefix) :] for t in terms)
            yield lang, prefix, suffixes, pack(docs[at]), pack(fans), pack(where), pack(gather(counts, first[at], fans)), [names[k] for k in here]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _in_rows(rows: Iterator[tuple], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield _table(some, schema)
            some = []
    if some:
        yield _table(some, schema)


_S, _B, _L = pa.string(), pa.binary(), pa.int64()
_SUBTREE = pa.schema([("lang", _S), ("prefix", _B), ("suffixes", _B), ("docs", _B), ("fans", _B), ("places", _B), ("counts", _B), ("sources", pa.list_(_S))])
_CHUNK = pa.schema([("lang", _S), ("n_terms", _L), ("terms", _B), ("fans", _B), ("places", _B), ("counts", _B), ("sources", pa.list_(_S)), ("sums", pa.list_(_L))])
_FOUND = pa.schema([("part", _S), ("lang", _S), ("source", _S), ("item", _S), ("value", _L)])


def _count(task_terms: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        gathered: dict[str, _Counted] = defaultdict(_Counted)
        n = 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                terms = terms_of(text.as_py())
                gathered[lang].add(source, terms)
                n += len(terms)
                if n >= task_terms:
                    for k in sorted(gathered):
                        yield from gathered[k].subtrees(k)
                    gathered.clear()
                    n = 0
        for k in sorted(gathered):
            yield from gathered[k].subtrees(k)

    return lambda batches: _in_rows(rows(batches), _SUBTREE)


def _merge(least_docs: int):
    """Merge the subtrees of a range of prefixes, which come in order, and keep its common terms."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, dict]]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for (lang, prefix), some in groupby(rows, lambda r: (r["lang"], r["prefix"])):
            trie = RadixTrie()
            for r in some:
                fans, docs, counts = (unpack(r[c]).tolist() for c in ("fans", "docs", "counts"))
                names = [r["sources"][k] for k in unpack(r["places"]).tolist()]
                at = 0
                for suffix, n, fan in zip(r["suffixes"].split(b" "), docs, fans, strict=True):
                    node = trie.node(suffix)
                    if node[2] is None:
                        node[2] = [n, dict(zip(names[at : at + fan], counts[at : at + fan], strict=True))]
                    else:
                        node[2][0] += n
                        by = node[2][1]
                        for k in range(at, at + fan):
                            by[names[k]] = by.get(names[k], 0) + counts[k]
                    at += fan
            for suffix, (n, by) in trie.walk():
                if n >= least_docs:
                    yield lang, prefix + suffix, by

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for lang, leaves in groupby(kept(batches), lambda x: x[0]):
            while some := [x for _, x in zip(range(CHUNK), leaves)]:
                sources = sorted({s for _, _, by in some for s in by})
                place = {s: k for k, s in enumerate(sources)}
                places = np.array([place[s] for _, _, by in some for s in by], np.int64)
                counts = [n for _, _, by in some for n in by.values()]
                sums = [0] * len(sources)
                for k, n in zip(places.tolist(), counts, strict=True):
                    sums[k] += n
                yield lang, len(some), b" ".join(t for _, t, _ in some), pack(np.array([len(by) for _, _, by in some])), pack(places), pack(np.array(counts, np.uint64)), sources, sums

    return lambda batches: _in_rows(rows(batches), _CHUNK, 4)


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total), exactly."""
    if not counts.size or int(counts.max()) + 2 < (1 << 63) // SCALE:
        return 1 + SCALE * (counts + 2) // total
    return (1 + SCALE * (counts.astype(object) + 2) // np.asarray(total).astype(object)).astype(np.int64)


def _compare(best: int):
    """Sums over pairs of sources and the best terms of each, of the chunks of a task."""

    def of_language(lang: str, rows: Iterator[dict]) -> Iterator[tuple]:
        sums, heaps = None, {}
        for r in rows:
            names = [s["source"] for s in r["all"]]
            if sums is None:
                sums = np.zeros((len(names), len(names)), np.int64)
                place = {s: k for k, s in enumerate(names)}
                total = np.array([s["n"] for s in r["all"]], np.int64) + 2 * r["v"]
                whole = np.int64(r["lang_n"] + 2 * r["v"])
                heaps = {k: [] for k in range(len(names))}
            terms, fans, counts = r["terms"].split(b" "), unpack(r["fans"]), unpack(r["counts"])
            where = np.array([place[s] for s in r["sources"]], np.int64)[unpack(r["places"])]
            line, step = np.repeat(np.arange(len(terms)), fans), max(1, (1 << 20) // len(names))
            for a in range(0, len(terms), step):
                use = (line >= a) & (line < a + step)
                c = np.zeros((min(step, len(terms) - a), len(names)), np.int64)
                c[line[use] - a, where[use]] = counts[use]
                p, q = shares(c, total), shares(c.sum(1), whole)
                for x in range(len(names) - 1):
                    mine, others = p[:, x : x + 1], p[:, x + 1 :]
                    sums[x, x + 1 :] += ((mine - others) ** 2 // (mine + others)).sum(0)
                for x in range(len(names)):
                    up = np.flatnonzero((c[:, x] > 0) & (p[:, x] > q))
                    value = (p[up, x] - q[up]) ** 2 // (p[up, x] + q[up])
                    some = up[first := np.argsort(-value, kind="stable")[:best]]
                    heaps[x] = heapq.nsmallest(best, [*heaps[x], *zip((-value[first]).tolist(), [terms[a + k] for k in some.tolist()], strict=True)])
        for x in range(len(names)):
            yield from (("pair", lang, names[i], names[j], int(sums[x, y])) for y in range(x + 1, len(names)) for i, j in ((x, y), (y, x)))
            yield from (("term", lang, names[x], term.decode(), -value) for value, term in heaps[x])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for lang, some in groupby((row for batch in batches for row in batch.to_pylist()), lambda r: r["lang"]):
            yield from of_language(lang, some)

    return lambda batches: _in_rows(rows(batches), _FOUND, 8192)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, best: int = BEST, task_terms: int = TASK_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank of docs(text, lang, source): part 'pair' has each other
    source of the language as item with the difference over all kept terms, part 'term' the `best` terms
    that a source uses more than its language does."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    tries = written(docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(_count(task_terms), SUBTREE), "tries")
    ranges = tries.repartitionByRange("lang", "prefix").sortWithinPartitions("lang", "prefix")
    chunks = written(ranges.mapInArrow(_merge(least_docs), CHUNKS), "terms")
    groups = written(docs.select("lang", "source").distinct(), "sources")
    sums = chunks.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", "x.sources").agg(F.sum("x.sums").alias("n"))
    totals = groups.join(sums.withColumnRenamed("sources", "source"), ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    languages = totals.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("all"), F.sum("n").alias("lang_n"))
    sizes = chunks.groupBy("lang").agg(F.sum("n_terms").alias("v"))
    known = written(languages.join(sizes, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0))), "languages")
    found = chunks.drop("n_terms", "sums").join(known, "lang").sortWithinPartitions("lang").mapInArrow(_compare(best), FOUND)
    pairs = groups.join(known.select("lang", F.explode("all.source").alias("item")), "lang").where("item != source")
    pairs = pairs.select(F.lit("pair").alias("part"), "lang", "source", "item", F.lit(0).cast("long").alias("value"))
    found = written(found, "found").union(pairs).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= best)).select("lang", "source", "part", "item", "value", "rank")
