"""Log-probabilities of texts under an n-gram model with deleted interpolation.

Maximum-likelihood estimates of orders 3 to 0 are mixed by weights that depend on how often the context
was seen: the longest context with a count gives the bucket, by the power of two below that count. The
weights are learned by expectation-maximisation on a deleted part of the training documents, with counts
from the kept part; the final counts are those of both parts.

How it runs: documents become blocks of about half a million words, each a table of its words and the places
that use them. A block asks for its distinct n-grams: their keys, sorted, with the counts that it adds.
The requests are dealt by key range, so a task counts one range for the whole corpus and answers each
block in the order that it asked. No n-gram leaves a block twice, nothing is broadcast, and no count is
cut off; what a driver sees are the totals and the sums of a bucket. Of an n-gram that all blocks hold,
one task reads one entry for each block.

Words are known by 64-bit hashes, and pairs and triples by as many bits of theirs as keep the chance that
a key is shared under one in 100,000.

Tokens are the words of the text with A-Z lower-cased, then one end; the contexts of a text's first words
hold start marks, which are not counted. P(w) = sum of weight_k * count_k / context_k, and the lowest
order is 1 / (V + 1), so that the probabilities of the V words known and of all others together add up
to 1.

Defined cases: a null or empty text has only the end; repeated rows are documents of their own; a null
doc_id is hashed as '' and stays null; without training documents all counts are 0; an empty table gives
no rows. Other columns of the input are ignored. A text longer than a block is cut into several, between
words, and keeps its context.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.flat import ROOT, U64, mix
from corpusweave.llm.packed import pack, pack_counts, pack_sorted, squeezed, unpack, unpack_counts, unpack_sorted, unsqueezed
from corpusweave.llm.store import bounded_batches, text_bytes, written

START, END = b" start", b" end"  # no word holds a space
BLOCK_TOKENS = 1 << 19
PIECE_BYTES = 4 << 20
#: Text for each range of keys, which is one task's.
RANGE_BYTES = 8 << 20
#: One of how many training documents is deleted.
DELETED = 28
KEPT, LEFT_OUT, HELD_OUT = 0, 1, 2
#: Buckets of one context length: counts below each power of two.
POWERS = 64
ROUNDS, LEAST_GAIN = 30, 1e-5
#: Added to an order's share of a bucket, so that no weight is 0.
PRIOR = 0.5
_GAP = re.compile(rb"[ \t-\r]")
BLOCKS = "block long, part int, n_docs long, uids binary, doc_ids array<long>, sizes binary, ends binary, ids binary, hashes binary"
ASKED = "length int, range int, block long, part int, keys binary, counts binary"
ANSWERS = "block long, length int, range int, trained binary, kept binary, v long, n long, v_kept long, n_kept long"
STATES = "bucket int, c3 long, x2 long, c2 long, x1 long, c1 long, n long"
SCORES = "uid long, doc_id long, part int, n_tokens long, n_known long, base_score double, score double"


def part_of(doc_id: Column) -> Column:
    """KEPT, LEFT_OUT (deleted for the weights) or HELD_OUT (never learned from)."""
    crc = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.when(crc % 7 == 2, HELD_OUT).when(crc % DELETED == 3, LEFT_OUT).otherwise(KEPT)


class _Block:
    """Segments of texts; each has two tokens of context before its own."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = defaultdict(count().__next__)
        self.start, self.end = self.words[START], self.words[END]
        self.ids: list[np.ndarray] = []
        self.segments: list[tuple] = []
        self.size = 0

    def add(self, uid: int, doc_id: int | None, context: list[bytes], tokens: list[bytes], last: bool) -> None:
        every = [*context, *tokens, *([END] if last else [])]
        self.ids.append(np.fromiter(map(self.words.__getitem__, every), np.int64, len(every)))
        self.segments.append((uid, doc_id, len(every) - 2, last))
        self.size += len(every)

    def row(self, block: int, part: int) -> pa.RecordBatch:
        uids, docs, sizes, ends = zip(*self.segments, strict=True)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), U64, len(self.words))
        binary = [pack(np.array(uids)), pack(np.array(sizes)), pack(np.array(ends, np.int64)), squeezed(pack(np.concatenate(self.ids))), hashes.astype("<u8").tobytes()]
        cols = [pa.array([block]), pa.array([part], pa.int32()), pa.array([sum(ends)]), *(pa.array([b], pa.binary()) for b in binary)]
        cols.insert(4, pa.array([docs], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(cols, names=[c.split(" ")[0] for c in BLOCKS.split(", ")])


def _pieces(text: bytes) -> Iterator[tuple[list[bytes], bool]]:
    """The words of a text in pieces, and whether a piece is the last."""
    at = 0
    while len(text) - at > PIECE_BYTES and (gap := _GAP.search(text, at + PIECE_BYTES)):
        yield text[at : gap.start()].lower().split(), False
        at = gap.end()
    yield text[at:].lower().split(), True


def _blocks(block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        numbers, uid = count(base), base
        open_: dict[int, _Block] = defaultdict(_Block)
        for batch in batches:
            for doc_id, part, text in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), batch.column("text"), strict=True):
                context = [START, START]
                for tokens, last in _pieces(text.as_py()):
                    open_[part].add(uid, doc_id, context, tokens, last)
                    context = [*context, *tokens[-2:]][-2:]
                    if open_[part].size >= block_tokens:
                        yield open_.pop(part).row(next(numbers), part)
                uid += 1
        for part in sorted(open_):
            yield open_[part].row(next(numbers), part)

    return run


class _Grams:
    """The n-grams of a block: for each length the sorted keys, and how places refer to them."""

    def __init__(self, row: dict, bits: int) -> None:
        self.hashes = np.frombuffer(row["hashes"], "<u8").astype(U64)
        self.ids = unpack(unsqueezed(row["ids"]))
        self.sizes = unpack(row["sizes"])
        at = np.cumsum(self.sizes + 2) - self.sizes - 2
        inside = np.ones(len(self.ids), bool)
        inside[at] = False
        self.paired = np.flatnonzero(inside)
        inside[at + 1] = False
        self.scored = np.flatnonzero(inside)
        self.second = at + 1
        h, cut = self.hashes[self.ids], U64(64 - bits)
        pair = np.zeros(len(h), U64)
        pair[1:] = mix(h[:-1] * U64(ROOT) + h[1:])
        self.pairs = pair[self.paired] >> cut
        self.triples = mix(pair[self.scored - 1] * U64(ROOT) + h[self.scored]) >> cut
        self.second_pairs = pair[self.second] >> cut
        self.order = np.argsort(self.hashes, kind="stable")

    def counted(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, sorted keys and the block's own counts; a context alone counts 0."""
        yield 1, self.hashes[self.order], np.bincount(self.ids[self.scored], minlength=len(self.hashes))[self.order]
        keys, n = np.unique(self.pairs, return_counts=True)
        np.subtract.at(n, np.searchsorted(keys, self.second_pairs), 1)
        yield 2, keys, n
        yield 3, *np.unique(self.triples, return_counts=True)

    def found(self, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, n_docs: int) -> tuple[np.ndarray, ...]:
        """At each scored place: the triple's count, its context's, the pair's, its context's, the word's."""
        by_word = np.empty(len(words), np.int64)
        by_word[self.order] = words
        start = self.ids == 0
        c1 = by_word[self.ids]
        x1 = np.where(start, n_docs, c1)
        c2 = np.zeros(len(self.ids), np.int64)
        c2[self.paired] = pairs[np.unique(self.pairs, return_inverse=True)[1]]
        x2 = np.where(start, n_docs, c2)
        c3 = triples[np.unique(self.triples, return_inverse=True)[1]]
        p = self.scored
        return c3, x2[p - 1], c2[p], x1[p - 1], c1[p]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


def _bounds(bits: int, range_bits: int) -> np.ndarray:
    return np.arange(1 << range_bits).astype(U64) << U64(bits - range_bits)


def _ask(bits: int, range_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            out = []
            for length, keys, counts in _Grams(row, bits).counted():
                low = _bounds(64 if length == 1 else bits, range_bits)
                at = [*np.searchsorted(keys, low).tolist(), len(keys)]
                out += [(length, r, row["block"], row["part"], pack_sorted(keys[a:b] - low[r]), pack(counts[a:b])) for r, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split(" ")[0] for c in ASKED.split(", ")])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """The corpus's counts of the keys of one range, for each block in its own order."""
    length, number = table.column("length")[0].as_py(), table.column("range")[0].as_py()
    blocks, parts = table.column("block").to_pylist(), np.array(table.column("part").to_pylist())
    asked = [unpack_sorted(x.as_py()) for x in table.column("keys")]
    sizes = [len(x) for x in asked]
    added = np.concatenate([unpack(x.as_py()) for x in table.column("counts")])
    keys, place = np.unique(np.concatenate(asked), return_inverse=True)
    del asked
    part = np.repeat(parts, sizes)
    kept = np.bincount(place, weights=added * (part == KEPT), minlength=len(keys)).astype(np.int64)
    trained = kept + np.bincount(place, weights=added * (part == LEFT_OUT), minlength=len(keys)).astype(np.int64)
    rows, at = [], 0
    for block, n, own in zip(blocks, sizes, parts.tolist(), strict=True):
        use = place[at : at + n]
        rows.append((block, length, number, squeezed(pack_counts(trained[use])), squeezed(pack_counts(kept[use])) if own == LEFT_OUT else None, None, None, None, None))
        at += n
    if length == 1:
        rows.append((None, length, number, None, None, *(int(f(x)) for x in (trained, kept) for f in (np.count_nonzero, np.sum))))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4)
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split(" ")[0] for c in ANSWERS.split(", ")])


def _answered(table: pa.Table, column: str) -> list[np.ndarray]:
    """The counts that were answered, by length, in the order of the block's sorted keys."""
    rows = sorted(zip(table.column("length").to_pylist(), table.column("range").to_pylist(), range(table.num_rows), strict=True))
    return [np.concatenate([np.zeros(0, np.int64), *(unpack_counts(unsqueezed(table.column(column)[k].as_py())) for length, _, k in rows if length == x)]) for x in (1, 2, 3)]


def _bucket(x2: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """0 without a known context, else by the length and the count of the longest known one."""
    power = lambda x: np.floor(np.log2(np.maximum(x, 1))).astype(np.int64)
    return np.where(x2 > 0, 2 * POWERS + power(x2), np.where(x1 > 0, POWERS + power(x1), 0))


def _states(bits: int, n_docs: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in _rows(blocks.to_batches()):
            found = _Grams(row, bits).found(*_answered(answers, "kept"), n_docs)
            c3, x2, c2, x1, c1 = found
            values, n = np.unique(np.stack([_bucket(x2, x1), c3, x2, c2, x1, c1]), axis=1, return_counts=True)
            out.append(pa.Table.from_arrays([pa.array(v.astype(np.int32 if k == 0 else np.int64)) for k, v in enumerate([*values, n])], names=[c.split(" ")[0] for c in STATES.split(", ")]))
        return pa.concat_tables(out)

    return run


def learn_weights(states: DataFrame, n: int, v: int) -> np.ndarray:
    """Weights of orders 0 to 3 for each bucket, by expectation-maximisation over held-out counts:
    states(bucket, c3, x2, c2, x1, c1, n), of which n places had the same counts."""
    buckets = 3 * POWERS
    allowed = np.ones((buckets, 4), bool)
    allowed[: 2 * POWERS, 3] = False
    allowed[:POWERS, 2] = False
    weights = allowed / allowed.sum(1, keepdims=True)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    parts = states.select("bucket", "n", F.lit(1.0 / (v + 1)).alias("f0"), (F.col("c1") / F.lit(float(max(n, 1)))).alias("f1"), ratio("c2", "x1").alias("f2"), ratio("c3", "x2").alias("f3"))
    mass, before = np.zeros(buckets), -np.inf
    for _ in range(ROUNDS):
        shares = [F.get(F.lit(weights[:, k].tolist()), F.col("bucket")) * F.col(f"f{k}") for k in range(4)]
        shared = parts.select("bucket", "n", *(s.alias(f"s{k}") for k, s in enumerate(shares))).withColumn("p", F.expr("s0 + s1 + s2 + s3"))
        got = shared.groupBy("bucket").agg(*(F.sum(F.col("n") * F.col(f"s{k}") / F.col("p")) for k in range(4)), F.sum("n"), F.sum(F.col("n") * F.log("p"))).collect()
        sums, mass, gain = np.zeros((buckets, 4)), np.zeros(buckets), 0.0
        for row in got:
            sums[row[0]], mass[row[0]], gain = row[1:5], row[5], gain + row[6]
        weights = np.where(allowed, sums + PRIOR, 0)
        weights /= weights.sum(1, keepdims=True)
        if not got or gain - before < LEAST_GAIN * mass.sum():
            break
        before = gain
    for b in range(buckets):
        if not mass[b] and b % POWERS:
            weights[b] = weights[b - 1]  # a count never met: as the next smaller one
    return weights


def _score(bits: int, n_docs: int, n: int, v: int, weights: np.ndarray):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in _rows(blocks.to_batches()):
            grams = _Grams(row, bits)
            c3, x2, c2, x1, c1 = grams.found(*_answered(answers, "trained"), n_docs)
            w = weights[_bucket(x2, x1)]
            p = w[:, 0] / (v + 1) + w[:, 1] * (c1 / max(n, 1)) + w[:, 2] * (c2 / np.maximum(x1, 1)) + w[:, 3] * (c3 / np.maximum(x2, 1))
            of = np.repeat(np.arange(len(grams.sizes)), grams.sizes)
            sums = [np.bincount(of, weights=x, minlength=len(grams.sizes)) for x in (c1 > 0, np.log10((c1 + 1) / (n + v + 1)), np.log10(p))]
            cols = [unpack(row["uids"]), pa.array(row["doc_ids"], pa.int64()), np.full(len(grams.sizes), row["part"], np.int32), grams.sizes, sums[0].astype(np.int64), *sums[1:]]
            out.append(pa.Table.from_arrays([pa.array(c) for c in cols], names=[c.split(" ")[0] for c in SCORES.split(", ")]))
        return pa.concat_tables(out)

    return run


def score_texts(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (words alone, one count added to
    each) and score (log10 of the model's probability) of docs(doc_id, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = text_bytes(docs) + 1
    bits, range_bits = min(64, size.bit_length() + 14), max(1, (size // range_bytes).bit_length())
    source = docs.select("doc_id", part_of(F.col("doc_id")).alias("part"), F.col("text").cast("binary").alias("text"))
    blocks = written(source.mapInArrow(_blocks(block_tokens), BLOCKS), "blocks")
    asked = blocks.mapInArrow(_ask(bits, range_bits), ASKED)
    answers = written(asked.groupBy("length", "range").applyInArrow(_answer, ANSWERS), "answers")
    total = answers.where("block IS NULL").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("v", "n", "v_kept", "n_kept"))).first()
    in_part = dict(blocks.groupBy("part").agg(F.sum("n_docs")).collect())
    kept_docs, train_docs = in_part.get(KEPT, 0), in_part.get(KEPT, 0) + in_part.get(LEFT_OUT, 0)
    left_out = blocks.where(F.col("part") == LEFT_OUT).groupBy("block").cogroup(answers.where("kept IS NOT NULL").groupBy("block"))
    states = written(left_out.applyInArrow(_states(bits, kept_docs), STATES), "states")
    weights = learn_weights(states, total["n_kept"], total["v_kept"])
    both = blocks.groupBy("block").cogroup(answers.where("block IS NOT NULL").select("block", "length", "range", "trained").groupBy("block"))
    scored = both.applyInArrow(_score(bits, train_docs, total["n"], total["v"], weights), SCORES)
    scored = scored.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), (F.first("part") == HELD_OUT).alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total["n"]).cast("long").alias("train_tokens"), "base_score", "score")
