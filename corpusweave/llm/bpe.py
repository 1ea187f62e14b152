"""Byte-level BPE encoding with a pair occurrence index, and decoding.

A block of whole texts is one flat byte buffer. Its pieces (the byte-level pattern: contractions,
runs of letters, of digits, of other characters, each with one blank before it, and white space)
are found with vectorised class changes; equal pieces are encoded once a block. The pieces' symbols
form one linked list in arrays, and the index maps every pair with a rank to all its positions in
the block. Active ranks are applied in ascending order: a rank's whole list is merged at once, and
the lists of the new neighbouring pairs are extended. Positions that a merge has outdated are
recognised when their list comes up. As a merged symbol's own merges always have higher ranks, the
result is that of merging each piece by itself, lowest rank first, leftmost first.

Defined cases: null and empty texts have no ids; texts holding an added token's string get its id,
as the tokenizers library does; decoding replaces bytes that aren't UTF-8. Rows with equal doc_id
are encoded one by one. Other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm import flat, tokens
from corpusweave.llm.store import bounded_batches

#: Texts of one merge pass; a worker's arrays take about 40 times as much.
BLOCK_BYTES = 4 << 20
LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
#: The pattern's contractions and Unicode's white space.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": DIGIT}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    out[list(WHITE)] = SPACE
    return out


def byte_classes(raw: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of a UTF-8 buffer belongs to."""
    table = char_classes()
    out = table[:256][raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        wide = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.uint32)
        b0, b1, b2, b3 = (wide[lead + k] for k in range(4))
        two, three = ((b0 & 0x1F) << 6) | (b1 & 0x3F), ((b0 & 0x0F) << 12) | ((b1 & 0x3F) << 6) | (b2 & 0x3F)
        four = ((b0 & 0x07) << 18) | ((b1 & 0x3F) << 12) | ((b2 & 0x3F) << 6) | (b3 & 0x3F)
        kind = table[np.minimum(np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, four)), 0x10FFFF)]
        out[lead] = kind
        size = np.where(b0 < 0xE0, 2, np.where(b0 < 0xF0, 3, 4))
        for k in (1, 2, 3):
            at = lead[size > k] + k
            keep = at < len(raw)
            out[at[keep]] = kind[size > k][keep]
    return out


def piece_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces; a piece ends where the next one starts, or the last text ends."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(raw)
    lead = (raw & 0xC0) != 0x80
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    space = kind == SPACE
    before = np.empty(n, np.uint8)  # the class before a byte; at a text's start, none
    before[0], before[1:] = 9, kind[:-1]
    before[first[:n]] = 9
    blank = raw == 0x20
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    start = (~space) & (before != kind) & ~((before == SPACE) & after_blank)
    # White space: a run's first character, and its last one if a text's other character follows.
    start |= space & (before != SPACE) & lead
    leads = np.flatnonzero(lead)
    here = space[leads]
    follows = np.zeros(len(leads), bool)
    follows[:-1] = here[:-1] & ~here[1:] & ~first[leads[1:]]
    start[leads[follows]] = True
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    for q in np.flatnonzero((raw == 0x27) & start).tolist():
        # Pieces that start at an apostrophe, from left to right: an earlier one may have moved this one's start.
        if not start[q]:
            continue
        tail = raw[q + 1 : q + 3].tobytes()
        stop = int(offsets[np.searchsorted(offsets, q, "right")])
        for c in CONTRACTIONS:
            end = q + 1 + len(c)
            if tail.startswith(c) and end <= stop:
                start[q + 1 : end] = False
                if end < stop and not (space[end] and start[end]):
                    start[end] = True
                break
    return np.flatnonzero(start)


class Encoder:
    def __init__(self, path: str) -> None:
        v = tokens.vocabulary(path)
        self.special = v.special
        self.byte_ids = v.byte_ids
        m = v.merges
        keys = (m[:, 0] << 32) | m[:, 1]
        order = np.argsort(keys)
        self.keys, self.key_ranks = np.append(keys[order], -1 + (1 << 62)), np.append(order, -1).astype(np.int32)
        self.left, self.right, self.merged = m[:, 0].tolist(), m[:, 1].tolist(), m[:, 2].tolist()
        self.first = np.full((256, 256), -1, np.int32)  # ranks of byte pairs
        known = {int(i): b for b, i in enumerate(v.byte_ids)}
        for rank, (a, b) in enumerate(zip(self.left, self.right, strict=True)):
            if a in known and b in known:
                self.first[known[a], known[b]] = rank
        sizes = np.array([len(t) for t in v.tokens], np.int64)
        self.token_bytes, self.token_at, self.token_size = np.frombuffer(b"".join(v.tokens), np.uint8), np.cumsum(sizes) - sizes, sizes

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.int64) << 32) | b
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.key_ranks[at], -1)

    def merge(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces that lie one after the other in data, and their counts by piece."""
        n = len(data)
        ends = np.cumsum(sizes)
        sym = self.byte_ids[data]
        after, back = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        back[ends - sizes] = -1
        at = np.flatnonzero(after >= 0)
        ranks = self.first[data[at], data[at + 1]]
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def index(at: np.ndarray, ranks: np.ndarray) -> None:
            has = ranks >= 0
            at, ranks = at[has], ranks[has]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(at)]
            for rank, a, b in zip(ranks[np.array(bounds[:-1])].tolist(), bounds[:-1], bounds[1:], strict=True):
                if rank in lists:
                    lists[rank].append(at[a:b])
                else:
                    lists[rank] = [at[a:b]]
                    heapq.heappush(heap, rank)

        index(at.astype(np.int32), ranks)
        while heap:
            rank = heapq.heappop(heap)
            found = lists.pop(rank)
            pos = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            a, b = self.left[rank], self.right[rank]
            follow = after[pos]
            ok = (sym[pos] == a) & (follow >= 0)
            ok &= sym[follow] == b
            if not ok.all():
                pos, follow = pos[ok], follow[ok]
                if not len(pos):
                    continue
            if a == b and len(pos) > 1:  # of touching pairs, every other one from the left
                chained = np.zeros(len(pos), bool)
                chained[1:] = follow[:-1] == pos[1:]
                head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(pos))))
                take = (np.arange(len(pos)) - head) % 2 == 0
                pos, follow = pos[take], follow[take]
            new = self.merged[rank]
            sym[pos], sym[follow] = new, -1
            then = after[follow]
            after[pos] = then
            right = then >= 0
            back[then[right]] = pos[right]
            here = back[pos]
            here = here[here >= 0]
            both = np.concatenate([here, pos[right]])
            if len(both):
                index(both, self.pair_ranks(sym[both], sym[after[both]]))
        alive = sym >= 0
        kept = np.concatenate([[0], np.cumsum(alive)])
        return sym[alive], kept[ends] - kept[ends - sizes]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts of a flat buffer and their n + 1 offsets."""
        cuts, specials = self._segments(raw, offsets)
        starts, sizes, hashes = [], [], []
        for i, j in flat.blocks(cuts):
            part, base = raw[cuts[i] : cuts[j]], cuts[i]
            s = piece_starts(part, cuts[i : j + 1] - base)
            for place, size, _ in specials:  # an added token's string is one piece
                if cuts[i] <= place < cuts[j]:
                    s = s[(s <= place - base) | (s >= place - base + size)]
            e = np.append(s[1:], len(part)) if len(s) else s
            starts.append(s + base)
            sizes.append(e - s)
            hashes.append(flat.span_hashes(part, s, e))
        flat.release_powers()
        start, size, h = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, sizes, hashes))
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        _, sample, which = np.unique(h, return_index=True, return_inverse=True)
        same = _equal_spans(raw, start, start[sample][which], size, size[sample][which])
        if not same.all():  # equal hashes of unequal pieces: these are encoded one by one
            odd = np.flatnonzero(~same)
            which[odd] = len(sample) + np.arange(len(odd))
            sample = np.concatenate([sample, odd])
        ids, counts = self.merge(flat.gather(raw, start[sample], size[sample]), size[sample])
        at = np.cumsum(counts) - counts
        for place, _, token in specials:
            k = which[np.searchsorted(start, place)]
            ids = np.append(ids, np.int32(token))
            at[k], counts[k] = len(ids) - 1, 1
        n = counts[which]
        by = np.concatenate([[0], np.cumsum(n)])
        return flat.gather(ids, at[which], n), by[np.searchsorted(start, offsets)]

    def _segments(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Offsets with cuts around added tokens' strings, and the places, lengths and ids of these."""
        data, spans = None, []
        for content, token in self.special.items():
            data = raw.tobytes() if data is None else data
            at = data.find(content)
            while at >= 0:
                if at + len(content) <= offsets[np.searchsorted(offsets, at, "right")]:
                    spans.append((at, at + len(content), token))
                    at = data.find(content, at + len(content))
                else:
                    at = data.find(content, at + 1)
        if not spans:
            return offsets, []
        return np.unique(np.concatenate([offsets, [a for a, _, _ in spans], [b for _, b, _ in spans]])), [(a, b - a, t) for a, b, t in spans]

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of the text of ids."""
        data = flat.gather(self.token_bytes, self.token_at[ids], self.token_size[ids]).tobytes()
        try:
            data.decode()
            return data
        except UnicodeDecodeError:
            return data.decode(errors="replace").encode()


def _equal_spans(raw: np.ndarray, a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    same = a_size == b_size
    todo, k = np.flatnonzero(same & (a != b)), 0
    while len(todo):
        equal = raw[a[todo] + k] == raw[b[todo] + k]
        same[todo[~equal]] = False
        k += 1
        todo = todo[equal & (a_size[todo] > k)]
    return same


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode(path: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            raw, at = flat.text_buffer(batch.column("text"))
            for i, j in flat.blocks(at, block_bytes):
                ids, by = own.encode(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                blobs = [ids[by[k] : by[k + 1]].astype("<u4").tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array(np.diff(by)), pa.array(blobs, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = [own.decode(np.frombuffer(x.as_buffer(), "<u4").astype(np.int64)) if x.is_valid else b"" for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_tokens", "ids")), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(doc_id, text) as doc_id, n_tokens and ids (little-endian unsigned 32-bit values)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_encode(path or tokens.default_path(), block_bytes), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encode()'s rows with the decoded text."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decode(path or tokens.default_path()), "doc_id long, n_tokens long, ids binary, decoded string")
