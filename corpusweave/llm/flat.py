"""Texts of an Arrow batch as one flat UTF-8 buffer, and vectorised operations over it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd, so that powers have inverses modulo 2**64.
ROOT = 0x9E3779B97F4A7C15
ROOT_INVERSE = pow(ROOT, -1, 1 << 64)
BYTE_VALUES = np.random.default_rng(20240531).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Bytes of the words' separators.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(U64)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], most: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts with at most `most` bytes of text each, or one longer text."""
    for batch in batches:
        _, at = text_buffer(batch.column("text"))
        for i, j in blocks(at, most):
            yield batch.slice(i, j - i)


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of at most `most` bytes each, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of ROOT and of its inverse."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, ROOT, U64), np.full(size, ROOT_INVERSE, U64)
        up[0] = down[0] = 1
        _POWERS, _INVERSES = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[:n], _INVERSES[:n]


_POWERS = _INVERSES = np.ones(0, U64)


def release_powers() -> None:
    """Forget powers that an unusually long text made, and give back memory that Arrow keeps."""
    global _POWERS, _INVERSES
    pa.default_memory_pool().release_unused()
    if len(_POWERS) > 4 * BLOCK_BYTES:
        _POWERS = _INVERSES = np.ones(0, U64)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span raw[start:end], which does not depend on its place."""
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum(BYTE_VALUES[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without separators) and, for each text, the index of
    its first word (n + 1 entries). Words never cross texts."""
    space = IS_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    begin = ~space
    begin[1:] &= space[:-1] | first[1:-1]
    end = ~space
    end[:-1] &= space[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of `size` words (a shorter text with a word: of all its words)
    with the n + 1 offsets by text; repeated shingles are not removed."""
    starts, ends, first = word_spans(raw, offsets)
    words = span_hashes(raw, starts, ends)
    n_words = np.diff(first)
    counts = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(counts)), counts)
    here = first[:-1][doc] + np.arange(at[-1]) - at[:-1][doc]
    span = np.minimum(size, n_words)[doc]
    out = np.zeros(len(doc), U64)
    for k in range(size):
        use = span > k
        w = np.zeros(len(doc), U64)
        w[use] = words[here[use] + k]
        out = out * U64(ROOT) + w + U64(k + 1) * use.astype(U64)
    return mix(out), at


def _runs(lengths: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of spans of at most `most` values each, or of one longer span."""
    return blocks(np.concatenate([[0], np.cumsum(lengths)]), most)


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start : start + length] of each span, one after the other; the places are made for a
    part of the spans at a time."""
    out, at = np.empty(int(lengths.sum()), values.dtype), 0
    for i, j in _runs(lengths):
        n = int(lengths[i:j].sum())
        out[at : at + n] = values[starts[i] : starts[i] + n] if j == i + 1 else values[_places(starts[i:j], lengths[i:j])]
        at += n
    return out


def same(values: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether values[a : a + length] equals values[b : b + length], for spans that aren't empty."""
    out = np.ones(len(lengths), bool)
    for i, j in _runs(lengths):
        n = lengths[i:j]
        equal = values[_places(a[i:j], n)] == values[_places(b[i:j], n)]
        out[i:j] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return out
