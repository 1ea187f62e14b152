"""Arrays of whole numbers as bytes, as narrow as their largest value allows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_WIDTHS = ((8, "<u1"), (16, "<u2"), (32, "<u4"), (64, "<u8"))


def pack(values: np.ndarray) -> bytes:
    """Values from 0 to below 2**64: one byte that tells the width, then the values."""
    most = int(values.max()) if len(values) else 0
    bits, kind = next(w for w in _WIDTHS if most >> w[0] == 0)
    return bytes([bits]) + values.astype(kind).tobytes()


def unpack(data: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(data, dict(_WIDTHS)[data[0]], offset=1).astype(kind)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending values below 2**64, as the first one and the steps between them. The steps' high bytes
    differ little, so bytes of one place stand together and are compressed."""
    data = pack(np.diff(values, prepend=np.zeros(1, values.dtype)))
    width = data[0] // 8
    return squeezed(data[:1] + np.frombuffer(data, "u1", offset=1).reshape(-1, width).T.tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    data = unsqueezed(data)
    planes = np.frombuffer(data, "u1", offset=1).reshape(data[0] // 8, -1)
    return np.cumsum(unpack(data[:1] + planes.T.tobytes(), np.uint64), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts of which most are small: a byte each, and 8 more for those from 255 on."""
    return len(counts).to_bytes(8, "little") + np.minimum(counts, 255).astype("u1").tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    out = np.frombuffer(data, "u1", n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=8 + n).astype(np.int64)
    return out


def squeezed(data: bytes) -> bytes:
    """The bytes compressed, for what is written and shuffled as a whole."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
