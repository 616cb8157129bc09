"""Several numpy arrays in one compressed binary cell."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def packed(*arrays: np.ndarray) -> bytes:
    head = [struct.pack("<H", len(arrays))]
    for a in arrays:
        head.append(a.dtype.str.encode().ljust(4) + struct.pack("<Q", len(a)))
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + [np.ascontiguousarray(a).tobytes() for a in arrays]))


def unpacked(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<H", data)
    at, out = 2 + 12 * n, []
    for i in range(n):
        kind = np.dtype(data[2 + 12 * i : 6 + 12 * i].decode().strip())
        (size,) = struct.unpack_from("<Q", data, 6 + 12 * i)
        out.append(np.frombuffer(data, kind, size, at))
        at += kind.itemsize * size
    return out


def joined_bytes(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as one array and the offsets of each."""
    ends = np.cumsum([0, *map(len, items)], dtype=np.int64)
    return np.frombuffer(b"".join(items), np.uint8), ends


def split_bytes(data: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw, e = data.tobytes(), ends.tolist()
    return [raw[a:b] for a, b in zip(e, e[1:])]
