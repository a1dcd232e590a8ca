"""Arrays of numbers packed in one compressed binary value."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa


def packed(*parts: bytes) -> bytes:
    whole = struct.pack(f"<I{len(parts)}Q", len(parts), *[len(p) for p in parts]) + b"".join(parts)
    return struct.pack("<Q", len(whole)) + pa.compress(whole, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> list[bytes]:
    whole = pa.decompress(blob[8:], decompressed_size=struct.unpack_from("<Q", blob)[0], codec="zstd", asbytes=True)
    (n,) = struct.unpack_from("<I", whole)
    edges = np.cumsum([4 + 8 * n, *struct.unpack_from(f"<{n}Q", whole, 4)])
    return [whole[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def planes(x: np.ndarray, width: int = 4) -> bytes:
    """Numbers of ``width`` bytes, all lowest bytes first, then the next ones."""
    return np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def numbers(b: bytes, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.uint64)
