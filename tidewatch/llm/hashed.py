"""Words of Arrow string columns as 64-bit hashes, by numpy and without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at a time, and that a slice of a batch holds about.
PIECE, SLICE = 1 << 20, 1 << 21
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE + (1 << 16))
        for name, base in (("up", BASE), ("down", BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` bytes of text; one row at least."""
    col = batch.column(batch.schema.get_field_index(text))
    size = np.cumsum(np.nan_to_num(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(float)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and where each row begins (one more entry than rows)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def word_spans(raw: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and where each row's words begin."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~space[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    before[off[off < len(raw)]] = False
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    after[off[off > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z become a-z."""
    return raw + np.where((raw >= 65) & (raw <= 90), np.uint8(32), np.uint8(0))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span (disjoint, in order), the same wherever it stands."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, first + PIECE, "right")))
        piece = raw[first : ends[to - 1]]
        up, down = _pow(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=total[1:])
        s, e = starts[at:to] - first, ends[at:to] - first
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def words(col: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the column, and where each row's words begin."""
    raw, off = utf8(col)
    starts, ends, rows = word_spans(raw, off)
    return span_hashes(lowered(raw) if lower else raw, starts, ends), rows


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on, as far as n are left."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out * BASE + hashes[k : len(hashes) - n + 1 + k])
    return out


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """The distinct shingles of one text, sorted; a text of fewer words is one shingle, none has none."""
    return np.unique(shingles(hashes, min(n, len(hashes)))) if len(hashes) else np.zeros(0, np.uint64)
