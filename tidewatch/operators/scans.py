"""Scans along an ordered key whose state is one number, for keys of any length.

A value that may change only so fast is a function of the value before: far off
it moves by the largest change, near the target it is the target. A run of such
steps is a function of the value before the run, continuous, rising by slopes of
one between flat places. Each place that becomes flat shortens what the function
can give by twice the largest change, so few corners describe a run of any
length. Rows are sorted by range; keys within one partition are done there, of
others each partition gives its function, these are applied in order, and the
rows are then scanned again in parallel from the value that each part starts at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import written

DONE, PIECE, ROW = range(3)


def limited(x: np.ndarray, most: np.ndarray, start: float | None) -> np.ndarray:
    """Each value as near to its target ``x`` as a change of ``most`` since the value before allows. Without a start the first target stands."""
    if not len(x):
        return x
    before = np.concatenate([[x[0] if start is None else start], x[:-1]])
    late = np.flatnonzero(np.abs(x - before) > np.maximum(most, 0.0))  # what stands before a key says nothing of its first row
    out = x.copy()
    at, n = 0, len(x)
    xs, ms = x.tolist(), most.tolist()
    for k in late.tolist():
        if k < at:
            continue
        v = float(before[k])
        at = k
        while at < n:  # until the target is met again
            t, m = xs[at], ms[at]
            v = v - m if v - m > t else v + m if v + m < t else t
            out[at] = v
            at += 1
            if v == t:
                break
    return out


class Run:
    """What steps make of the value before them, for values from ``low`` to ``high``: corners (given, result)."""

    def __init__(self, low: float, high: float):
        self.given, self.result = np.array([low, high]), np.array([low, high])

    def step(self, x: float, most: float) -> None:
        g, r = self.given, self.result
        if len(g) > 1:  # corners where the new flat place begins and ends
            for edge in (x - most, x + most):
                k = int(np.searchsorted(r, edge))
                if 0 < k < len(r) and r[k - 1] < edge < r[k]:
                    g, r = np.insert(g, k, g[k - 1] + (edge - r[k - 1])), np.insert(r, k, edge)
        r = np.maximum(r - most, np.minimum(r + most, x))
        if len(r) > 2:  # corners inside a flat place, or on a line, go
            up = np.diff(r) > 0
            keep = np.concatenate([[True], up[1:] != up[:-1], [True]])
            g, r = g[keep], r[keep]
        self.given, self.result = g, r

    def steps(self, x: np.ndarray, most: np.ndarray) -> None:
        for k in range(len(x)):
            if self.result[0] == self.result[-1]:  # the value before no longer matters
                self.given, self.result = self.given[:1], limited(x[k:], most[k:], float(self.result[0]))[-1:]
                return
            self.step(float(x[k]), float(most[k]))

    def value(self, v: float) -> float:
        if self.result[0] == self.result[-1]:
            return float(self.result[0])
        k = min(max(int(np.searchsorted(self.given, v, "right")) - 1, 0), len(self.given) - 2)
        a, b = float(self.result[k]), float(self.result[k + 1])
        return a if a == b else min(b, max(a, a + (v - float(self.given[k]))))


def _segments(table: pa.Table, keys: int) -> list[tuple[int, int]]:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in range(keys):
        codes = table.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    cuts = np.flatnonzero(new).tolist()
    return list(zip(cuts, [*cuts[1:], table.num_rows], strict=True))


def _most(time: np.ndarray, rate: np.ndarray, by_time: bool) -> np.ndarray:
    """The largest change at each row but the first of a piece, where it stands for one step or for the time since zero."""
    return rate * np.diff(time, prepend=0.0) if by_time else rate


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names]


def _scan(keys: int, by_time: bool, low: float, high: float):
    """Whole keys are done; the first and the last key of a partition, which may go on in others, give their function and their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        first = True

        def given(table: pa.Table, kind: int, out: np.ndarray, corners: list | None = None) -> Iterator[pa.RecordBatch]:
            empty = pa.array([None] * table.num_rows, pa.list_(pa.float64()))
            t = table.append_column("_kind", pa.array(np.full(table.num_rows, kind, np.int32))).append_column("out", pa.array(out))
            t = t.append_column("_given", pa.array([corners[0]], pa.list_(pa.float64())) if corners else empty).append_column("_result", pa.array([corners[1]], pa.list_(pa.float64())) if corners else empty)
            return iter(t.append_column("_last", pa.array([corners[2]] if corners else [None] * table.num_rows, pa.float64())).combine_chunks().to_batches())

        def opened(table: pa.Table) -> Iterator[pa.RecordBatch]:
            x, time, rate = _columns(table, "_x", "_time", "_rate")
            whole = Run(low, high)
            whole.steps(x[1:], _most(time, rate, by_time)[1:])
            yield from given(table.slice(0, 1), PIECE, np.zeros(1), [whole.given.tolist(), whole.result.tolist(), float(time[-1])])
            yield from given(table, ROW, np.zeros(table.num_rows))

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            parts = _segments(held, keys)
            if len(parts) == 1:
                continue
            if first:
                yield from opened(held.slice(0, parts[0][1]))
                parts, first = parts[1:], False
            if len(parts) > 1:
                whole = held.slice(parts[0][0], parts[-1][0] - parts[0][0])
                x, time, rate = _columns(whole, "_x", "_time", "_rate")
                most, base = _most(time, rate, by_time), parts[0][0]
                out = [limited(x[a - base : b - base], most[a - base : b - base], None) for a, b in parts[:-1]]
                yield from given(whole, DONE, np.concatenate(out))
            held = held.slice(parts[-1][0])
        if held is not None:
            yield from opened(held)

    return run


def _begun(keys: int, by_time: bool):
    """(keys, part, value, time) before each part, from the parts' functions sorted by key and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, value, at = None, None, None
        for batch in batches:
            begun, when = [], []
            rows = batch.to_pylist()
            for r in rows:
                key = tuple(r.values())[:keys]
                if key != now:
                    now, value, at = key, None, None
                begun.append(value)
                when.append(at)
                if value is None:
                    value = r["_x"]
                else:
                    most = r["_rate"] * (r["_time"] - at) if by_time else r["_rate"]
                    value = max(value - most, min(value + most, r["_x"]))
                function = Run(0.0, 1.0)
                function.given, function.result = np.array(r["_given"]), np.array(r["_result"])
                value, at = function.value(value), r["_last"]
            cols = [batch.column(k) for k in range(keys)] + [batch.column(batch.schema.get_field_index("_part"))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(begun, pa.float64()), pa.array(when, pa.float64())], [*batch.schema.names[:keys], "_part", "_start", "_since"])

    return run


def _resumed(keys: int, by_time: bool):
    """Rows of parts sorted by key and part, each with the value before its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(table: pa.Table, parts: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            out = []
            for a, b in parts:
                x, time, rate, start, since = _columns(table.slice(a, b - a), "_x", "_time", "_rate", "_start", "_since")
                most = _most(time, rate, by_time).copy()
                begun = None if np.isnan(start[0]) else float(start[0])
                if begun is not None and by_time:
                    most[0] = rate[0] * (time[0] - since[0])
                out.append(limited(x, most, begun))
            n = parts[-1][1]
            t = table.slice(0, n)
            return iter(t.set_column(t.schema.get_field_index("out"), "out", pa.array(np.concatenate(out))).combine_chunks().to_batches())

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            parts = _segments(held, keys + 1)
            if len(parts) > 1:
                yield from done(held, parts[:-1])
                held = held.slice(parts[-1][0])
        if held is not None:
            yield from done(held, _segments(held, keys + 1))

    return run


def slew(rows: DataFrame, keys: list[str], order: list[str], value: str, rate: str, by_time: bool = False) -> DataFrame:
    """(keys, order, value, out): ``out`` follows ``value`` in order, at first equal to it, then changing by at most ``rate`` a row, or for each
    unit of the first column of ``order`` with ``by_time``.

    Values, rates and times aren't null; rows of a key are distinct in ``order``. A key may be longer than any task's memory.
    """
    own = rows.select(*keys, *order, F.col(value).cast("double").alias("_x"), F.col(order[0]).cast("double").alias("_time"), F.col(rate).cast("double").alias("_rate"))
    own = written(own, "slew-rows")
    bounds = own.agg(F.coalesce(F.min("_x"), F.lit(0.0)).alias("low"), F.coalesce(F.max("_x"), F.lit(0.0)).alias("high")).first()
    ranged = own.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_part", F.spark_partition_id())
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    shape = ", ".join([*[f"`{c}` {t}" for c, t in kinds.items()], "_part int, _kind int, out double, _given array<double>, _result array<double>, _last double"])
    found = written(ranged.mapInArrow(_scan(len(keys), by_time, bounds["low"], bounds["high"]), shape), "slew-parts")
    pieces = found.filter(F.col("_kind") == PIECE).repartition(*keys).sortWithinPartitions(*keys, "_part")
    names = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    begun = pieces.mapInArrow(_begun(len(keys), by_time), f"{names}, _part int, _start double, _since double")
    open_rows = found.filter(F.col("_kind") == ROW).join(written(begun, "slew-begun"), [*keys, "_part"])
    columns = [*keys, "_part", *order, "_x", "_time", "_rate", "_start", "_since", "out"]
    sorted_rows = open_rows.select(*columns).repartition(*keys, "_part").sortWithinPartitions(*keys, "_part", *order)
    resumed = sorted_rows.mapInArrow(_resumed(len(keys), by_time), sorted_rows.schema)
    told = [*keys, *order, F.col("_x").alias(value), "out"]
    return found.filter(F.col("_kind") == DONE).select(*told).unionByName(resumed.select(*told))
