"""Array expressions whose work grows with the array to the power 1.5 at most.

A fold that appends to an array copies it at every step. Here an array of n is
cut in pieces of about the root of n; folds run within a piece and over pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _root(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.sqrt(n))).cast("int")


def fold_each(values: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The states of a fold, one for each value: ``step(state, value)`` gives the next; ``kind`` is their type as DDL."""
    cast = lambda c: c.cast(kind)
    none = F.array().cast(f"array<{kind}>")

    def over(piece: Column, first: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            return let(cast(step(acc["now"], x)), lambda n: F.struct(n.alias("now"), F.concat(acc["out"], F.array(n)).alias("out")))

        return F.aggregate(piece, F.struct(first.alias("now"), none.alias("out")), one)["out"]

    def of(v: Column) -> Column:
        size = _root(F.size(v))
        pieces = F.transform(F.sequence(F.lit(0), (F.ceil(F.size(v) / size) - 1).cast("int")), lambda k: F.slice(v, k * size + 1, size))

        def one(acc: Column, piece: Column) -> Column:
            return let(over(piece, acc["now"]), lambda o: F.struct(F.element_at(o, -1).alias("now"), F.concat(acc["out"], F.array(o)).alias("out")))

        begin = F.struct(cast(start).alias("now"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.when(F.size(v) > 0, F.flatten(F.aggregate(pieces, begin, one)["out"])).otherwise(none)

    return let(values, of)


def running_sum(values: Column) -> Column:
    """For each value the sum of those up to it."""
    return fold_each(values.cast("array<bigint>"), F.lit(0), lambda a, x: a + x, "bigint")


def running_max(values: Column) -> Column:
    """For each value (not negative) the largest of those up to it."""
    return fold_each(values.cast("array<bigint>"), F.lit(0), lambda a, x: F.greatest(a, x), "bigint")


def cut(text: Column, starts: Column, ends: Column) -> Column:
    """The pieces of a text from each start to its end (code points; sorted, without overlap). A text is walked through once for each piece
    of the root of n, and this for each place in it, not the whole text for each place."""

    def of(v: Column) -> Column:
        s, e, n = v["s"], v["e"], F.size(v["s"])
        size = _root(n)

        def piece(k: Column) -> Column:
            first, last = k * size, F.least((k + 1) * size, n) - 1
            lo = F.get(s, first)
            own = F.substr(v["t"], (lo + 1).cast("int"), (F.get(e, last) - lo).cast("int"))
            return let(own, lambda o: F.transform(F.sequence(first, last), lambda i: F.substr(o, (F.get(s, i) - lo + 1).cast("int"), (F.get(e, i) - F.get(s, i)).cast("int"))))

        whole = F.flatten(F.transform(F.sequence(F.lit(0), (F.ceil(n / size) - 1).cast("int")), piece))
        return F.when(n > 0, whole).otherwise(F.array().cast("array<string>"))

    return let(F.struct(text.alias("t"), starts.cast("array<bigint>").alias("s"), ends.cast("array<bigint>").alias("e")), of)
