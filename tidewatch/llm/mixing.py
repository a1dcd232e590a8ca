"""Mixing sources to target weights by systematic sampling.

Each document of a source expects the same number of copies (target words over
source words). Documents stand on a line in the order of their size class, a
salt and their size; the expected copies are summed along it, one random
offset per source is added, and a copy is emitted per integer crossed. As the
sizes are laid out in order, what one document has too much its neighbours of
like size have too little, and the words taken miss the target by no more than
a part of the largest document.

The prefix sum is taken over counts in three steps (rows within a cell of
source, class and salt; cells within a class; classes within a source), so no
task holds a whole source. Sources are numbered and levelled without a window
over all of them, as they may be as many as hosts are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.store import written
from tidewatch.llm.words import space_words

#: Rows that a cell of the largest source holds about, and the least number of salts.
CELL_ROWS, LEAST_SALTS = 50_000, 32
MAX_COPIES = 3


def word_count(text: Column) -> Column:
    return F.size(space_words(text)).cast("long")


def _source_key() -> Column:
    """The source as text that is never null, so that equal keys meet by plain equality."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def _numbered(sources: DataFrame) -> DataFrame:
    """Sources with ``number``, their place by code point from 0, null last: places within sorted partitions and what stands before these."""
    key = [F.col("source").isNull(), F.col("source")]
    parts = written(sources.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id()), "mixing-sources")
    order = Window.partitionBy("part").orderBy(*key)
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")  # a row for each partition
    return parts.join(F.broadcast(before), "part").withColumn("number", F.col("before") + F.row_number().over(order) - 1).drop("part", "before")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_copies: float = MAX_COPIES) -> DataFrame:
    """(source, source_size, n_docs, target) from rows (source, size).

    Weights repeat over the sources by code point, null last. Targets are ``min(max_copies * size, level * weight)`` with the
    level at which they add up to all words. As in sharing the excess again and again, the sources above the level are
    capped and the level is taken anew from the others, until none is above; each round is one aggregation. A source without
    words gets 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    per = _numbered(per).withColumn("w", weight).withColumn("cap", F.col("source_size") * float(max_copies)).withColumn("cap_level", F.col("cap") / F.col("w"))
    per = written(per, "mixing-levels")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        over = F.col("cap_level") < level
        capped, weighing = per.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("w")))).first()
        new = (total - capped) / weighing if weighing else level
        if new <= level:
            break
        level = new
    return per.select("source", "source_size", "n_docs", F.least(F.col("cap"), F.lit(float(level)) * F.col("w")).alias("target"))


def systematic_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row with its ``size``, ``source_size``, ``target`` and ``copies`` (0 to 3), and the columns in ``keep``.

    Null text has size 0; a null source is a source; null ids are ordinary rows. Rows equal in id, size and text are
    interchangeable: which of them gets a copy doesn't show, and one cell counts them all. Reruns agree, as the order and
    the offsets are hashes. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("mix"),
        *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)],
    )
    if not keep:
        rows = written(rows, "mixing-sizes")
    targets = written(source_targets(rows), "mixing-targets")
    largest = targets.agg(F.max("n_docs")).first()[0] or 1
    salts = max(LEAST_SALTS, 2 ** math.ceil(math.log2(largest / CELL_ROWS + 1)))

    # a class holds sizes that differ by an eighth at most
    octave = F.floor(F.log2(F.col("size") + 1.0))
    rows = rows.withColumn("class", (octave * 8 + F.floor((F.col("size") + 1) / F.pow(F.lit(2.0), octave) * 8 - 8)).cast("int"))
    rows = rows.withColumn("salt", F.pmod("mix", F.lit(salts)).cast("int"))
    rows = rows.withColumn("skey", _source_key())
    cells = rows.groupBy("skey", "class", "salt").agg(F.count(F.lit(1)).alias("n"))
    classes = cells.groupBy("skey", "class").agg(F.sum("n").alias("n_class"))
    upto = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("before_class", F.coalesce(F.sum("n_class").over(upto("skey", "class")), F.lit(0)))
    cells = cells.withColumn("before_cell", F.coalesce(F.sum("n").over(upto("skey", "class", "salt")), F.lit(0)))

    starts = (
        cells.join(classes, ["skey", "class"]).join(targets.withColumn("skey", _source_key()), "skey")
        .select("skey", "class", "salt", (F.col("before_class") + F.col("before_cell")).alias("start"), "source_size", "target")
    )
    each = F.when(F.col("source_size") > 0, F.least(F.lit(float(MAX_COPIES)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    starts = written(starts.withColumn("each", each), "mixing-starts")
    order = Window.partitionBy("skey", "class", "salt").orderBy("size", "mix", "doc_id")

    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), F.col("skey")), F.lit(1 << 30)) / float(1 << 30)
    edge = lambda k: F.floor(k * F.col("each") + offset)
    copies = F.least(F.lit(MAX_COPIES), edge(F.col("at")) - edge(F.col("at") - 1)).cast("long")
    out = rows.withColumn("row", F.row_number().over(order)).join(starts, ["skey", "class", "salt"]).withColumn("at", F.col("start") + F.col("row"))
    return out.select(
        F.col("doc_id").alias(id_col),
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        copies.alias("copies"),
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)],
    )


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Each row as often as it has copies."""
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).drop("_copy")
