"""As-of joins as a union and ordered windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(points: DataFrame, probes: DataFrame, keys: list[str], at: str = "us", carry: tuple[str, ...] = ("us", "value"), inclusive_before: bool = True, forward: bool = False) -> DataFrame:
    """Each probe with the carried columns of the last point before it (``prev_*``) and, if asked for, of the next one (``next_*``).

    The point before may stand at the probe's own time if ``inclusive_before``; the next one always may. Both sides have
    ``at``; points are distinct in (keys, at). Work is partitioned by the keys, and nothing is joined.
    """
    own = [c for c in probes.columns if c not in (*keys, at)]
    point = F.struct(*[F.col(c).alias(c) for c in carry])
    p = points.select(*keys, F.col(at), point.alias("_p"), F.lit(0).alias("_probe"), *[F.lit(None).cast(t).alias(c) for c, t in probes.select(*own).dtypes])
    q = probes.select(*keys, F.col(at), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.lit(1).alias("_probe"), *own)
    both = p.unionByName(q)
    first = F.col("_probe") if inclusive_before else -F.col("_probe")
    before = Window.partitionBy(*keys).orderBy(at, first).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_prev", F.last("_p", ignorenulls=True).over(before))
    if forward:
        after = Window.partitionBy(*keys).orderBy(F.desc(at), "_probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn("_next", F.last("_p", ignorenulls=True).over(after))
    found = [F.col(f"_prev.{c}").alias(f"prev_{c}") for c in carry]
    if forward:
        found += [F.col(f"_next.{c}").alias(f"next_{c}") for c in carry]
    return out.filter("_probe = 1").select(*keys, at, *own, *found)


def segment_at(segments: DataFrame, probes: DataFrame, target_s: int) -> DataFrame:
    """Probes (session_id, t) with the state of the segment (session_id, t0, t1, state) that holds them; the end belongs to the one that ends there."""
    found = as_of(segments.withColumn("t", F.col("t0")), probes, ["session_id"], at="t", carry=("t1", "state"))
    inside = (F.col("t") < F.col("prev_t1")) | (F.col("t") == float(target_s)) & (F.col("prev_t1") == float(target_s))
    return found.select("session_id", "t", F.when(inside, F.col("prev_state")).alias("state"))


def lerp(t: Column, t0: Column, v0: Column, t1: Column, v1: Column) -> Column:
    """Between (t0, v0) and (t1, v1), never beyond either value."""
    x = v0 + (v1 - v0) * ((t - t0) / (t1 - t0).cast("double"))
    return F.least(F.greatest(x, F.least(v0, v1)), F.greatest(v0, v1))
