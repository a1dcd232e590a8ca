"""A night of made-up telemetry, the same at every call: each value is a function of its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import schema as S

#: For each metric the seconds between points, the middle and the swing of its values, and the unit.
SERIES = {
    "heart_rate": (5, 58.0, 8.0, "bpm"), "hrv_rmssd": (300, 45.0, 15.0, "ms"), "steps": (60, 0.0, 12.0, "count"),
    "temperature": (60, 19.5, 1.5, "celsius"), "humidity": (60, 45.0, 6.0, "percent"), "pressure": (60, 1013.0, 2.0, "hpa"),
}
#: Heart rate is missing for these seconds from the middle of the night on.
GAP_S = 900


def _noise(metric: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(metric), F.col("k")), F.lit(2001)) / 1000.0 - 1


def night(spark: SparkSession, start_us: int, hours: int = 8, seed: int = 1) -> DataFrame:
    """(source, metric, us, value, unit) of one night with a gap in its heart rate and few steps."""
    out = None
    for metric, (every, middle, swing, unit) in SERIES.items():
        n = hours * 3600 // every
        wave = F.sin(F.col("k") * (8.0 / n)) * swing + _noise(metric, seed) * swing / 4
        value = F.when(_noise(metric, seed) > 0.85, F.round(F.abs(wave))).otherwise(0.0) if metric == "steps" else F.round(middle + wave, 1)
        rows = spark.range(n).withColumnRenamed("id", "k").select("k", (F.lit(start_us) + F.col("k") * every * S.US).alias("us"), value.cast("double").alias("value"))
        if metric == "heart_rate":
            rows = rows.filter((F.col("k") < n // 2) | (F.col("k") >= n // 2 + GAP_S // every))
        rows = rows.select(F.lit("sensorpush" if metric in S.ROOM_METRICS else "fitbit").alias("source"), F.lit(metric).alias("metric"), "us", "value", F.lit(unit).alias("unit"))
        out = rows if out is None else out.unionByName(rows)
    return out
