"""A registry of readers, and telemetry as Parquet."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources import fitbit, sensorpush



@dataclass(frozen=True)
class LoadResult:
    """What a reader gives: points (source, metric, ts, value, unit, source_file), what it skipped (source_file, skipped, n), and candidate
    sessions with their intervals, if the source has any."""

    points: DataFrame
    skipped: DataFrame
    sessions: DataFrame | None = None
    intervals: DataFrame | None = None


Reader = Callable[..., LoadResult]
_readers: dict[str, Reader] = {}


def register(name: str, reader: Reader) -> None:
    if not name.strip() or ":" in name:
        raise ValueError(f"a reader's name is neither blank nor has a colon: {name!r}")
    if name in _readers:
        raise ValueError(f"there is a reader named {name} already")
    _readers[name] = reader


def unregister(name: str) -> None:
    _readers.pop(name, None)


def reader(name: str) -> Reader:
    return _readers[name]


def names() -> list[str]:
    return sorted(_readers)


def _fitbit(spark: SparkSession, path: str, zone: str = "UTC", **options) -> LoadResult:
    x = fitbit.read_export(spark, path, zone, **options)
    return LoadResult(x.points, x.skipped, x.logs, x.intervals)


def _sensorpush(spark: SparkSession, path: str, zone: str = "UTC") -> LoadResult:
    return LoadResult(sensorpush.read_sensorpush(spark, path, zone), sensorpush.skipped_cells(sensorpush.read_cells(spark, path, zone)))


register("fitbit", _fitbit)
register("sensorpush", _sensorpush)


def of_files(points: DataFrame, files: DataFrame) -> DataFrame:
    """The points that come from some files (source_file)."""
    return points.join(files.select("source_file").distinct(), "source_file", "left_semi")


def write_partition(rows: DataFrame, path: str, import_id: str) -> None:
    """Writes the rows of one import in place of those that it had; other imports stay. Metadata and telemetry are both kept like this."""
    write_telemetry(rows, path, import_id)


def delete_import(spark: SparkSession, import_id: str, *paths: str) -> bool:
    """Removes an import from all tables under ``paths``; whether there was any."""
    found = False
    for path in paths:
        part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/import_id={import_id}")
        found = bool(part.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(part, True)) or found
    return found


def write_telemetry(points: DataFrame, path: str, import_id: str) -> None:
    """Replaces one import, as a partition of its own; others stay."""
    spark = points.sparkSession
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        points.withColumn("import_id", F.lit(import_id)).write.mode("overwrite").partitionBy("import_id").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)


def read_telemetry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, import_id string").parquet(path)
