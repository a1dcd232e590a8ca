"""Written tables and the driver's tables, for the operators of this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.session import shared_dir, written

__all__ = ["shared_dir", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
