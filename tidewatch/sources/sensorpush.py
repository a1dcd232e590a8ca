"""Room-sensor CSV files: header classification, delimiter, units, and the long form."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import scalars as X

# What a header must hold.
IGNORED = ("dew", "vpd", "vapor", "vapour", "deficit")
TIMES = ("timestamp", "observed", "datetime", "date", "time")
SENSOR = ("sensor id", "sensorid", "sensor", "device")
RAW = "path string, line bigint, delimiter string, ts string, sensor string, metric string, header string, text string"


def column_kind(header: str) -> str | None:
    """What a column holds, by the words of its header; the first rule that fits decides."""
    h = header.strip().lower()
    words = set(re.findall("[0-9a-z]+", h))
    if any(w in h for w in IGNORED):
        return None
    if "temp" in h:
        return "temperature"
    if "humidity" in h or "rh" in words:
        return None if "absolute" in h else "humidity"
    if "pressure" in h or "baro" in h:
        return "pressure"
    if any(w in h for w in SENSOR):
        return "sensor"
    return "timestamp" if any(w in h for w in TIMES) else None


def header_unit(metric: Column, header: Column) -> Column:
    """The unit that a header names, by its leftmost token that stands alone; null if none does."""
    h = F.translate(F.lower(header), "º℉℃", "°fc")
    temp = F.regexp_extract(h, r"(?<![\p{L}])(fahrenheit|f|celsius|c)(?![\p{L}])", 1)
    press = F.regexp_extract(h, r"(?<![\p{L}])(inhg|hpa|mbar|kpa)(?![\p{L}])", 1)
    return (
        F.when((metric == "temperature") & temp.isin("f", "fahrenheit"), "fahrenheit").when((metric == "temperature") & temp.isin("c", "celsius"), "celsius")
        .when((metric == "pressure") & (press != ""), F.when(press == "mbar", "hpa").otherwise(press)).when(metric == "humidity", "percent")
    )


def infer_unit(metric: Column, median: Column) -> Column:
    """The unit that a column's median suggests; null leaves the column out."""
    return (
        F.when((metric == "temperature") & median.isNotNull(), F.when(median > 45, "fahrenheit").otherwise("celsius"))
        .when((metric == "pressure") & median.between(25, 32), "inhg").when((metric == "pressure") & median.between(90, 110), "kpa").when((metric == "pressure") & median.between(900, 1100), "hpa")
        .when(metric == "humidity", "percent")
    )


#: Rows of a file that are handed on at a time.
CHUNK = 10_000


def _delimiter(text: str) -> str:
    """A semicolon if the first record has more of them than commas, outside of quotes; a quoted cell may have line breaks."""
    head = re.sub(r'"[^"]*"', "", re.match(r'(?:[^"\n]|"[^"]*")*', text)[0])
    return ";" if head.count(";") > head.count(",") else ","


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each measurement cell of each file, some thousand rows of a file at a time."""
    names = [c.split()[0] for c in RAW.split(", ")]
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            raw = bytes(content)
            try:
                text = raw.decode("utf-8-sig")
            except UnicodeDecodeError:
                text = raw.decode("cp1252", errors="replace")
            delimiter = _delimiter(text)
            rows = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)
            kinds: dict[str, tuple[int, str]] = {}
            for i, h in enumerate(next(rows, [])):
                if (kind := column_kind(h)) and kind not in kinds:
                    kinds[kind] = (i, h)
            if "timestamp" not in kinds:
                continue
            out = []
            cell = lambda row, k, kinds=kinds: row[kinds[k][0]] if k in kinds and kinds[k][0] < len(row) else ""
            for n, row in enumerate(rows, 1):
                if any(c.strip() for c in row):
                    out += [(path, n, delimiter, cell(row, "timestamp"), cell(row, "sensor"), m, kinds[m][1], cell(row, m)) for m in ("temperature", "humidity", "pressure") if m in kinds]
                if len(out) >= CHUNK:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)


def read_cells(spark: SparkSession, path: str, zone: str = "UTC") -> DataFrame:
    """The cells of all files with ts, value and ``problem``: a row whose time can't be read, else a cell that has a text but no number."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[cC][sS][vV]").load(path).select("path", "content")
    cells = files.mapInPandas(_cells, RAW).withColumn("at", X.sensor_parts(F.col("ts")))
    value = X.parse_number(X.decimal_comma(F.col("text"), F.col("delimiter")))
    problem = F.when(F.col("at").isNull(), "row").when(F.col("value").isNull() & (F.trim("text") != ""), "value")
    return cells.withColumn("value", value).withColumn("ts", X.instant(F.col("at"), zone)).withColumn("problem", problem)


def skipped_cells(cells: DataFrame) -> DataFrame:
    """(source_file, skipped, n): rows without a time, and values that are no numbers, by file."""
    rows = cells.filter("problem = 'row'").groupBy(F.col("path").alias("source_file")).agg(F.countDistinct("line").alias("n")).withColumn("skipped", F.lit("row"))
    values = cells.filter("problem = 'value'").groupBy(F.col("path").alias("source_file")).agg(F.count(F.lit(1)).alias("n")).withColumn("skipped", F.lit("value"))
    return rows.unionByName(values).select("source_file", "skipped", "n")


def read_sensorpush(spark: SparkSession, path: str, zone: str = "UTC") -> DataFrame:
    """Points (source, metric, ts, value, unit, source_file) of room-sensor CSV files; cells and rows that can't be read are left out."""
    good = read_cells(spark, path, zone).filter("value is not null and ts is not null")
    middle = good.groupBy("path", "metric").agg(F.percentile("value", F.lit(0.5)).alias("mid"))
    known = good.join(middle, ["path", "metric"]).withColumn("unit", F.coalesce(header_unit(F.col("metric"), F.col("header")), infer_unit(F.col("metric"), F.col("mid"))))
    return known.filter("unit is not null").select(X.sensor_id(F.lit("sensorpush"), F.col("sensor")).alias("source"), "metric", "ts", "value", "unit", F.col("path").alias("source_file"))
