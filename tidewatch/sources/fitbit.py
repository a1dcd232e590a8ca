"""Wearable exports: JSON and CSV files, in folders or in ZIP archives, as canonical tables.

Files are matched by name; the date in the name prunes what is read. JSON is
parsed as VARIANT, so a missing field (the row is skipped) differs from a bad
value (the value is skipped).
"""

from __future__ import annotations

import csv
import io
import lzma
import zipfile
import zlib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions import scalars as X

#: File kinds by the last part of the path, any case; the group is the date (fixed patterns).
NAMES = {
    "sleep": r"(?i)^sleep-(\d{4}-\d{2}-\d{2})\.json$",
    "heart_rate": r"(?i)^heart_rate-(\d{4}-\d{2}-\d{2})\.json$",
    "steps": r"(?i)^steps-(\d{4}-\d{2}-\d{2})\.json$",
    "hrv_details": r"(?i)^heart rate variability details - (\d{4}-\d{2}-\d{2})\.csv$",
    "hrv_daily": r"(?i)^daily heart rate variability summary - (\d{4}-\d{2}(?:-\d{2})?)\.csv$",
}
#: Kinds whose files are pruned by the day in their name.
INTRADAY = ("heart_rate", "steps", "hrv_details")
#: Kinds whose times are UTC unless overridden; the others are in the display zone.
UTC_KINDS = ("heart_rate", "steps")
MEMBER_CAP = 200 * 1024 * 1024
UNREADABLE = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, OSError, EOFError, NotImplementedError, RuntimeError, ValueError)
MEMBERS = "path string, name string, content binary, skipped string"


@dataclass(frozen=True)
class Export:
    """What an export holds: points, logs with their intervals, daily HRV; and what was left out.

    ``files`` counts files by kind and reason of skipping; ``skipped`` rows and values by file; ``adjusted`` times that daylight
    saving skips or repeats, by file; ``unknown_levels`` stage names that aren't known, by file.
    """

    points: DataFrame
    logs: DataFrame
    intervals: DataFrame
    daily_hrv: DataFrame
    files: DataFrame
    skipped: DataFrame
    adjusted: DataFrame
    unknown_levels: DataFrame


def source_zones(display: str, overrides: Mapping[str, str] | None = None) -> dict[str, str]:
    """The zone that each kind of file is written in: an override, else UTC or the display zone."""
    unknown = set(overrides or ()) - {*NAMES, "sensorpush"}
    if unknown:
        raise ValueError(f"no such kinds of file: {sorted(unknown)}")
    return {k: "UTC" if k in UTC_KINDS else display for k in (*NAMES, "sensorpush")} | dict(overrides or {})


def base_name(path: Column) -> Column:
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))


def file_kind(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in NAMES.items():
        out = F.when(name.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def file_date(name: Column) -> Column:
    """The date in the name; a month stands for its first day, a date that doesn't exist is null."""
    out = F.lit("")
    for pattern in NAMES.values():
        out = F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1)).otherwise(out)
    return F.when(F.length(out) == 7, F.concat(out, F.lit("-01"))).otherwise(out).try_cast("date")


def route(path: Column) -> Column:
    """The source of a file: CSV files that aren't named like a wearable's are a room sensor's."""
    name = base_name(path)
    return F.when(F.lower(name).endswith(".csv") & file_kind(name).isNull(), "sensorpush").otherwise("fitbit")


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Archive members with their content, or the reason why one is skipped; one at a time."""
    row = lambda *cells: pd.DataFrame([cells], columns=["path", "name", "content", "skipped"])
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            try:
                archive = zipfile.ZipFile(io.BytesIO(bytes(content)))
                members = archive.infolist()
            except UNREADABLE:
                yield row(path, "", None, "corrupt archive")
                continue
            for m in members:
                name = m.filename.rsplit("/", 1)[-1]
                if m.is_dir():
                    continue
                if m.flag_bits & 1:
                    yield row(path, name, None, "encrypted")
                elif m.file_size > MEMBER_CAP:
                    yield row(path, name, None, "too large")
                else:
                    try:
                        data = archive.open(m).read(MEMBER_CAP + 1)
                        yield row(path, name, data, None) if len(data) <= MEMBER_CAP else row(path, name, None, "too large")
                    except UNREADABLE:
                        yield row(path, name, None, "corrupt member")


def _any_case(text: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in text)


def _globs(first_day: str, last_day: str) -> str:
    """File names with a day from the one before the first to the one after the last, and those that aren't pruned by day."""
    first, last = date.fromisoformat(first_day) - timedelta(1), date.fromisoformat(last_day) + timedelta(1)
    days = [(first + timedelta(k)).isoformat() for k in range((last - first).days + 1)]
    other = [_any_case("sleep-") + "*", _any_case("daily heart rate variability summary") + "*", "*." + _any_case("zip")]
    return "{" + ",".join([*[f"*{d}*" for d in days], *other]) + "}"


def read_files(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """(path, name, kind, file_date, text, skipped) of the files under ``path`` and in its archives.

    With days given, intraday files dated more than a day outside of them aren't opened: their names are left out of the
    listing, and members of archives before they are parsed. The report then has the files that were opened.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if first_day and last_day:
        reader = reader.option("pathGlobFilter", _globs(first_day, last_day))
    files = reader.load(path).select("path", "content")
    is_zip = F.lower(F.col("path")).endswith(".zip")
    loose = files.filter(~is_zip).select("path", base_name(F.col("path")).alias("name"), "content", F.lit(None).cast("string").alias("skipped"))
    every = loose.unionByName(files.filter(is_zip).mapInPandas(_members, MEMBERS))
    named = every.withColumn("kind", file_kind(F.col("name"))).withColumn("file_date", file_date(F.col("name")))
    if first_day and last_day:
        near = F.col("file_date").between(F.date_sub(F.lit(first_day).cast("date"), 1), F.date_add(F.lit(last_day).cast("date"), 1))
        named = named.filter(F.coalesce(~F.col("kind").isin(*INTRADAY), F.lit(True)) | F.col("file_date").isNull() | near)
    text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "^\ufeff", "")
    return named.select("path", "name", "kind", "file_date", text.alias("text"), "skipped")


def json_entries(files: DataFrame, kind: str) -> DataFrame:
    """(path, name, pos, entry) of files whose top level is an array; others give none."""
    parsed = files.filter((F.col("kind") == kind) & F.col("text").isNotNull()).select("path", "name", F.try_parse_json("text").alias("v"))
    arrays = parsed.filter(F.schema_of_variant("v").startswith("ARRAY"))
    return arrays.lateralJoin(arrays.sparkSession.tvf.variant_explode(F.col("v").outer())).select("path", "name", "pos", F.col("value").alias("entry"))


def judged(rows: DataFrame, metric: str, unit: str, zone: str) -> DataFrame:
    """Rows (name, present, at, x) with ts, value and ``problem``: a row without its fields or with a time that can't be read is skipped as a
    row, whatever its value; else a value that is no number in range is skipped as a value. ``at`` is (wall, offset_us)."""
    number = X.parse_number(F.col("x"))
    problem = F.when(~F.col("present") | F.col("at").isNull(), "row").when(~F.coalesce(X.in_range(F.lit(metric), F.col("value")), F.lit(False)), "value")
    both = rows.withColumn("value", number).withColumn("ts", X.instant(F.col("at"), zone)).withColumn("problem", problem)
    return both.withColumn("dst", F.when(problem.isNull(), X.dst_adjustment(F.col("at"), zone))).withColumn("metric", F.lit(metric)).withColumn("unit", F.lit(unit))


def points_of(rows: DataFrame) -> DataFrame:
    return rows.filter("problem is null").select(F.lit("fitbit").alias("source"), "metric", "ts", "value", "unit", F.col("name").alias("source_file"))


def skipped_of(rows: DataFrame) -> DataFrame:
    """(source_file, skipped, n): rows and values that were left out of each file."""
    return rows.filter("problem is not null").groupBy(F.col("name").alias("source_file"), F.col("problem").alias("skipped")).agg(F.count(F.lit(1)).alias("n"))


def adjusted_of(rows: DataFrame) -> DataFrame:
    """(source_file, adjustment, n): times that daylight saving skips or repeats."""
    return rows.filter("dst is not null").groupBy(F.col("name").alias("source_file"), F.col("dst").alias("adjustment")).agg(F.count(F.lit(1)).alias("n"))


def _json_rows(files: DataFrame, kind: str, path: str) -> DataFrame:
    e = json_entries(files, kind)
    field = lambda p: F.try_variant_get("entry", p, "variant").isNotNull()
    text = lambda p: F.try_variant_get("entry", p, "string")
    wall = X.short_timestamp(F.trim(text("$.dateTime")))
    at = F.when(wall.isNotNull(), F.struct(wall.alias("wall"), F.lit(None).cast("bigint").alias("offset_us")))
    return e.select("name", F.coalesce(field("$.dateTime") & field(path), F.lit(False)).alias("present"), at.alias("at"), text(path).alias("x"))


def heart_rate_rows(files: DataFrame, zone: str = "UTC") -> DataFrame:
    return judged(_json_rows(files, "heart_rate", "$.value.bpm"), "heart_rate", "bpm", zone)


def steps_rows(files: DataFrame, zone: str = "UTC") -> DataFrame:
    return judged(_json_rows(files, "steps", "$.value"), "steps", "count", zone)


def heart_rate(files: DataFrame, zone: str = "UTC") -> DataFrame:
    return points_of(heart_rate_rows(files, zone))


def steps(files: DataFrame, zone: str = "UTC") -> DataFrame:
    return points_of(steps_rows(files, zone))


#: One cell and what ends it: quoted, with quotes doubled, or bare.
_CELL = re.compile(r'(?:"((?:[^"]|"")*+)"|(?!")([^,\r\n]*+))(,|\r\n|\r|\n|\Z)')


def _records(text: str) -> tuple[list[list[str]], int | None]:
    """The records of a CSV text that aren't blank, and the line on which it stops being one (None: it doesn't)."""
    records, cells, at = [], [], 0
    while at < len(text):
        m = _CELL.match(text, at)
        if m is None:
            return records, 1 + len(re.findall(r"\r\n|\r|\n", text[:at]))
        quoted, bare, end = m.groups()
        cells.append(bare if quoted is None else quoted.replace('""', '"'))
        at = m.end()
        if end == ",":
            if at == len(text):
                cells.append("")
            continue
        records.append(cells)
        cells = []
    return [r for r in [*records, cells] if "".join(r).strip()], None


def _csv_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(name, t, x, problem) of the columns named timestamp and rmssd, whatever their case and place; or why a file can't be read."""
    wanted = ("timestamp", "rmssd")
    for pdf in batches:
        out = []
        for name, text in zip(pdf["name"], pdf["text"], strict=True):
            records, broken = _records(text)
            header, *rest = records or [[]]
            place = {c.strip().lower(): k for k, c in reversed([*enumerate(header)])}
            missing = " and ".join(c for c in wanted if c not in place)
            if broken is not None or missing:
                out.append((name, None, None, f"no column {missing}" if broken is None else f"no CSV from line {broken} on"))
                continue
            columns = [[r[place[c]] if place[c] < len(r) else None for r in rest] for c in wanted]
            out += [(name, t, x, None) for t, x in zip(*columns, strict=True)]
        yield pd.DataFrame(out, columns=["name", "t", "x", "problem"], dtype=object)


def csv_rows(files: DataFrame, kind: str) -> DataFrame:
    return files.filter((F.col("kind") == kind) & F.col("text").isNotNull()).select("name", "text").mapInPandas(_csv_cells, "name string, t string, x string, problem string")


def hrv_rows(files: DataFrame, zone: str) -> DataFrame:
    rows = csv_rows(files, "hrv_details").filter("problem is null")
    return judged(rows.select("name", F.lit(True).alias("present"), X.iso_parts(F.col("t")).alias("at"), "x"), "hrv_rmssd", "ms", zone)


def hrv_details(files: DataFrame, zone: str) -> DataFrame:
    return points_of(hrv_rows(files, zone))


def daily_hrv(files: DataFrame) -> DataFrame:
    """(date as written, rmssd, source_file)."""
    rows = csv_rows(files, "hrv_daily").filter("problem is null").select(X.iso_parts(F.col("t"))["wall"].cast("date").alias("date"), X.parse_number(F.col("x")).alias("rmssd"), F.col("name").alias("source_file"))
    return rows.filter("date is not null").filter(X.in_range(F.lit("hrv_rmssd"), F.col("rmssd")))


def sleep_logs(files: DataFrame, zone: str) -> tuple[DataFrame, DataFrame]:
    """Logs (log_id, start_us, end_us, is_main, has_stages, source_file) and their raw intervals.

    A level lasts from its time for its seconds, and is left out if these are no number that makes an end after its start; short data are brief awakenings whatever their level; a log without a valid
    level is one unknown interval. Logs that don't end after their start are left out.
    """
    e = json_entries(files, "sleep")
    get = lambda p, t="string": F.try_variant_get("entry", p, t)
    us = lambda c: F.unix_micros(X.instant(X.iso_parts(c), zone))
    logs = e.select(
        "name", "pos", F.nullif(F.trim(get("$.logId")), F.lit("")).alias("log_id"), us(get("$.startTime")).alias("start_us"), us(get("$.endTime")).alias("end_us"),
        F.coalesce(get("$.isMainSleep", "boolean"), F.lit(False)).alias("is_main"), F.coalesce(get("$.type") == "stages", F.lit(False)).alias("has_stages"),
        F.try_variant_get("entry", "$.levels.data", "array<variant>").alias("data"), F.try_variant_get("entry", "$.levels.shortData", "array<variant>").alias("short"),
    ).filter("start_us is not null and end_us > start_us")
    key = F.concat_ws("#", "name", F.col("pos").cast("string"))

    def level(v: Column, brief: bool) -> Column:
        seconds = F.try_variant_get(v, "$.seconds", "string").try_cast("double")
        name = F.lit("awake") if brief else X.stage_name(F.try_variant_get(v, "$.level", "string"))
        start = us(F.try_variant_get(v, "$.dateTime", "string"))
        return F.struct(start.alias("start_us"), F.try_add(start, (seconds * S.US).try_cast("bigint")).alias("end_us"), name.alias("stage"), F.lit(brief).alias("is_brief"))

    both = F.concat(F.transform("data", lambda v: level(v, False)), F.coalesce(F.transform("short", lambda v: level(v, True)), F.array().cast("array<struct<start_us:bigint,end_us:bigint,stage:string,is_brief:boolean>>")))
    good = F.filter(both, lambda x: x["start_us"].isNotNull() & (x["end_us"] > x["start_us"]))
    regular = F.exists(F.coalesce(good, F.array().cast("array<struct<start_us:bigint,end_us:bigint,stage:string,is_brief:boolean>>")), lambda x: ~x["is_brief"])
    whole = F.array(F.struct("start_us", "end_us", F.lit("unknown").alias("stage"), F.lit(False).alias("is_brief")))
    intervals = logs.select(key.alias("session_id"), F.posexplode(F.when(regular, good).otherwise(whole)).alias("src_idx", "x")).select("session_id", "src_idx", "x.*")
    return logs.select(key.alias("session_id"), "log_id", "start_us", "end_us", "is_main", "has_stages", F.col("name").alias("source_file")), intervals


def unknown_levels(files: DataFrame) -> DataFrame:
    """(source_file, level, n): names of stages that aren't known; their intervals are of the stage unknown."""
    e = json_entries(files, "sleep").select("name", F.explode(F.try_variant_get("entry", "$.levels.data", "array<variant>")).alias("v"))
    level = e.select("name", F.coalesce(F.trim(F.try_variant_get("v", "$.level", "string")), F.lit("")).alias("level"))
    return level.filter(X.lookup(F.lower("level"), S.STAGE_NAMES).isNull()).groupBy(F.col("name").alias("source_file"), "level").agg(F.count(F.lit(1)).alias("n"))


def read_export(spark: SparkSession, path: str, zone: str = "UTC", first_day: str | None = None, last_day: str | None = None, zones: Mapping[str, str] | None = None) -> Export:
    """All tables of an export. Heart rate and steps are written in UTC, everything else in the display zone, unless ``zones`` says otherwise for a kind."""
    files = read_files(spark, path, first_day, last_day)
    of = source_zones(zone, zones)
    logs, intervals = sleep_logs(files, of["sleep"])
    rows = [heart_rate_rows(files, of["heart_rate"]), steps_rows(files, of["steps"]), hrv_rows(files, of["hrv_details"])]
    union = lambda make: make(rows[0]).unionByName(make(rows[1])).unionByName(make(rows[2]))
    unread = csv_rows(files, "hrv_details").unionByName(csv_rows(files, "hrv_daily")).filter("problem is not null").select("name", F.col("problem").alias("_csv"))
    not_json = F.col("kind").isin("heart_rate", "steps", "sleep") & F.coalesce(~F.schema_of_variant(F.try_parse_json("text")).startswith("ARRAY"), F.lit(True))
    reason = F.coalesce("skipped", F.when(F.col("kind").isNotNull() & F.col("text").isNull(), "not UTF-8"), "_csv", F.when(not_json, "no JSON array"), F.lit(""))
    report = files.join(unread, "name", "left").groupBy(F.coalesce("kind", F.lit("unsupported")).alias("kind"), reason.alias("skipped")).agg(F.count(F.lit(1)).alias("files"))
    return Export(union(points_of), logs, intervals, daily_hrv(files), report, union(skipped_of), union(adjusted_of), unknown_levels(files))
