import io
import json
import random
import zipfile

import pytest

from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions import scalars as X
from tidewatch.operators import intervals
from tidewatch.sources import fitbit, readers, sensorpush, synthetic
from tidewatch.streaming import buckets


def export(folder):
    folder.mkdir()
    sleep = [{"logId": 7, "type": "stages", "isMainSleep": True, "startTime": "2024-03-01T22:00:00.000", "endTime": "2024-03-02T06:00:00.000", "levels": {
        "data": [{"dateTime": "2024-03-01T22:00:00.000", "level": "light", "seconds": 3600}, {"dateTime": "2024-03-01T23:00:00.000", "level": "core", "seconds": "60"}, {"dateTime": "bad", "level": "deep", "seconds": 5}],
        "shortData": [{"dateTime": "2024-03-01T22:10:00.000", "level": "wake", "seconds": 30}]}},
        {"logId": " ", "startTime": "2024-03-02T22:00:00.000", "endTime": "2024-03-02T23:00:00.000"}, {"startTime": "2024-03-02T22:00:00.000", "endTime": "2024-03-02T21:00:00.000"}, 5]
    (folder / "sleep-2024-03-01.json").write_text(json.dumps(sleep))
    heart = [{"dateTime": "03/01/24 22:00:00", "value": {"bpm": 60}}, {"dateTime": "03/01/24 22:00:05", "value": {"bpm": 300}}, {"dateTime": "3/1/24 22:00", "value": {"bpm": 60}}, 7, {"dateTime": "03/01/24 22:00:10", "value": {}}]
    with zipfile.ZipFile(folder / "more.zip", "w") as z:
        z.writestr("a/b/heart_rate-2024-03-01.json", "﻿" + json.dumps(heart))
        z.writestr("a/steps-2024-03-01.json", json.dumps([{"dateTime": "03/01/24 22:00:00", "value": "12"}, {"dateTime": "03/01/24 22:01:00", "value": 301}]))
        z.writestr("a/notes.txt", "x")
    (folder / "Heart Rate Variability Details - 2024-03-01.csv").write_text("RMSSD,other,Timestamp\n40.5,1,2024-03-01T22:05:00\n0,1,2024-03-01T22:10:00\nnan,1,2024-03-01T22:15:00\n")
    (folder / "Daily Heart Rate Variability Summary - 2024-03.csv").write_text("timestamp,rmssd\n2024-03-02T00:00:00,38\n")
    (folder / "heart_rate-2024-03-09.json").write_text("{}")
    (folder / "bad.zip").write_bytes(b"PK nothing")
    return folder


def test_export(spark, tmp_path):
    x = fitbit.read_export(spark, str(export(tmp_path / "in")), "America/New_York")
    got = sorted((r.metric, r.t, r.value) for r in x.points.select("metric", F.col("ts").cast("string").alias("t"), "value").collect())
    assert got == [("heart_rate", "2024-03-01 22:00:00", 60.0), ("hrv_rmssd", "2024-03-02 03:05:00", 40.5), ("steps", "2024-03-01 22:00:00", 12.0)]
    assert [(str(r.date), r.rmssd) for r in x.daily_hrv.collect()] == [("2024-03-02", 38.0)]
    assert sorted((r.log_id, r.is_main) for r in x.logs.fillna("-").collect()) == [("-", False), ("7", True)]
    report = {(r.kind, r.skipped): r.files for r in x.files.collect()}
    assert report[("unsupported", "")] == 1 and report[("unsupported", "corrupt archive")] == 1 and report[("heart_rate", "")] == report[("heart_rate", "no JSON array")] == 1
    seg = intervals.stage_segments(x.intervals, x.logs.select("session_id", "start_us", "end_us")).collect()
    assert sorted(r.stage for r in seg) == ["awake", "light", "light", "light", "unknown"]


def test_what_an_export_skips(spark, tmp_path):
    folder = export(tmp_path / "in")
    (folder / "Heart Rate Variability Details - 2024-11-03.csv").write_text('a,"timestamp","rm""x",RMSSD\r\n"x, ""y""\n z",2024-11-03T01:30:00,,41\r\n,2024-11-03T01:30:00-05:00,,42\n,2024-03-10 02:30,,43\n,soon,,44\n,2024-11-03T05:00:00Z,,0\n')
    (folder / "Heart Rate Variability Details - 2024-11-04.csv").write_text('timestamp,rmssd\n"open,1\n')
    (folder / "Daily Heart Rate Variability Summary - 2024-11-04.csv").write_text("time,value\n1,2\n")
    (folder / "steps-2024-11-05.json").write_bytes(b"\xff\xfe[")
    x = fitbit.read_export(spark, str(folder), "America/New_York")
    details = sorted((r.t, r.value) for r in x.points.filter("source_file like '%11-03%'").select(F.col("ts").cast("string").alias("t"), "value").collect())
    assert details == [("2024-03-10 07:30:00", 43.0), ("2024-11-03 05:30:00", 41.0), ("2024-11-03 06:30:00", 42.0)]
    skipped = {(r.source_file, r.skipped): r.n for r in x.skipped.collect()}
    assert skipped == {
        ("heart_rate-2024-03-01.json", "row"): 3, ("heart_rate-2024-03-01.json", "value"): 1, ("steps-2024-03-01.json", "value"): 1, ("Heart Rate Variability Details - 2024-03-01.csv", "value"): 2,
        ("Heart Rate Variability Details - 2024-11-03.csv", "row"): 1, ("Heart Rate Variability Details - 2024-11-03.csv", "value"): 1,
    }
    assert {(r.source_file[-14:], r.adjustment, r.n) for r in x.adjusted.collect()} == {("2024-11-03.csv", "nonexistent", 1), ("2024-11-03.csv", "ambiguous", 1)}
    report = {(r.kind, r.skipped): r.files for r in x.files.collect()}
    assert report[("hrv_details", "no CSV from line 2 on")] == report[("hrv_daily", "no column timestamp and rmssd")] == report[("steps", "not UTF-8")] == report[("heart_rate", "no JSON array")] == 1
    shifted = fitbit.read_export(spark, str(folder), "America/New_York", zones={"heart_rate": "Asia/Tokyo"})
    assert shifted.points.filter("metric = 'heart_rate'").select(F.col("ts").cast("string")).first()[0] == "2024-03-01 13:00:00"
    with pytest.raises(ValueError):
        fitbit.source_zones("UTC", {"weight": "UTC"})


def test_unknown_levels_are_counted(spark, tmp_path):
    log = {"startTime": "2024-03-01T22:00:00", "endTime": "2024-03-02T06:00:00", "levels": {"data": [{"dateTime": "2024-03-01T22:00:00", "level": v, "seconds": 60} for v in ("light", "Nap", "Nap", None, "CORE")]}}
    (tmp_path / "sleep-2024-03-01.json").write_text(json.dumps([log]))
    got = {(r.level, r.n) for r in fitbit.unknown_levels(fitbit.read_files(spark, str(tmp_path))).collect()}
    assert got == {("Nap", 2), ("", 1)}


def test_damaged_archives_are_skipped(spark, tmp_path):
    rng = random.Random(7)
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as z:
        for day in range(1, 6):
            z.writestr(f"steps-2024-03-0{day}.json", json.dumps([{"dateTime": f"03/0{day}/24 22:{m:02}:00", "value": str(rng.randrange(99))} for m in range(60)]))
    for i in range(25):
        data = bytearray(whole.getvalue())
        for _ in range(6):
            data[rng.randrange(len(data))] = rng.randrange(256)
        (tmp_path / f"a{i}.zip").write_bytes(data)
    files = fitbit.read_files(spark, str(tmp_path))
    assert {"corrupt member"} <= {r.skipped for r in files.select("skipped").distinct().collect()}
    assert fitbit.steps(files).count() > 0


def test_iso_and_sensor_times(spark):
    iso = {"2024-03-01T22:00:00+05:30": "2024-03-01 16:30:00", "2024-03-01 22:00Z": "2024-03-01 22:00:00", " 2024-03-01 ": "2024-03-01 05:00:00", "2024-03-01T22:00:00.1234567": "2024-03-02 03:00:00.123456",
           "2024-02-30 00:00": None, "2024-03-01T24:00": None, "": None, None: None, "2024-03-01T10:00+25:00": None, "03/01/2024": None}
    sensor = {"3/1/2024 10:01PM": "2024-03-02 03:01:00", "3/1/2024   1:01 am": "2024-03-01 06:01:00", "13/1/2024 1:00": None, "2024-03-01   10:00  +02:00": "2024-03-01 08:00:00", "3/1/2024 0:30 PM": None,
              "3/1/2024 12:30 AM": "2024-03-01 05:30:00", "2024-03-01 10:00+0200": None, "2024-03-10 02:30": "2024-03-10 07:30:00", "1.3.2024 10:00": None}
    for parse, cases in ((X.iso_parts, iso), (X.sensor_parts, sensor)):
        df = spark.createDataFrame([(c,) for c in cases], "t string")
        assert {r.t: r.i for r in df.select("t", X.instant(parse(F.col("t")), "America/New_York").cast("string").alias("i")).collect()} == cases


def test_target_durations():
    assert X.target_duration() == 180 and X.target_duration(None, 300) == 300 and X.target_duration(30.0, 300) == 30
    for bad in (True, "180", 45, 30.5):
        with pytest.raises(ValueError):
            X.target_duration(bad, 180)


def test_synthetic_night(spark):
    a, b = (sorted(map(tuple, synthetic.night(spark, 0, hours=1).collect())) for _ in range(2))
    n = {m: sum(r[1] == m for r in a) for m in S.METRICS}
    assert a == b and n == {"heart_rate": 720 - 180, "hrv_rmssd": 12, "steps": 60, "temperature": 60, "humidity": 60, "pressure": 60}


def test_imports_can_be_deleted(spark, tmp_path):
    df = spark.createDataFrame([("x", 1)], "name string, n int")
    path = str(tmp_path / "meta")
    for i in ("one", "two"):
        readers.write_partition(df, path, i)
    assert readers.delete_import(spark, "one", path) and not readers.delete_import(spark, "one", path)
    assert [r.import_id for r in spark.read.parquet(path).collect()] == ["two"]


def test_readers_give_points_and_skips(spark, tmp_path):
    (tmp_path / "room.csv").write_text('Time,"Temp\n(F)",Sensor\n2024-03-01 22:00,70,a\nbad,71,a\n2024-03-01 22:01,x,a\n')
    got = readers.reader("sensorpush")(spark, str(tmp_path), "UTC")
    assert [(r.value, r.unit) for r in got.points.collect()] == [(70.0, "fahrenheit")] and {(r.skipped, r.n) for r in got.skipped.collect()} == {("row", 1), ("value", 1)}
    assert readers.of_files(got.points, got.points.select("source_file").limit(0)).count() == 0


def test_pruning_by_date(spark, tmp_path):
    files = fitbit.read_files(spark, str(export(tmp_path / "in")), "2024-03-01", "2024-03-02")
    names = {r.name for r in files.select("name").collect()}
    assert "heart_rate-2024-03-09.json" not in names and {"sleep-2024-03-01.json", "heart_rate-2024-03-01.json", "Daily Heart Rate Variability Summary - 2024-03.csv"} <= names


def test_room_sensor(spark, tmp_path):
    (tmp_path / "room.csv").write_bytes("﻿Timestamp;Temperature;Relative Humidity (%);Dew point;Pressure (kPa);Sensor ID\n2024-03-01 22:00;68,5;40;9;100;a\n\n3/1/2024 10:01 PM;70;x;9;101;\n".encode())
    got = sorted((r.source, r.metric, r.value, r.unit) for r in sensorpush.read_sensorpush(spark, str(tmp_path)).collect())
    assert got == [
        ("sensorpush", "pressure", 101.0, "kpa"), ("sensorpush", "temperature", 70.0, "fahrenheit"), ("sensorpush:a", "humidity", 40.0, "percent"),
        ("sensorpush:a", "pressure", 100.0, "kpa"), ("sensorpush:a", "temperature", 68.5, "fahrenheit"),
    ]


def test_names_and_routing(spark):
    df = spark.createDataFrame([("/x/STEPS-2024-03-01.JSON",), ("/x/room.csv",), ("/x/Daily%20Heart%20Rate%20Variability%20Summary%20-%202024-02.csv",), ("/x/steps-2024-02-31.json",)], "p string")
    name = fitbit.base_name(F.col("p"))
    got = [tuple(r) for r in df.select(fitbit.file_kind(name), fitbit.file_date(name).cast("string"), fitbit.route(F.col("p"))).collect()]
    assert got == [("steps", "2024-03-01", "fitbit"), (None, None, "sensorpush"), ("hrv_daily", "2024-02-01", "fitbit"), ("steps", None, "fitbit")]


def test_telemetry_round_trip_and_replacement(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, "a", "steps", 2.0, "count")], "session_id string, us bigint, source string, metric string, value double, unit string")
    path = str(tmp_path / "t")
    for i, n in (("one", 1), ("two", 2), ("one", 3)):
        readers.write_telemetry(df.withColumn("us", F.lit(n).cast("bigint")), path, i)
    got = {(r.import_id, r.us) for r in readers.read_telemetry(spark, path, "session_id string, us bigint, source string, metric string, value double, unit string").collect()}
    assert got == {("one", 3), ("two", 2)}
    assert readers.names() == ["fitbit", "sensorpush"]


def test_streams(spark, tmp_path):
    rows = [("s", "m", f"2024-01-01 00:0{i // 2}:{i % 2}0", float(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "session_id string, metric string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, frame, mode in (("b", buckets.bucket_means(stream), "complete"), ("c", buckets.level_changes(stream, 3.0), "append")):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert [r.value for r in spark.sql("SELECT value FROM b ORDER BY us").collect()] == [0.5, 2.5, 4.5, 6.5]
    assert [r.value for r in spark.sql("SELECT value FROM c ORDER BY us").collect()] == [0.0, 3.0, 6.0]
