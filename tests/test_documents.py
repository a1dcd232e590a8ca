"""Manifests, fingerprints, plans, and rules of readers that one bad field must not break."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.operators import align as A
from tidewatch.operators import features as W
from tidewatch.operators import intervals as I
from tidewatch.operators import manifest as M
from tidewatch.operators import trajectories as T
from tidewatch.sources import fitbit, sensorpush

TARGET = 30
POINT = "session_id string, us bigint, source string, metric string, value double, unit string"


@pytest.fixture(scope="module")
def document(spark):
    sessions = spark.createDataFrame([("s", 1_700_000_000_000_000, 1_700_007_200_000_000, 60_000_000)], "session_id string, start_us bigint, end_us bigint, res_us bigint")
    states = spark.createDataFrame([("s", w, "light" if w < 20 else "deep") for w in range(60)], "session_id string, w int, state string")
    smoothed = spark.createDataFrame([("s", "temperature", w, 20.0 + w, w % 2 == 0) for w in range(60)], "session_id string, metric string, w int, smoothed double, present boolean")
    have = W.availability(spark.createDataFrame([("s", "temperature", 1.0), ("s", "temperature", None)], "session_id string, metric string, value double"), sessions)
    events = spark.createDataFrame([("s", "awakening", 1_700_003_600_000_000, 0.25, 15.0, "23:13 awakening")], "session_id string, type string, us bigint, magnitude double, replay_s double, label string")
    prints = spark.createDataFrame([("s", "abc")], "session_id string, fingerprint string")
    warnings = spark.createDataFrame([("s", 2, "second"), ("s", 1, "first")], "session_id string, at int, warning string")
    out = M.manifest(sessions, states, smoothed, have, events, prints, {"temperature": T.Route("brightness", 0.5, 1.0), "steps": T.Route(None, 0.0)}, TARGET, "America/St_Johns", 7, "2", warnings)
    return json.loads(out.first().manifest, parse_constant=float)


def test_manifest_has_every_field(document):
    assert list(document) == sorted(document) and len(document) == 16
    assert document["session_start"] == "2023-11-14T18:43:20.000000-03:30" and document["session_end"] == "2023-11-14T20:43:20.000000-03:30"
    assert document["coarse_states"] == [{"t0": 0.0, "t1": 10.0, "state": "light"}, {"t0": 10.0, "t1": 30.0, "state": "deep"}]
    assert document["environmental_windows"] == [[20.0 + w if w % 2 == 0 else None, None, None] for w in range(60)]
    assert document["availability"]["temperature"] == {"missing_fraction": 0.5, "status": "available"} and sorted(document["availability"]) == sorted(S.METRICS)
    assert document["unavailable_metrics"] == sorted(set(S.METRICS) - {"temperature"})
    assert document["night_events"] == [{"label": "23:13 awakening", "magnitude": 0.25, "night_time": "2023-11-14T19:43:20.000000-03:30", "replay_time_s": 15.0, "type": "awakening"}]
    assert document["mapping_config"]["temperature"] == {"hysteresis": 1.0, "sensitivity": 0.5, "target": "brightness"} and document["mapping_config"]["steps"]["target"] == "none"
    assert (document["compression_ratio"], document["timeline_resolution_s"], document["random_seed"], document["version"], document["warnings"]) == (240.0, 60, 7, "2", ["first", "second"])


BROKEN = {
    "session_start": {"session_start": "soon"}, "session_end": {"session_end": "2023-11-14T18:43:20.000000-03:30"}, "target_duration_s": {"target_duration_s": 31},
    "compression_ratio": {"compression_ratio": 239.0}, "timeline_resolution_s": {"timeline_resolution_s": 7},
    "night_events.night_time": {"night_events": [{"label": "x", "magnitude": 0.2, "night_time": "2023-11-14T21:43:20.000000-03:30", "replay_time_s": 1.0, "type": "awakening"}]},
    "night_events.replay_time_s": {"night_events": [{"label": "x", "magnitude": 0.2, "night_time": "2023-11-14T19:43:20.000000-03:30", "replay_time_s": 31.0, "type": "awakening"}]},
    "night_events.magnitude": {"night_events": [{"label": "x", "magnitude": 1.2, "night_time": "2023-11-14T19:43:20.000000-03:30", "replay_time_s": 1.0, "type": "awakening"}]},
    "night_events.type": {"night_events": [{"label": "x", "magnitude": 0.2, "night_time": "2023-11-14T19:43:20.000000-03:30", "replay_time_s": 1.0, "type": "party"}]},
    "environmental_windows": {"environmental_windows": [[None, None, None]] * 59}, "availability": {"availability": {}}, "unavailable_metrics": {"unavailable_metrics": ["steps"]},
    "random_seed": {"random_seed": -1}, "input_fingerprint": {"input_fingerprint": ""}, "version": {"version": None}, "warnings": {"warnings": [None]},
}


def test_each_check_of_a_manifest_can_fail(spark, document):
    cases = [("right", document), *[(k, document | v) for k, v in BROKEN.items()]]
    gap = [{"t0": 0.0, "t1": 9.0, "state": "light"}, {"t0": 10.0, "t1": 30.0, "state": "deep"}]
    worse = document["availability"] | {"steps": {"missing_fraction": 1.5, "status": "unavailable"}}
    cases += [("coarse_states", document | {"coarse_states": gap}), ("coarse_states2", document | {"coarse_states": []}), ("availability.missing_fraction", document | {"availability": worse})]
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in cases] + [("document", "no json")], "session_id string, manifest string")
    found = {}
    for r in M.manifest_problems(rows).collect():
        found.setdefault(r.session_id, set()).add(r.problem)
    assert "right" not in found
    for name, _ in [*cases[1:], ("document", None)]:
        assert name.rstrip("2") in found[name], (name, found.get(name))


def test_fingerprints_change_with_anything_but_order(spark):
    sessions = spark.createDataFrame([("s", 0, 100), ("t", 0, 100)], S.SESSIONS)
    points = [("s", i, "a", "heart_rate", float(i % 7), "bpm") for i in range(500)]
    segments = [("s", 0, 50, "light", False), ("s", 50, 100, "deep", True)]
    daily = spark.createDataFrame([("s", 41.0)], "session_id string, rmssd double")
    frame = lambda p: spark.createDataFrame(p, POINT)
    seg = lambda p: spark.createDataFrame(p, S.SEGMENTS)
    told = lambda *a, **k: {r.session_id: r.fingerprint for r in A.fingerprint(*a, block=64, **k).collect()}
    first = told(sessions, frame(points), seg(segments), daily)
    assert set(first) == {"s", "t"}
    assert told(sessions.repartition(3), frame(points[::-1]).repartition(5), seg(segments[::-1]), daily) == first
    others = [
        told(sessions, frame([*points, points[0]]), seg(segments), daily), told(sessions, frame(points[1:]), seg(segments), daily),
        told(sessions, frame([*points[1:], (*points[0][:4], 9.0, "bpm")]), seg(segments), daily), told(sessions, frame(points), seg(segments[:1]), daily),
        told(sessions, frame(points), seg([(*segments[0][:4], True), segments[1]]), daily), told(sessions, frame(points), seg(segments)),
        told(sessions, frame(points), seg(segments), daily.withColumn("rmssd", F.lit(40.0))), told(sessions, frame(points), seg(segments), daily, version="2"),
        told(sessions.withColumn("end_us", F.col("end_us") + 1), frame(points), seg(segments), daily),
    ]
    assert len({x["s"] for x in [first, *others]}) == 10


def test_seconds_that_are_no_length(spark):
    odd = ["inf", "nan", "1e300", 9.223e12, -1, True, None, "x", 0, 60]
    data = [{"dateTime": f"2024-03-01T22:{k:02d}:00", "level": "light", "seconds": s} for k, s in enumerate(odd)]
    log = {"logId": 5, "startTime": "2024-03-01T22:00:00", "endTime": "2024-03-02T06:00:00", "levels": {"data": data}}
    files = spark.createDataFrame([("x", "sleep-1.json", "sleep", json.dumps([log]))], "path string, name string, kind string, text string")
    logs, intervals = fitbit.sleep_logs(files, "UTC")
    assert logs.count() == 1 and [(r.end_us - r.start_us) // S.US for r in intervals.collect()] == [60]


def test_daily_figures_of_one_date_are_averaged(spark):
    sessions = spark.createDataFrame([("s", "me", 0, 3_600_000_000), ("u", "you", 0, 3_600_000_000)], "session_id string, subject string, start_us bigint, end_us bigint")
    none = spark.createDataFrame([], "session_id string, metric string, us bigint, value double")
    daily = spark.createDataFrame([("me", "1970-01-01", 30.0), ("me", "1970-01-01", 50.0), ("me", "1970-01-02", 9.0), ("you", "1970-01-01", 12.0)], "subject string, date string, rmssd double")
    got = sorted(map(tuple, A.attach_daily(sessions, none, daily.withColumn("date", F.to_date("date")), "UTC").collect()))
    assert got == [("s", 40.0), ("u", 12.0)]


def test_headers_are_known_by_what_they_hold():
    kinds = {"SensorID": "sensor", "TimestampUTC": "timestamp", "Observed": "timestamp", "Device": "sensor", "id": None, "Relative RH (%)": "humidity", "Absolute Humidity": None, "Dew Point": None, "Temperature (°F)": "temperature", "Baro": "pressure", "notes": None}
    assert {h: sensorpush.column_kind(h) for h in kinds} == kinds


def test_records_of_csv():
    assert fitbit._records('a,"b ""x""",c\r\n\r\n ,\n1,"two\nlines",\rlast') == ([["a", 'b "x"', "c"], ["1", "two\nlines", ""], ["last"]], None)
    assert fitbit._records("a,b\n1,") == ([["a", "b"], ["1", ""]], None)
    assert fitbit._records('a,b\n"x"y,1\n')[1] == 2 and fitbit._records('a\nb\n"never closed')[1] == 3
    assert fitbit._records("") == ([], None) and fitbit._records('it"s,1') == ([['it"s', "1"]], None)


def test_owners_of_long_and_short_intervals(spark):
    rng = random.Random(6)
    rows = []
    for k in range(120):
        start = rng.randrange(-500, 3000)
        rows.append((f"k{k % 3}", start, start + rng.choice([1, 2, 7, 40, 333, 2500]), f"c{k:03d}", rng.random() < 0.3))
    got = I.ownership(spark.createDataFrame(rows, "key string, start_us bigint, end_us bigint, content string, is_main boolean"), ["key"], unit_us=5)
    owner = {}
    for r in got.collect():
        for t in range(r.start_us, r.end_us):
            assert (r.key, t) not in owner
            owner[r.key, t] = r.content
    for key in ("k0", "k1", "k2"):
        own = [r for r in rows if r[0] == key]
        for t in range(-500, 5600):
            best = min((r for r in own if r[1] <= t < r[2]), key=lambda r: (not r[4], r[1] - r[2], r[1], r[3]), default=None)
            assert owner.get((key, t)) == (best and best[3]), (key, t)
    cells = I._dyadic(spark.createDataFrame([(0, 10**15, "x")], "start_us bigint, end_us bigint, content string"), 1)
    assert cells.count() <= 100


def test_a_plan_holds_brief_awakenings(spark):
    sessions = spark.createDataFrame([("s", 0, 7200 * S.US)], S.SESSIONS)
    segments = spark.createDataFrame([("s", 0, 100 * S.US, "awake", False), ("s", 100 * S.US, 3600 * S.US, "light", False), ("s", 3600 * S.US, 7200 * S.US, "awake", False)], S.SEGMENTS)
    brief = W.brief_starts(segments, sessions, TARGET)  # under 240 s, as two hours are played in half a minute
    assert [tuple(r) for r in brief.collect()] == [("s", 0.0)]
    windows = W.windows(sessions, TARGET)
    spans = T.window_spans(windows, sessions, TARGET)
    states = spark.createDataFrame([("s", w, "light") for w in range(60)], "session_id string, w int, state string")
    level = spark.createDataFrame([("s", w, 0.5 if w == 4 else 0.0) for w in range(60)], "session_id string, w int, intensity double")
    routes = {"steps": T.Route("texture_density", 0.8)}
    transients = T.schedule_transients(level, spans, routes, brief)
    none = spark.createDataFrame([], "session_id string, metric string, w int, smoothed double, present boolean, v double")
    events = spark.createDataFrame([("s", "sleep_onset", 12.0)], "session_id string, type string, replay_s double")
    plan = T.render_plan(T.contributions(none, spans, routes, TARGET), spans, states, T.restless_windows(level, states, windows), none, events, transients, routes, TARGET)
    got = {}
    for r in plan.collect():
        got.setdefault((r.part, r.name), []).append((r.t, r.v))
    assert got["transient", "brief_awakening"] == [(0.0, 0.4)] and [round(v, 6) for _, v in got["transient", "movement"]] == [0.4] and 2.0 < got["transient", "movement"][0][0] < 2.5
    assert got["preset", "Light"] == [(0.0, 0.0)] and got["gesture", "sleep_onset"] == [(11.0, 13.0)]
    assert {n for p, n in got if p == "trajectory"} == set(S.PARAMETERS) and {n for p, n in got if p == "control"} == set(S.ROOM_METRICS)
    assert {v for n in S.ROOM_METRICS for _, v in got["control", n]} == {0.0} and {v for n in S.PARAMETERS for _, v in got["trajectory", n]} == {0.5}
