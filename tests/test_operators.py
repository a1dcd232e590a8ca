"""Named cases with known results, and brute-force versions of what SQL can't express."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions import scalars as X
from tidewatch.operators import align, events, features, intervals, trajectories

SEC = S.US
FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def series(spark, points, metric="heart_rate"):
    return spark.createDataFrame([("s", metric, int(t * SEC), float(v)) for t, v in points], "session_id string, metric string, us bigint, value double")


def night(spark, seconds):
    return spark.createDataFrame([("s", 0, int(seconds * SEC))], S.SESSIONS)


def test_grid_mean_interpolation_and_gap(spark):
    own, s = series(spark, [(70, 10), (90, 20), (240, 40), (599, 1)], "temperature"), night(spark, 600)
    r = align.resample(own, s, 60 * SEC)
    # 15 minutes are allowed for temperature, so all inner samples are filled
    assert [x.value for x in r.orderBy("k").collect()][:5] == [None, 15.0, 24.0, 32.0, 40.0]
    wide = align.resample(series(spark, [(70, 10), (90, 20), (240, 40), (599, 1)]), s, 60 * SEC)
    assert [x.value for x in wide.orderBy("k").collect()] == [None, 15.0, 24.0, 32.0, 40.0, None, None, None, None, 1.0]
    assert [(x.last_us, x.elapsed_us) for x in align.gaps(wide).collect()] == [(240 * SEC, 359 * SEC)]


def test_gap_boundary(spark):
    for extra, missing in ((0, 0), (1, 4)):
        own = spark.createDataFrame([("s", "heart_rate", 0, 1.0), ("s", "heart_rate", 300 * SEC + extra, 2.0)], "session_id string, metric string, us bigint, value double")
        got = align.resample(own, night(spark, 301), 60 * SEC).orderBy("k").collect()
        assert sum(x.value is None for x in got) == missing


def test_point_at_the_end_is_in_no_bucket(spark):
    got = align.resample(series(spark, [(10, 5), (120, 15)]), night(spark, 120), 60 * SEC).orderBy("k").collect()
    assert [round(x.value, 9) for x in got] == [5.0, round(5 + 10 * 50 / 110, 9)]


def test_steps_are_held(spark):
    got = align.hold_steps(series(spark, [(0, 12), (120, 3)], "steps"), night(spark, 180), 30 * SEC).orderBy("k").collect()
    assert [x.value for x in got] == [12.0, 12.0, None, None, 3.0, 3.0]


def test_stage_lookup(spark):
    seg = spark.createDataFrame([("s", 30 * SEC, 90 * SEC, "deep", False)], S.SEGMENTS)
    got = align.assign_stages(seg, night(spark, 180), 30 * SEC).orderBy("k").collect()
    assert [x.stage for x in got] == ["unknown", "deep", "deep", "unknown", "unknown", "unknown"]


def test_resolution(spark):
    every7 = series(spark, [(7 * i, 1) for i in range(9)]).unionByName(series(spark, [(120 * i, 1) for i in range(3)], "temperature"))
    one = night(spark, 180)
    assert align.choose_resolution(every7, one).first().resolution_s == 10
    assert align.choose_resolution(series(spark, [(0, 1)]), one).first().resolution_s == 60
    assert align.choose_resolution(series(spark, [(0, 1), (1, 1)], "steps"), one).first().resolution_s == 60


def test_each_session_has_its_own_step(spark):
    both = night(spark, 100).withColumn("session_id", F.explode(F.array(F.lit("s"), F.lit("quiet"), F.lit("none"))))
    dense, sparse = series(spark, [(7 * i, i) for i in range(12)]), series(spark, [(0, 4), (100, 6)]).withColumn("session_id", F.lit("quiet"))
    steps = series(spark, [(15, 9)], "steps")
    line = align.timeline(dense.unionByName(sparse).unionByName(steps), both)
    got = {k: [(r.us // SEC, r.value) for r in line.filter(f"session_id = '{k}' and metric = 'heart_rate'").orderBy("k").collect()] for k in ("s", "quiet", "none")}
    assert [t for t, _ in got["s"]] == list(range(0, 100, 10)) and got["s"][:3] == [(0, 0.5), (10, 2.0), (20, 3.5)] and got["s"][9] == (90, None)
    assert got["quiet"] == [(0, 4.0), (60, 5.2)] and got["none"] == []
    held = {k: [(r.us // SEC, r.value) for r in line.filter(f"session_id = '{k}' and metric = 'steps'").orderBy("k").collect()] for k in ("s", "none")}
    assert held["s"] == [(t, 9.0 if 15 <= t < 75 else None) for t in range(0, 100, 10)] and held["none"] == [(0, None), (60, None)]
    stages = align.assign_stages(spark.createDataFrame([("s", 5 * SEC, 42 * SEC, "deep", False)], S.SEGMENTS), align.with_steps(both, dense))
    runs = {(r.session_id, r.stage, r.start_us // SEC, r.end_us // SEC) for r in events.stage_runs(stages).collect()}
    assert runs == {("s", "unknown", 0, 10), ("s", "deep", 10, 50), ("s", "unknown", 50, 100), ("quiet", "unknown", 0, 120), ("none", "unknown", 0, 120)}


def test_coarse_states(spark):
    def smooth(states):
        df = spark.createDataFrame([("s", i, x) for i, x in enumerate(states)], "session_id string, w int, stage string")
        return [r.state for r in features.coarse_states(df).orderBy("w").collect()]

    assert smooth(["awake", "deep", "deep", "rem", "deep", "deep"]) == ["deep"] * 6
    assert smooth(["awake", "awake", "rem", "deep", "deep"]) == ["awake"] * 3 + ["deep"] * 2
    assert smooth(["rem"]) == ["rem"]


def test_event_merge_and_cap(spark):
    e = spark.createDataFrame([("s", "movement_burst", m * S.MINUTE, v) for m, v in ((0, 0.1), (15, 0.9), (20, 0.4), (30, 0.7))], "session_id string, type string, us bigint, magnitude double")
    assert [(r.us // S.MINUTE, r.magnitude) for r in events.merge_events(e).orderBy("us").collect()] == [(0, 0.9), (20, 0.7)]
    many = [("s", "sleep_onset", 0, 1.0), ("s", "final_awakening", 99, 1.0), *[("s", "movement_burst", i + 1, 0.5) for i in range(19)]]
    got = events.cap_events(spark.createDataFrame(many, "session_id string, type string, us bigint, magnitude double")).orderBy("us").collect()
    assert [r.us for r in got] == [0, *range(1, 11), 99]


def test_window_edges_round_half_to_even(spark):
    s = spark.createDataFrame([("a", 0, 1234567), ("b", 5, 28_801_234_567)], S.SESSIONS)
    for r in features.windows(s, 30).join(s, "session_id").collect():
        assert r.w_start == r.start_us + round_half_even(r.w * (r.end_us - r.start_us), 60)
        assert r.w < 59 or r.w_end == r.end_us


def round_half_even(n, d):
    q, r = divmod(n, d)
    return q + (2 * r > d or 2 * r == d and q % 2)


@FEW
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12), st.booleans()), min_size=1, max_size=9))
def test_stage_segments_equal_a_sweep(spark, raw):
    rows = [("s", i, a, a + n, f"x{i}", b) for i, (a, n, b) in enumerate(raw)]
    df = spark.createDataFrame(rows, "session_id string, src_idx int, start_us bigint, end_us bigint, stage string, is_brief boolean")
    got = sorted((r.start_us, r.end_us, r.stage) for r in intervals.stage_segments(df, spark.createDataFrame([("s", 2, 35)], S.SESSIONS)).collect())
    owner = []
    for t in range(2, 35):
        over = [(b, max(a, 2), i) for _, i, a, e, _, b in rows if max(a, 2) <= t < min(e, 35)]
        owner.append(max(over)[2] if over else None)
    want = []
    for t, o in enumerate(owner, 2):
        if o is not None:
            if want and want[-1][1] == t and want[-1][2] == f"x{o}":
                want[-1] = (want[-1][0], t + 1, want[-1][2])
            else:
                want.append((t, t + 1, f"x{o}"))
    assert got == want


def test_change_points_equal_a_loop(spark):
    rng = random.Random(5)
    values = [20 + rng.uniform(-0.8, 0.8) * (i % 7) / 3 for i in range(200)]
    df = spark.createDataFrame([("s", "temperature", i * S.MINUTE, v) for i, v in enumerate(values)], "session_id string, metric string, us bigint, smoothed double")
    want, anchor = [], 0
    for i, v in enumerate(values):
        near = [(abs(v - values[j]), -j) for j in range(anchor, i) if i - j <= 30]
        if near and max(near)[0] >= 1.0:
            want.append(i)
            anchor = i
    assert [r.us // S.MINUTE for r in events.change_points(df).orderBy("us").collect()] == want


def test_transients_are_never_more_than_four_a_second(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([("s", rng.uniform(0, 5), rng.random(), "k") for _ in range(80)], "session_id string, t double, amp double, kind string")
    times = sorted(r.t for r in events.cap_transients(df).collect())
    assert all(b - a >= 1 for a, b in zip(times, times[4:], strict=False)) and len(times) >= 16


def test_rate_limit_and_hysteresis(spark):
    df = spark.createDataFrame([("s", "m", i, v) for i, v in enumerate([0.0, 1.0, 1.0, 0.0])], "session_id string, metric string, w int, v double")
    assert [round(r.out, 9) for r in trajectories.rate_limit(df, rate=0.5).orderBy("w").collect()] == [0.0, 0.25, 0.5, 0.25]
    df = spark.createDataFrame([("s", "m", i, v) for i, v in enumerate([0.0, 0.4, 0.5, None, 0.4])], "session_id string, metric string, w int, v double")
    assert [r.out for r in trajectories.hysteresis(df, "v", 0.5).orderBy("w").collect()] == [0.0, 0.0, 0.5, None, 0.4]


def test_duplicates_are_transitive(spark):
    rows = [("u", 0, 10, "a", 1, False, False), ("u", 5, 15, "b", 1, True, True), ("u", 5, 15, "c", None, False, True), ("u", 7, 9, "d", None, False, True)]
    df = spark.createDataFrame(rows, "subject string, start_us bigint, end_us bigint, content string, log_id bigint, is_main boolean, has_stages boolean")
    assert sorted((r.content, r.n) for r in intervals.deduplicate(df).collect()) == [("b", 3), ("d", 1)]


def test_daylight_saving(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-03-10 02:30:00'), (TIMESTAMP_NTZ'2024-11-03 01:30:00'), (TIMESTAMP_NTZ'2024-07-01 12:00:00') t(w)")
    got = df.select(X.localize(F.col("w"), "America/New_York").cast("string").alias("u"), X.in_gap(F.col("w"), "America/New_York").alias("g"), X.is_ambiguous(F.col("w"), "America/New_York").alias("a")).collect()
    assert [tuple(r) for r in got] == [("2024-03-10 07:30:00", True, False), ("2024-11-03 05:30:00", False, True), ("2024-07-01 16:00:00", False, False)]


def test_numbers_and_units(spark):
    cases = {"1": 1.0, " 2.5 ": 2.5, ".5e1": 5.0, "nan": None, "1_0": None, "1e999": None, "": None, "inf": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.parse_number(F.col("t")).alias("x"))
    assert {r.t: r.x for r in df.collect()} == cases
    one = spark.range(1).select(X.to_canonical(F.lit("temperature"), F.lit("fahrenheit"), F.lit(98.6)).alias("t"), X.to_canonical(F.lit("pressure"), F.lit("psi"), F.lit(1.0)).alias("p")).first()
    assert one.t == 37.0 and one.p is None


def test_long_chain_of_duplicates_is_one_group(spark):
    rows = [("s", f"{i:04}", i // 2, i // 2 + 1, (i + 1) // 2, False, True) for i in range(200)]
    df = spark.createDataFrame(rows, "subject string, content string, start_us bigint, end_us bigint, log_id bigint, is_main boolean, has_stages boolean")
    assert [(r.content, r.n) for r in intervals.deduplicate(df).collect()] == [("0000", 200)]


def test_times_and_texts(spark):
    us = lambda n: F.lit(n).cast("bigint")
    r = spark.range(1).select(
        X.spoken_duration(us(3_930_000_000)).alias("a"), X.spoken_duration(us(499_999)).alias("b"), X.elapsed_text(us(130_500_000)).alias("c"), X.elapsed_text(us(45_500_000)).alias("d"), X.elapsed_text(us(-5)).alias("e"),
        X.ratio_text(X.compression_ratio(us(0), us(8 * S.HOUR), 180)).alias("f"), X.too_short(us(0), us(180 * SEC), 180).alias("g"), X.add_elapsed(us(5), F.lit(1.5)).alias("h"),
        X.display_time(us(0), "America/New_York").cast("string").alias("i"), X.marker_percent(F.lit(200.0), 180).alias("j"),
        X.is_valid(us(1), F.lit("s"), F.lit("steps"), F.lit(2.0), F.lit("count")).alias("k"), X.is_valid(us(1), F.lit(" "), F.lit("steps"), F.lit(2.0), F.lit("count")).alias("l"),
    ).first()
    assert tuple(r) == ("1 h 5 min 30 s", "0 s", "2 min 10.5 s", "45.5 s", "0 s", "160.000", True, 1_500_005, "1969-12-31 19:00:00", 100.0, True, False)


def test_selection_rules(spark):
    h = S.HOUR
    rows = [("u", 0, 8 * h, "a", None, True, True), ("u", 6 * h, 9 * h, "b", 3, False, True), ("u", 20 * h, 21 * h, "c", None, False, False)]
    df = spark.createDataFrame(rows, "subject string, start_us bigint, end_us bigint, content string, log_id bigint, is_main boolean, has_stages boolean")
    owners = {(r.content, r.start_us // h, r.end_us // h) for r in intervals.ownership(intervals.merge_islands(df, ["subject"]), ["subject", "island"]).collect()}
    assert owners == {("a", 0, 8), ("b", 8, 9), ("c", 20, 21)}
    ranges = spark.createDataFrame([("u", "2024-03-01 22:00", "2024-03-02 22:00"), ("v", "2024-03-01 22:00", "2024-03-02 22:00:01"), ("w", None, "x")], "subject string, start string, end string")
    assert {r.subject: r.problem for r in intervals.manual_sessions(ranges, "UTC").collect()} == {"u": None, "v": "longer than 24 hours", "w": "start is missing"}
    chosen = intervals.containing(spark.createDataFrame([("u", "x", h, 2 * h)], "subject string, content string, start_us bigint, end_us bigint"), df)
    assert [r.container for r in chosen.collect()] == ["a"]
    now = spark.createDataFrame([], "subject string, kind string, content string, start_us bigint, end_us bigint")
    assert [tuple(r) for r in intervals.resolve_selection(now, df, "UTC").collect()] == [("u", "auto", "a")]
