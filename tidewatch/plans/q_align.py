"""Queries: validation, normalising, alignment."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions import scalars as X
from tidewatch.operators import align as A
from tidewatch.operators import features as W
from tidewatch.plans import canonical as C
from tidewatch.plans.register import Registry, rounded
from tidewatch.session import written

query = Registry()


def _series(spark, d):
    return A.normalize(C.points(spark, d), C.sessions(spark, d))


class Night:
    """What the parts of one query share, each written at its first use: else every use scans the events and is planned anew.

    Sessions are small, but made from all events; segments, steps, movement and states are read by several parts.
    """

    def __init__(self, spark, d):
        self.spark, self.d = spark, d

    @cached_property
    def sessions(self):
        return written(C.sessions(self.spark, self.d), "sessions")

    @cached_property
    def segments(self):
        return written(C.segments(self.spark, self.d, self.sessions), "segments")

    @cached_property
    def series(self):
        return written(A.normalize(C.points(self.spark, self.d), self.sessions), "series")

    @cached_property
    def steps(self):
        """Sessions with the step that the density of their series calls for."""
        return written(A.with_steps(self.sessions, self.series), "steps")

    @property
    def base(self):
        return self.series, self.steps

    @cached_property
    def timeline(self):
        return written(A.timeline(*self.base), "timeline")

    @cached_property
    def smooth(self):
        return written(W.window_values(self.timeline, self.sessions, C.TARGET_S), "smoothed-windows")

    @cached_property
    def movement(self):
        return written(W.movement(A.hold_steps(*self.base), self.segments, self.sessions, C.TARGET_S), "movement")

    @property
    def windows(self):
        return W.windows(self.sessions, C.TARGET_S)

    @cached_property
    def states(self):
        return written(W.coarse_states(W.dominant_stage(W.stage_fractions(self.segments, self.sessions, C.TARGET_S))), "states")


def _stepped(spark, d):
    """The series and the sessions with their steps, both written: what is made of them reads each more than once."""
    return Night(spark, d).base


def _resampled(spark, d, base=None):
    return A.resample(*(base or _stepped(spark, d)))


def _timeline(spark, d, base=None):
    return A.timeline(*(base or _stepped(spark, d)))


@query(f"""WITH {C.POINTS}, broken AS (SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE us END AS us, CASE WHEN event_id % 13 = 0 THEN ' ' ELSE source END AS source,
  CASE WHEN event_id % 7 = 0 THEN 'glucose' ELSE metric END AS metric, CASE WHEN event_id % 17 = 0 THEN 'nan'::DOUBLE WHEN event_id % 19 = 0 THEN 'inf'::DOUBLE ELSE value END AS value,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE unit END AS unit FROM points)
SELECT CASE WHEN metric IS NULL OR source IS NULL OR unit IS NULL THEN 'malformed_point' WHEN us IS NULL THEN 'naive_timestamp' WHEN metric = 'glucose' THEN 'non_mvp_metric'
  WHEN isnan(value) OR isinf(value) THEN 'non_finite_value' WHEN unit = 'psi' THEN 'inconvertible_unit' WHEN trim(source) = '' THEN 'invalid_source' ELSE 'valid' END AS reason, count(*) AS n
FROM broken GROUP BY 1""")
def gate_counts(spark, d):
    e, hit = F.col("event_id"), lambda n: F.col("event_id") % n == 0
    p = C.points(spark, d).select(
        F.when(~hit(11), F.col("us")).alias("us"), F.when(hit(13), " ").otherwise(F.col("source")).alias("source"), F.when(hit(7), "glucose").otherwise(F.col("metric")).alias("metric"),
        F.when(hit(17), float("nan")).when(hit(19), float("inf")).otherwise(F.col("value")).alias("value"), F.when(~hit(23), F.col("unit")).alias("unit"), e.alias("event_id"),
    )
    reason = X.rejection(*[F.col(c) for c in ("us", "source", "metric", "value", "unit")])
    return p.groupBy(F.coalesce(reason, F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {C.POINTS}, {C.CONVERTED} SELECT event_id, metric, round(value, 6) AS value FROM converted WHERE value IS NOT NULL")
def to_canonical(spark, d):
    return A.to_canonical(C.points(spark, d)).filter("value is not null").select("event_id", "metric", rounded("value"))


@query(f"WITH {C.POINTS} SELECT source, metric, unit, count(*) AS n FROM points WHERE unit = 'psi' GROUP BY ALL")
def inconvertible_units(spark, d):
    return A.inconvertible(C.points(spark, d))


@query(f"""WITH {C.POINTS} SELECT metric, count(*) AS n FROM points WHERE CASE metric WHEN 'heart_rate' THEN value BETWEEN 20 AND 250 WHEN 'steps' THEN value BETWEEN 0 AND 300
  WHEN 'hrv_rmssd' THEN value > 0 AND value <= 500 ELSE true END GROUP BY metric""")
def range_gates(spark, d):
    return C.points(spark, d).filter(X.in_range(F.col("metric"), F.col("value"))).groupBy("metric").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {C.POINTS}, {C.SESSIONS} SELECT session_id, metric, count(*) AS n FROM points JOIN sessions USING (session_id) WHERE us BETWEEN start_us AND end_us GROUP BY ALL")
def attach_telemetry(spark, d):
    return A.attach(C.points(spark, d), C.sessions(spark, d)).groupBy("session_id", "metric").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {C.POINTS}, {C.SESSIONS}, {C.CONVERTED}, {C.DEDUP} SELECT session_id, source, metric, us, round(value, 6) AS value, removed FROM dedup")
def dedup_mean(spark, d):
    own = A.attach(A.to_canonical(C.points(spark, d)).filter("value is not null").drop("subject"), C.sessions(spark, d))
    return A.dedup_mean(own).withColumn("value", F.round("value", 6))


@query(f"""WITH {C.POINTS}, {C.SESSIONS}, {C.CONVERTED}, {C.DEDUP}, {C.CHOSEN}, others AS (SELECT s.session_id, s.metric, string_agg(s.source, ',' ORDER BY s.source) AS ignored FROM sensors s
  JOIN chosen c ON c.session_id = s.session_id AND c.metric = s.metric AND c.source <> s.source GROUP BY ALL)
SELECT c.session_id, c.metric, c.source, c.n, coalesce(ignored, '') AS ignored FROM chosen c LEFT JOIN others o ON o.session_id = c.session_id AND o.metric = c.metric""")
def sensor_select(spark, d):
    own = A.dedup_mean(A.attach(A.to_canonical(C.points(spark, d)).filter("value is not null"), C.sessions(spark, d)))
    return A.select_sensor(own).withColumn("ignored", F.array_join("ignored", ","))


@query(f"WITH {C.NORMAL} SELECT session_id, metric, us, round(value, 6) AS value FROM series")
def normalize_series(spark, d):
    return _series(spark, d).select("session_id", "metric", "us", rounded("value"))


@query(f"""WITH {C.NORMAL}, steps AS (SELECT session_id, metric, us - lag(us) OVER (PARTITION BY session_id, metric ORDER BY us) AS step FROM series)
SELECT session_id, metric, median(step) AS median_us FROM steps GROUP BY ALL""")
def median_interval(spark, d):
    return A.median_interval(_series(spark, d))


@query(f"WITH {C.NORMAL}, {C.GRID} SELECT session_id, resolution_s FROM picked")
def resolution_pick(spark, d):
    return A.choose_resolution(_series(spark, d), C.sessions(spark, d))


@query(f"WITH {C.NORMAL}, {C.GRID} SELECT session_id, k, us FROM grid")
def sample_grid(spark, d):
    return A.sample_grid(_stepped(spark, d)[1])


@query(f"""WITH {C.NORMAL}, {C.GRID} SELECT session_id, metric, (us - start_us) // res_us AS k, round(avg(value), 6) AS value FROM series JOIN stepped USING (session_id)
  WHERE us >= start_us AND us < end_us GROUP BY ALL""")
def resample_mean(spark, d):
    return A.bucket_means(*_stepped(spark, d)).withColumn("value", F.round("value", 6))


@query(f"WITH {C.NORMAL}, {C.GRID}, {C.RESAMPLED} SELECT session_id, metric, k, us, round(value, 6) AS value FROM resampled")
def resample_interpolate(spark, d):
    return _resampled(spark, d).select("session_id", "metric", "k", "us", rounded("value"))


@query(f"""WITH {C.NORMAL}, {C.GRID}, {C.RESAMPLED} SELECT DISTINCT session_id, metric, prev_us AS last_us, next_us - prev_us AS elapsed_us FROM resampled
  WHERE value IS NULL AND prev_us IS NOT NULL AND next_us IS NOT NULL""")
def gap_report(spark, d):
    return A.gaps(_resampled(spark, d))


@query(f"""WITH {C.NORMAL}, {C.GRID}, {C.RESAMPLED}, g AS (SELECT DISTINCT session_id, metric, prev_us, next_us FROM resampled WHERE value IS NULL AND prev_us IS NOT NULL AND next_us IS NOT NULL)
SELECT session_id, metric, count(*) AS n_gaps, CAST(sum(next_us - prev_us) AS BIGINT) AS total_us FROM g GROUP BY ALL""")
def gap_summary(spark, d):
    return A.gap_summary(A.gaps(_resampled(spark, d)))


@query(f"WITH {C.NORMAL}, {C.GRID}, {C.HELD} SELECT session_id, k, us, round(value, 6) AS value FROM held")
def hold_forward(spark, d):
    return A.hold_steps(*_stepped(spark, d)).select("session_id", "k", "us", rounded("value"))


@query(f"""WITH {C.NORMAL}, {C.GRID}, {C.RAW_STAGES}, {C.SEGMENTS} SELECT g.session_id, k, us, CASE WHEN us < s.end_us THEN stage ELSE 'unknown' END AS stage
FROM grid g ASOF LEFT JOIN segments s ON g.session_id = s.session_id AND g.us >= s.start_us""")
def assign_state(spark, d):
    return A.assign_stages(C.segments(spark, d), _stepped(spark, d)[1]).drop("res_us")


@query(f"""WITH {C.NORMAL} SELECT session_id, metric FROM sessions, (SELECT unnest(['heart_rate', 'hrv_rmssd', 'steps', 'temperature', 'humidity', 'pressure']) AS metric)
EXCEPT SELECT session_id, metric FROM series""")
def unavailable_metrics(spark, d):
    return A.unavailable(_series(spark, d), C.sessions(spark, d))


@query(f"""WITH {C.NORMAL}, {C.GRID}, {C.RESAMPLED}, cover AS (SELECT session_id, avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END) AS c FROM resampled WHERE metric = 'heart_rate' GROUP BY 1),
near AS (SELECT DISTINCT s.session_id FROM sessions s JOIN points p ON p.subject = s.subject AND p.metric = 'heart_rate' AND p.us BETWEEN s.start_us - 50400000000 AND s.end_us + 50400000000 AND (p.us < s.start_us OR p.us > s.end_us))
SELECT s.session_id, round(coalesce(c, 0), 6) AS coverage, coalesce(c, 0) < 0.5 AND n.session_id IS NOT NULL AS suspect FROM sessions s LEFT JOIN cover USING (session_id) LEFT JOIN near n USING (session_id)""")
def coverage_check(spark, d):
    s = C.sessions(spark, d)
    return A.timezone_suspects(_resampled(spark, d), C.points(spark, d), s).withColumn("coverage", F.round("coverage", 6))


@query(f"WITH {C.ALIGNED} SELECT session_id, metric, k, us, round(value, 6) AS value FROM timeline")
def align_timeline(spark, d):
    return _timeline(spark, d).select("session_id", "metric", "k", "us", rounded("value"))


@query(f"""WITH {C.POINTS} SELECT metric, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM points GROUP BY 1""")
def merge_reports(spark, d):
    return W.merge_reports(W.report(C.points(spark, d)))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return C.table(spark, d, "events").select("event_id", k.alias("k"))


@query("""WITH t AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN ' ' || value || ' ' WHEN 1 THEN 'nan' WHEN 2 THEN '1_000' WHEN 3 THEN '1e999' WHEN 4 THEN '.5e1' WHEN 5 THEN '-' || value
  WHEN 6 THEN '+3.' ELSE '' END AS t FROM events)
SELECT event_id, CASE event_id % 8 WHEN 0 THEN CAST(trim(t) AS DOUBLE) WHEN 4 THEN 5.0 WHEN 5 THEN CAST(t AS DOUBLE) WHEN 6 THEN 3.0 END AS x FROM t""")
def parse_numbers(spark, d):
    e, v = F.col("event_id") % 8, F.col("value").cast("string")
    t = F.when(e == 0, F.concat(F.lit(" "), v, F.lit(" "))).when(e == 1, "nan").when(e == 2, "1_000").when(e == 3, "1e999").when(e == 4, ".5e1").when(e == 5, F.concat(F.lit("-"), v)).when(e == 6, "+3.").otherwise("")
    return C.table(spark, d, "events").select("event_id", X.parse_number(t).alias("x"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_us(date_trunc('second', ts)) WHEN 1 THEN epoch_us(date_trunc('minute', ts)) ELSE -1 END AS us FROM events""")
def parse_timestamps(spark, d):
    e = C.table(spark, d, "events")
    short, us = F.date_format("ts", "MM/dd/yy HH:mm:ss"), F.date_format("ts", "M/d/yyyy h:mm a")
    wall = F.when(F.col("event_id") % 3 == 0, X.short_timestamp(short)).when(F.col("event_id") % 3 == 1, X.sensor_timestamp(us)).otherwise(X.sensor_timestamp(F.date_format("ts", "dd.MM.yyyy HH:mm")))
    return e.select("event_id", F.coalesce(F.unix_micros(wall.cast("timestamp")), F.lit(-1)).alias("us"))


@query("""SELECT event_id, epoch_us(timezone('America/New_York', ts)) AS us FROM events""")
def localize(spark, d):
    return C.table(spark, d, "events").select("event_id", F.unix_micros(X.localize(F.col("ts"), "America/New_York")).alias("us"))


@query("""WITH m AS (SELECT user_id, CASE WHEN event_type IN ('view', 'signup') THEN value END AS a, CASE WHEN event_type IN ('click') THEN value * 2 END AS b, event_id FROM events)
SELECT event_id, 'a' AS metric, a AS value FROM m WHERE a IS NOT NULL UNION ALL SELECT event_id, 'b', b FROM m WHERE b IS NOT NULL""")
def unpivot_points(spark, d):
    e = C.table(spark, d, "events")
    wide = e.select("event_id", F.when(F.col("event_type").isin("view", "signup"), F.col("value")).alias("a"), F.when(F.col("event_type") == "click", F.col("value") * 2).alias("b"))
    return wide.unpivot("event_id", ["a", "b"], "metric", "value").filter("value is not null")


@query("""WITH m AS (SELECT user_id, event_type, quantile_cont(value, 0.5) AS mid FROM events GROUP BY ALL)
SELECT user_id, event_type, CASE WHEN mid > 45 THEN 'fahrenheit' ELSE 'celsius' END AS temperature_unit, CASE WHEN mid BETWEEN 25 AND 32 THEN 'inhg' WHEN mid BETWEEN 90 AND 110 THEN 'kpa'
  WHEN mid BETWEEN 900 AND 1100 THEN 'hpa' END AS pressure_unit FROM m""")
def unit_inference(spark, d):
    from tidewatch.sources.sensorpush import infer_unit

    m = C.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.percentile("value", F.lit(0.5)).alias("mid"))
    return m.select("user_id", "event_type", infer_unit(F.lit("temperature"), F.col("mid")).alias("temperature_unit"), infer_unit(F.lit("pressure"), F.col("mid")).alias("pressure_unit"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'awake' WHEN 'click' THEN 'light' ELSE 'unknown' END AS stage FROM events""")
def stage_names(spark, d):
    raw = X.lookup(F.col("event_type"), {"view": " Wake ", "click": "CORE"}, "nap")
    return C.table(spark, d, "events").select("event_id", X.stage_name(raw).alias("stage"))
