"""The driver's tables read as telemetry, in Spark and as SQL fragments.

``events`` are points: the type is the metric, the user picks one of three
sensors and the unit, times are cut to the minute so that some collide. On each
seventh day heart rates come twice, half a minute apart, so that sessions
differ in their step. 75 users are a subject (a household); a session is a
subject's day, from its first event to a minute after its last. Each point is
also a change of sleep stage. Orders are candidate sessions of a customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CUT_US, ECHO_US, AFTER_US, TARGET_S, USERS = 60_000_000, 30_000_000, 61_234_567, 180, 75
METRIC = {"view": "heart_rate", "click": "hrv_rmssd", "purchase": "steps", "signup": "temperature", "error": "pressure"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(col: str, values: dict) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in values.items()) + " END"


UNIT_SQL = """CASE event_type WHEN 'view' THEN 'bpm' WHEN 'click' THEN 'ms' WHEN 'purchase' THEN 'count'
 WHEN 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 'celsius' ELSE 'fahrenheit' END
 ELSE CASE user_id % 4 WHEN 0 THEN 'hpa' WHEN 1 THEN 'inhg' WHEN 2 THEN 'kpa' ELSE 'psi' END END"""


def _keyed(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = (e.filter(where) if where else e).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    subject = F.floor(F.col("user_id") / USERS).cast("string")
    return e.withColumn("subject", subject).withColumn("session_id", F.concat_ws("/", F.date_format("ts", "yyyy-MM-dd"), "subject")).withColumn("us", F.col("t") - F.pmod("t", F.lit(CUT_US)))


def points(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    again = (F.col("event_type") == "view") & (F.dayofmonth("ts") % 7 == 0)
    after = F.explode(F.when(again, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    twice = _keyed(spark, sf_dir, where).withColumn("_n", after).withColumn("us", F.col("us") + F.col("_n") * ECHO_US).withColumn("value", F.col("value") + F.col("_n"))
    return twice.select(
        "session_id", "subject", "us", F.concat(F.lit("sensorpush:"), (F.col("user_id") % 3).cast("string")).alias("source"), F.expr(_case("event_type", METRIC)).alias("metric"),
        "value", F.expr(UNIT_SQL).alias("unit"), "event_id", "user_id",
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir).groupBy("session_id", "subject").agg(F.min("us").alias("start_us"), (F.max("us") + AFTER_US).alias("end_us"))


def stage_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw intervals that may overlap: (session_id, src_idx, start_us, end_us, stage, is_brief)."""
    stage = F.expr("CASE event_id % 5 WHEN 0 THEN 'light' WHEN 1 THEN 'deep' WHEN 2 THEN 'rem' WHEN 3 THEN 'awake' ELSE 'restless' END")
    end = F.col("us") + (F.col("event_id") % 7 + 1) * 1_200_000_000
    return points(spark, sf_dir).select("session_id", F.col("event_id").alias("src_idx"), F.col("us").alias("start_us"), end.alias("end_us"), stage.alias("stage"), (F.col("event_id") % 4 == 0).alias("is_brief"))


def segments(spark: SparkSession, sf_dir: str, own_sessions: DataFrame | None = None) -> DataFrame:
    """Disjoint segments, each up to the next change; the last up to the end of the session. Sessions that are written already are read."""
    ends = (own_sessions or sessions(spark, sf_dir)).select("session_id", "end_us")
    raw = stage_changes(spark, sf_dir).groupBy("session_id", "start_us").agg(F.min_by(F.struct("stage", "is_brief"), "src_idx").alias("s"))
    own = raw.join(ends, "session_id").filter("start_us < end_us")
    until = F.coalesce(F.lead("start_us").over(Window.partitionBy("session_id").orderBy("start_us")), F.col("end_us"))
    return own.select("session_id", "start_us", until.alias("end_us"), "s.stage", "s.is_brief")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, start_us, end_us, content, log_id, is_main, has_stages)."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    last = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.unix_micros(F.col("l_shipdate").cast("timestamp"))).alias("ship"))
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    both = o.join(last, "o_orderkey").withColumn("s", start)
    return both.select(
        F.col("o_custkey").alias("subject"), F.col("s").alias("start_us"), F.greatest(F.col("ship"), F.col("s") + 86_400_000_000).alias("end_us"),
        F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("content"), F.when(F.col("o_orderkey") % 3 == 0, F.floor(F.col("o_orderkey") / 30000)).cast("bigint").alias("log_id"),
        (F.col("o_orderstatus") == "F").alias("is_main"), (F.col("o_orderpriority") < "3").alias("has_stages"),
    )


# --- the same as SQL: each fragment is a list of common table expressions

POINTS = f"""
heard AS (SELECT *, 0 AS n FROM events UNION ALL SELECT *, 1 AS n FROM events WHERE event_type = 'view' AND day(ts) % 7 = 0),
points AS (SELECT strftime(ts, '%Y-%m-%d') || '/' || (user_id // {USERS}) AS session_id, CAST(user_id // {USERS} AS VARCHAR) AS subject, epoch_us(ts) // {CUT_US} * {CUT_US} + n * {ECHO_US} AS us,
  'sensorpush:' || (user_id % 3) AS source, {_case("event_type", METRIC)} AS metric, value + n AS value, {UNIT_SQL} AS unit, event_id, user_id FROM heard)"""
SESSIONS = f"""
sessions AS (SELECT strftime(ts, '%Y-%m-%d') || '/' || (user_id // {USERS}) AS session_id, CAST(user_id // {USERS} AS VARCHAR) AS subject, min(epoch_us(ts) // {CUT_US} * {CUT_US}) AS start_us,
  max(epoch_us(ts) // {CUT_US} * {CUT_US}) + {AFTER_US} AS end_us FROM events GROUP BY ALL)"""
CONVERTED = """
converted AS (SELECT * EXCLUDE (value, unit), CASE WHEN unit = 'fahrenheit' THEN (value - 32) * 5 / 9 WHEN unit = 'inhg' THEN value * 33.86389
  WHEN unit = 'kpa' THEN value * 10.0 WHEN unit = 'psi' THEN NULL ELSE value END AS value FROM points)"""
DEDUP = """
dedup AS (SELECT session_id, source, metric, us, avg(value) AS value, count(*) - 1 AS removed FROM converted JOIN sessions USING (session_id)
  WHERE us BETWEEN start_us AND end_us AND value IS NOT NULL GROUP BY ALL)"""
CHOSEN = """
sensors AS (SELECT session_id, metric, source, count(*) AS n FROM dedup WHERE metric IN ('temperature', 'humidity', 'pressure') GROUP BY ALL),
chosen AS (SELECT session_id, metric, source, n FROM sensors QUALIFY row_number() OVER (PARTITION BY session_id, metric ORDER BY n DESC, source) = 1)"""
SERIES = """
series AS (SELECT d.session_id, d.metric, us, avg(value) AS value FROM dedup d LEFT JOIN chosen c ON c.session_id = d.session_id AND c.metric = d.metric
  WHERE c.source IS NULL OR c.source = d.source GROUP BY ALL)"""
NORMAL = ",".join((POINTS, SESSIONS, CONVERTED, DEDUP, CHOSEN, SERIES))
GRID = """
apart AS (SELECT session_id, metric, us - lag(us) OVER (PARTITION BY session_id, metric ORDER BY us) AS step FROM series WHERE metric <> 'steps'),
densest AS (SELECT session_id, min(m) AS m FROM (SELECT session_id, metric, median(step) AS m FROM apart GROUP BY ALL) GROUP BY 1),
picked AS (SELECT s.session_id, CASE WHEN m <= 1000000 THEN 1 WHEN m <= 5000000 THEN 5 WHEN m <= 10000000 THEN 10 WHEN m <= 15000000 THEN 15 WHEN m <= 30000000 THEN 30 ELSE 60 END AS resolution_s
  FROM sessions s LEFT JOIN densest d ON d.session_id = s.session_id),
stepped AS (SELECT s.*, CAST(resolution_s * 1000000 AS BIGINT) AS res_us FROM sessions s JOIN picked p ON p.session_id = s.session_id),
grid AS (SELECT session_id, k, start_us + k * res_us AS us, res_us FROM (SELECT session_id, start_us, res_us, unnest(range(0, (end_us - start_us + res_us - 1) // res_us)) AS k FROM stepped))"""
RESAMPLED = f"""
cont AS (SELECT * FROM series WHERE metric <> 'steps'),
probes AS (SELECT g.session_id, metric, k, us FROM grid g JOIN (SELECT DISTINCT session_id, metric FROM cont) USING (session_id)),
before AS (SELECT p.*, c.us AS prev_us, c.value AS pv FROM probes p ASOF LEFT JOIN cont c ON p.session_id = c.session_id AND p.metric = c.metric AND p.us > c.us),
around AS (SELECT p.*, c.us AS next_us, c.value AS nv FROM before p ASOF LEFT JOIN cont c ON p.session_id = c.session_id AND p.metric = c.metric AND p.us <= c.us),
means AS (SELECT session_id, metric, (us - start_us) // res_us AS k, avg(value) AS mean FROM cont JOIN stepped USING (session_id) WHERE us < end_us GROUP BY ALL),
resampled AS (SELECT a.session_id, a.metric, a.k, a.us, prev_us, next_us, coalesce(mean, CASE WHEN next_us - prev_us <= CASE a.metric WHEN 'heart_rate' THEN 300000000 ELSE 900000000 END
  THEN pv + (nv - pv) * ((a.us - prev_us) / CAST(next_us - prev_us AS DOUBLE)) END) AS value FROM around a LEFT JOIN means m ON m.session_id = a.session_id AND m.metric = a.metric AND m.k = a.k)"""
HELD = """
held AS (SELECT g.session_id, k, g.us, CASE WHEN g.us < s.us + 60000000 THEN s.value END AS value FROM grid g ASOF LEFT JOIN (SELECT * FROM series WHERE metric = 'steps') s
  ON g.session_id = s.session_id AND g.us >= s.us)"""
TIMELINE = "timeline AS (SELECT session_id, metric, k, us, value FROM resampled UNION ALL SELECT session_id, 'steps', k, us, value FROM held)"
ALIGNED = ",".join((NORMAL, GRID, RESAMPLED, HELD, TIMELINE))
RAW_STAGES = """
raw AS (SELECT session_id, event_id AS src_idx, us AS start_us, us + (event_id % 7 + 1) * 1200000000 AS end_us,
  CASE event_id % 5 WHEN 0 THEN 'light' WHEN 1 THEN 'deep' WHEN 2 THEN 'rem' WHEN 3 THEN 'awake' ELSE 'restless' END AS stage, event_id % 4 = 0 AS is_brief FROM points)"""
SEGMENTS = """
firsts AS (SELECT session_id, start_us, arg_min(stage, src_idx) AS stage, arg_min(is_brief, src_idx) AS is_brief FROM raw GROUP BY ALL),
segments AS (SELECT session_id, f.start_us, coalesce(lead(f.start_us) OVER (PARTITION BY session_id ORDER BY f.start_us), s.end_us) AS end_us, stage, is_brief
  FROM firsts f JOIN sessions s USING (session_id) WHERE f.start_us < s.end_us)"""
N_WINDOWS = TARGET_S * 2
WINDOWS = f"""
edges AS (SELECT session_id, i, CASE WHEN i = {N_WINDOWS} THEN end_us ELSE start_us + (i * (end_us - start_us)) // {N_WINDOWS}
    + CASE WHEN 2 * ((i * (end_us - start_us)) % {N_WINDOWS}) > {N_WINDOWS} OR (2 * ((i * (end_us - start_us)) % {N_WINDOWS}) = {N_WINDOWS}
      AND ((i * (end_us - start_us)) // {N_WINDOWS}) % 2 = 1) THEN 1 ELSE 0 END END AS e FROM sessions, range(0, {N_WINDOWS} + 1) r(i)),
windows AS (SELECT session_id, i AS w, e AS w_start, lead(e) OVER (PARTITION BY session_id ORDER BY i) AS w_end FROM edges QUALIFY w_end IS NOT NULL)"""
STATS = f"""
stats AS (SELECT t.session_id, metric, w, count(*) AS n, count(value) AS present, avg(value) AS mean, min(value) AS lo, max(value) AS hi,
  CASE WHEN count(value) > 1 THEN regr_slope(value, CASE WHEN value IS NOT NULL THEN (us - start_us) / 3.6e9 END) END AS slope
  FROM timeline t JOIN sessions s ON s.session_id = t.session_id JOIN windows x ON x.session_id = t.session_id AND (t.us >= w_start AND t.us < w_end OR w = {N_WINDOWS - 1} AND t.us = w_end) GROUP BY ALL)"""
SMOOTH = f"""
smooth AS (SELECT x.session_id, h.metric, w, avg(value) AS smoothed FROM windows x JOIN (SELECT DISTINCT session_id, metric FROM timeline) h ON h.session_id = x.session_id
  LEFT JOIN timeline t ON t.session_id = x.session_id AND t.metric = h.metric AND abs(2 * t.us - w_start - w_end) <= CASE h.metric WHEN 'heart_rate' THEN 300000000 ELSE 900000000 END GROUP BY ALL)"""
OVERLAP = """
overlap AS (SELECT x.session_id, w, stage, is_brief, least(w_end, s.end_us) - greatest(w_start, s.start_us) AS us FROM windows x JOIN segments s
  ON s.session_id = x.session_id AND s.start_us < w_end AND s.end_us > w_start)"""
FRACTIONS = """
known AS (SELECT session_id, w, stage, sum(us) AS us FROM overlap GROUP BY ALL),
every AS (SELECT session_id, w, w_end - w_start AS length, stage FROM windows, (SELECT unnest(['awake', 'light', 'deep', 'rem', 'asleep', 'restless', 'unknown']) AS stage)),
filled AS (SELECT e.session_id, e.w, e.stage, length, coalesce(us, 0) AS us FROM every e LEFT JOIN known k ON k.session_id = e.session_id AND k.w = e.w AND k.stage = e.stage),
fractions AS (SELECT session_id, w, stage, CAST(CASE WHEN stage = 'unknown' THEN us + length - sum(us) OVER (PARTITION BY session_id, w) ELSE us END AS BIGINT) AS us, length FROM filled),
dominant AS (SELECT session_id, w, stage FROM fractions QUALIFY row_number() OVER (PARTITION BY session_id, w
  ORDER BY us DESC, list_position(['awake', 'rem', 'light', 'deep', 'asleep', 'restless', 'unknown'], stage)) = 1)"""
STATES = """
d0 AS (SELECT *, CASE WHEN stage = lag(stage) OVER (PARTITION BY session_id ORDER BY w) THEN 0 ELSE 1 END AS fresh FROM dominant),
d1 AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY w) AS run FROM d0),
d2 AS (SELECT *, count(*) OVER (PARTITION BY session_id, run) AS len FROM d1),
d3 AS (SELECT *, max(CASE WHEN run = 1 THEN len END) OVER (PARTITION BY session_id) AS first_len, max(CASE WHEN run = 2 THEN stage END) OVER (PARTITION BY session_id) AS second FROM d2),
d4 AS (SELECT *, CASE WHEN run = 1 AND first_len = 1 THEN coalesce(second, stage) WHEN len >= 2 OR (run = 2 AND first_len = 1) THEN stage END AS kept FROM d3),
states AS (SELECT session_id, w, last_value(kept IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM d4)"""
MOVEMENT = """
rest AS (SELECT session_id, w, sum(us) AS us FROM overlap WHERE stage = 'restless' OR is_brief GROUP BY ALL),
movement AS (SELECT x.session_id, x.w, CASE WHEN sum(coalesce(s.present, 0)) OVER (PARTITION BY x.session_id) > 0 THEN least(1.0, greatest(0.0, coalesce(s.mean, 0) / 30))
  ELSE least(1.0, greatest(0.0, coalesce(r.us, 0) / CAST(w_end - w_start AS DOUBLE))) END AS intensity FROM windows x LEFT JOIN (SELECT * FROM stats WHERE metric = 'steps') s ON s.session_id = x.session_id AND s.w = x.w
  LEFT JOIN rest r ON r.session_id = x.session_id AND r.w = x.w)"""
CANDIDATES = """
ship AS (SELECT l_orderkey, max(epoch_us(l_shipdate)) AS ship FROM lineitem GROUP BY 1),
candidates AS (SELECT o_custkey AS subject, epoch_us(o_orderdate) AS start_us, greatest(ship, epoch_us(o_orderdate) + 86400000000) AS end_us, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS content,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 30000 END AS log_id, o_orderstatus = 'F' AS is_main, o_orderpriority < '3' AS has_stages FROM orders JOIN ship ON l_orderkey = o_orderkey)"""
