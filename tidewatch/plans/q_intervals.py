"""Queries: interval algebra, selection, trajectories, documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions import scalars as X
from tidewatch.operators import align as A
from tidewatch.operators import events as E
from tidewatch.operators import features as W
from tidewatch.operators import intervals as I
from tidewatch.operators import manifest as M
from tidewatch.operators import trajectories as T
from tidewatch.plans import canonical as C
from tidewatch.plans.q_align import Night, _resampled, _series
from tidewatch.plans.q_features import STAGED, _fractions, _night_events, _stage_events, _stages, _states
from tidewatch.plans.register import Registry, off_ties, rounded
from tidewatch.session import written

query = Registry()
#: Pressure drives nothing, so it rests.
ROUTES = {
    "heart_rate": T.Route("pulse_rate", 1.0, 2.03), "hrv_rmssd": T.Route("brightness", 0.5, 5.07), "steps": T.Route("texture_density", 0.8), "temperature": T.Route("brightness", 0.6, 0.51),
    "pressure": T.Route(None, 0.4, 1.03),
}
SENSITIVITY = {m: r.sensitivity for m, r in ROUTES.items()}
CUT = """cut AS (SELECT r.session_id, src_idx, stage, is_brief, greatest(r.start_us, s.start_us) AS start_us, least(r.end_us, s.end_us) AS end_us FROM raw r JOIN sessions s USING (session_id)
  WHERE least(r.end_us, s.end_us) > greatest(r.start_us, s.start_us)),
pieces AS (SELECT session_id, lo, lead(lo) OVER (PARTITION BY session_id ORDER BY lo) AS hi FROM (SELECT session_id, start_us AS lo FROM cut UNION SELECT session_id, end_us FROM cut) QUALIFY hi IS NOT NULL),
won AS (SELECT p.session_id, lo, hi, src_idx, stage, is_brief FROM pieces p JOIN cut c ON c.session_id = p.session_id AND c.start_us <= lo AND c.end_us >= hi
  QUALIFY row_number() OVER (PARTITION BY p.session_id, lo ORDER BY is_brief DESC, start_us DESC, src_idx DESC) = 1),
g0 AS (SELECT *, CASE WHEN lag(hi) OVER o = lo AND lag(src_idx) OVER o = src_idx THEN 0 ELSE 1 END AS fresh FROM won WINDOW o AS (PARTITION BY session_id ORDER BY lo)),
g1 AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY lo) AS run FROM g0)"""


@query(f"WITH {C.POINTS}, {C.SESSIONS}, {C.RAW_STAGES}, {CUT} SELECT session_id, min(lo) AS start_us, max(hi) AS end_us, any_value(stage) AS stage, any_value(is_brief) AS is_brief FROM g1 GROUP BY session_id, run")
def build_stage_segments(spark, d):
    return I.stage_segments(C.stage_changes(spark, d), C.sessions(spark, d))


ISLANDS = """i0 AS (SELECT *, CASE WHEN start_us < max(end_us) OVER (PARTITION BY subject ORDER BY start_us, end_us, content ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM candidates),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY subject ORDER BY start_us, end_us, content ROWS UNBOUNDED PRECEDING) AS island FROM i0)"""


@query(f"""WITH {C.CANDIDATES}, {ISLANDS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY subject, island ORDER BY log_id IS NULL, is_main DESC, end_us - start_us DESC, start_us, content) AS r FROM islands)
SELECT subject, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS members, max(CASE WHEN r = 1 THEN log_id END) AS log_id, bool_or(is_main) AS is_main FROM ranked GROUP BY subject, island""")
def merge_intervals(spark, d):
    return I.merged(C.candidates(spark, d), ["subject"]).drop("island")


@query(f"""WITH {C.CANDIDATES}, {ISLANDS}, pieces AS (SELECT subject, island, lo, lead(lo) OVER (PARTITION BY subject, island ORDER BY lo) AS hi
  FROM (SELECT subject, island, start_us AS lo FROM islands UNION SELECT subject, island, end_us FROM islands) QUALIFY hi IS NOT NULL),
won AS (SELECT p.subject, p.island, lo, hi, content FROM pieces p JOIN islands c ON c.subject = p.subject AND c.island = p.island AND start_us <= lo AND end_us >= hi
  QUALIFY row_number() OVER (PARTITION BY p.subject, p.island, lo ORDER BY is_main DESC, end_us - start_us DESC, start_us, content) = 1),
g0 AS (SELECT *, CASE WHEN lag(hi) OVER o = lo AND lag(content) OVER o = content THEN 0 ELSE 1 END AS fresh FROM won WINDOW o AS (PARTITION BY subject, island ORDER BY lo)),
g1 AS (SELECT *, sum(fresh) OVER (PARTITION BY subject, island ORDER BY lo) AS run FROM g0)
SELECT subject, content, min(lo) AS start_us, max(hi) AS end_us FROM g1 GROUP BY subject, island, run, content""")
def interval_ownership(spark, d):
    return I.ownership(written(I.merge_islands(C.candidates(spark, d), ["subject"]), "islands"), ["subject", "island"]).select("subject", "content", "start_us", "end_us")


ROOTS = """link AS (SELECT a.content AS x, b.content AS y FROM candidates a JOIN candidates b ON a.subject = b.subject AND (a.log_id = b.log_id OR (a.start_us = b.start_us AND a.end_us = b.end_us))),
reach AS (SELECT content AS x, content AS y FROM candidates UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
roots AS (SELECT x AS content, min(y) AS root FROM reach GROUP BY 1)"""


@query(f"""WITH RECURSIVE {C.CANDIDATES}, {ROOTS} SELECT subject, content, start_us, end_us, log_id, is_main, n FROM (SELECT c.*, count(*) OVER (PARTITION BY root) AS n,
  row_number() OVER (PARTITION BY root ORDER BY is_main DESC, has_stages DESC, c.content) AS r FROM candidates c JOIN roots USING (content)) WHERE r = 1""")
def dedup_components(spark, d):
    return I.deduplicate(C.candidates(spark, d))


@query(f"""WITH {C.CANDIDATES} SELECT subject, content, row_number() OVER (PARTITION BY subject ORDER BY start_us DESC, end_us DESC, content) AS place, (end_us - start_us) // 60000000 AS minutes FROM candidates""")
def latest_first_listing(spark, d):
    return I.latest_first(C.candidates(spark, d)).select("subject", "content", "place", "minutes")


@query(f"""WITH {C.CANDIDATES}, m AS (SELECT *, strftime(timezone('America/New_York', make_timestamptz(end_us)), '%Y-%m-%d') AS day FROM candidates)
SELECT subject, content FROM m QUALIFY row_number() OVER (PARTITION BY subject ORDER BY is_main DESC, CASE WHEN is_main THEN start_us END DESC, CASE WHEN is_main THEN end_us END DESC,
  CASE WHEN NOT is_main THEN day END DESC, CASE WHEN NOT is_main THEN end_us - start_us END DESC, start_us DESC, content DESC) = 1""")
def auto_select(spark, d):
    return I.auto_select(C.candidates(spark, d), "America/New_York")


@query(f"""WITH {C.CANDIDATES}, old AS (SELECT subject, content, start_us, end_us FROM candidates WHERE NOT is_main), new AS (SELECT * FROM candidates WHERE is_main)
SELECT o.subject, o.content, arg_min(n.content, ((n.start_us, n.end_us) <> (o.start_us, o.end_us), n.end_us - n.start_us, n.content)) AS container FROM old o LEFT JOIN new n ON n.subject = o.subject AND n.start_us <= o.start_us AND n.end_us >= o.end_us GROUP BY ALL""")
def interval_containment(spark, d):
    c = C.candidates(spark, d)
    return I.containing(c.filter("not is_main").select("subject", "content", "start_us", "end_us"), c.filter("is_main"))


@query(f"""WITH {C.NORMAL}, daily AS (SELECT CAST(user_id // {C.USERS} AS VARCHAR) AS subject, strftime(ts, '%Y-%m-%d') AS day, avg(value) AS rmssd FROM events WHERE event_type = 'view' GROUP BY ALL),
have AS (SELECT DISTINCT session_id FROM series WHERE metric = 'hrv_rmssd' AND session_id NOT LIKE '%/0')
SELECT s.session_id, round(rmssd + 1.7e-9, 6) AS rmssd FROM sessions s JOIN daily d ON d.subject = s.subject AND day = strftime(make_timestamp(end_us), '%Y-%m-%d') WHERE s.session_id NOT IN (SELECT session_id FROM have)""")
def attach_daily(spark, d):
    """Subject 0 has no HRV within its nights."""
    views = C.table(spark, d, "events").filter("event_type = 'view'")
    daily = views.groupBy(F.floor(F.col("user_id") / C.USERS).cast("string").alias("subject"), F.to_date("ts").alias("date")).agg(F.avg("value").alias("rmssd"))
    series = _series(spark, d).filter("session_id not like '%/0'")
    return A.attach_daily(C.sessions(spark, d), series, daily, "UTC").select("session_id", off_ties("rmssd"))


@query(f"""WITH {C.POINTS}, {C.SESSIONS}, p AS (SELECT DISTINCT session_id, us, start_us, end_us FROM points JOIN sessions USING (session_id))
SELECT session_id, us, round(CASE WHEN us BETWEEN start_us AND end_us THEN (us - start_us) * 180 / CAST(end_us - start_us AS DOUBLE) END, 6) AS replay_s FROM p""")
def replay_time_map(spark, d):
    p = C.points(spark, d).select("session_id", "us").distinct().join(C.sessions(spark, d), "session_id")
    return p.select("session_id", "us", rounded(X.replay_time(F.col("us"), F.col("start_us"), F.col("end_us"), C.TARGET_S), "replay_s"))


@query(f"""WITH {C.SESSIONS} SELECT session_id, strftime(make_timestamp(start_us), '%Y-%m-%dT%H:%M:%SZ') || '/' || strftime(make_timestamp(end_us), '%Y-%m-%dT%H:%M:%SZ') AS key,
  (end_us - start_us) // 3600000000 || ' h ' || lpad(CAST((end_us - start_us) // 60000000 % 60 AS VARCHAR), 2, '0') || ' min' AS duration FROM sessions""")
def session_keys(spark, d):
    s = C.sessions(spark, d)
    return s.select("session_id", X.session_key(F.col("start_us"), F.col("end_us")).alias("key"), X.duration_text(F.col("end_us") - F.col("start_us")).alias("duration"))


@query("""SELECT event_id, round(CASE event_type WHEN 'signup' THEN value * 9 / 5 + 32 WHEN 'error' THEN value / 33.8638866667 ELSE value END + 1.7e-9, 6) AS shown FROM events""")
def display_units(spark, d):
    e = C.table(spark, d, "events").withColumn("shown", X.display_value(F.expr(C._case("event_type", C.METRIC)), F.col("value")))
    return e.select("event_id", off_ties("shown"))


VALUED = """valued AS (SELECT m.session_id, m.metric, m.w, CASE WHEN coalesce(present, 0) > 0 THEN smoothed END AS smoothed FROM smooth m LEFT JOIN stats s ON s.session_id = m.session_id AND s.metric = m.metric AND s.w = m.w)"""
SMOOTHED = f"{C.ALIGNED}, {C.WINDOWS}, {C.STATS}, {C.SMOOTH}, {VALUED}"
LEAST = "CASE metric WHEN 'heart_rate' THEN 10.0 WHEN 'hrv_rmssd' THEN 10.0 WHEN 'temperature' THEN 2.0 WHEN 'humidity' THEN 10.0 WHEN 'pressure' THEN 3.0 ELSE 1.0 END"
SPANS = f"""lim AS (SELECT session_id, metric, min(smoothed) AS lo, max(smoothed) AS hi FROM valued WHERE smoothed IS NOT NULL GROUP BY ALL),
spans AS (SELECT session_id, metric, (lo + hi) / 2 - greatest(hi - lo, {LEAST}) / 2 AS low, (lo + hi) / 2 + greatest(hi - lo, {LEAST}) / 2 AS high FROM lim)"""
SENS = "CASE metric WHEN 'heart_rate' THEN 1.0 WHEN 'hrv_rmssd' THEN 0.5 WHEN 'steps' THEN 0.8 WHEN 'temperature' THEN 0.6 WHEN 'pressure' THEN 0.4 END"
MAPPED = f"""nrm AS (SELECT s.session_id, s.metric, w, smoothed, least(1.0, greatest(0.0, (smoothed - low) / (high - low))) AS n FROM valued s LEFT JOIN spans p ON p.session_id = s.session_id AND p.metric = s.metric WHERE smoothed IS NOT NULL),
mapped AS (SELECT session_id, metric, w, smoothed, n, least(1.0, greatest(0.0, 0.5 + {SENS} * (n - 0.5) * CASE WHEN metric = 'pressure' THEN 0.5 ELSE 1.0 END)) AS v FROM nrm)"""


def _mapped(night):
    return T.normalize_windows(night.smooth, SENSITIVITY)


def _windows(spark, d):
    return W.windows(C.sessions(spark, d), C.TARGET_S)


def _spans(night):
    return T.window_spans(night.windows, night.sessions, C.TARGET_S)


def _followed(night):
    """The windows' values with movement in place of steps."""
    steps = night.movement.select("session_id", F.lit("steps").alias("metric"), "w", F.col("intensity").alias("smoothed"), F.lit(True).alias("present"), F.col("intensity").alias("n"))
    steps = steps.withColumn("v", X.mapped_value(F.col("n"), F.col("metric"), F.lit(ROUTES["steps"].sensitivity)))
    return _mapped(night).filter("metric <> 'steps'").unionByName(steps)


def _contributions(night):
    return T.contributions(_followed(night), _spans(night), ROUTES, C.TARGET_S)


def _restless(night):
    return T.restless_windows(night.movement, night.states, night.windows)


@query(f"WITH {SMOOTHED}, {SPANS} SELECT session_id, metric, round(low + 1.7e-9, 5) AS low, round(high + 1.7e-9, 5) AS high FROM spans")
def normalize_span(spark, d):
    return T.spans(Night(spark, d).smooth).select("session_id", "metric", off_ties("low", digits=5), off_ties("high", digits=5))


@query(f"WITH {SMOOTHED}, {SPANS}, {MAPPED} SELECT session_id, metric, w, round(n + 1.7e-9, 5) AS n, round(v + 1.7e-9, 5) AS v FROM mapped")
def mapped_values(spark, d):
    return _mapped(Night(spark, d)).filter("n is not null").select("session_id", "metric", "w", off_ties("n", digits=5), off_ties("v", digits=5))


# replay seconds, and each metric's trajectory: a fold over the windows, then its breakpoints but for glides that were cut
REPLAY = """rs AS (SELECT x.session_id, w, (w_start - start_us) / 1e6 / ((end_us - start_us) / 1e6 / 180) AS a, (w_end - start_us) / 1e6 / ((end_us - start_us) / 1e6 / 180) AS b FROM windows x JOIN sessions s USING (session_id))"""
LIMIT = "CASE metric WHEN 'heart_rate' THEN 2.03 WHEN 'hrv_rmssd' THEN 5.07 WHEN 'temperature' THEN 0.51 ELSE 0.0 END"
FOLLOWED = f"""{REPLAY}, every_ AS (SELECT s.session_id, s.metric, s.w, s.smoothed, v FROM valued s LEFT JOIN mapped m ON m.session_id = s.session_id AND m.metric = s.metric AND m.w = s.w WHERE s.metric <> 'steps'
  UNION ALL SELECT session_id, 'steps', w, intensity, least(1.0, greatest(0.0, 0.5 + 0.8 * (intensity - 0.5))) FROM movement),
live AS (SELECT x.session_id, x.metric, x.metric <> 'pressure' AND count(smoothed) > 0 AS live FROM (SELECT session_id, unnest(['heart_rate', 'hrv_rmssd', 'steps', 'temperature', 'pressure']) AS metric FROM sessions) x
  LEFT JOIN every_ e ON e.session_id = x.session_id AND e.metric = x.metric GROUP BY x.session_id, x.metric),
fo AS (SELECT e.session_id, e.metric, e.w, smoothed, v, a, b, (a + b) / 2 AS c, {LIMIT.replace("metric", "e.metric")} AS lim FROM every_ e JOIN live l ON l.session_id = e.session_id AND l.metric = e.metric AND l.live
  JOIN rs r ON r.session_id = e.session_id AND r.w = e.w),
fold AS (SELECT session_id, metric, w, smoothed IS NULL AS missing, smoothed AS ref, v AS applied, 0e0 AS t0, coalesce(v, 0.5e0) AS v0, c AS t1, coalesce(v, 0.5e0) AS v1, false AS flip, true AS center FROM fo WHERE w = 0
  UNION ALL SELECT session_id, metric, w, gone, ref, applied, CASE WHEN flip THEN a WHEN t1 < c THEN t1 ELSE t0 END, CASE WHEN flip THEN here WHEN t1 < c THEN v1 ELSE v0 END,
    CASE WHEN flip THEN a + 1.0 WHEN t1 < c THEN c ELSE t1 END, CASE WHEN flip OR t1 < c THEN CASE WHEN gone THEN 0.5 ELSE applied END ELSE v1 END, flip, NOT flip AND t1 < c
  FROM (SELECT f.session_id, f.metric, x.w, x.smoothed IS NULL AS gone, (x.smoothed IS NULL) <> f.missing AS flip, a, c, f.t0, f.v0, f.t1, f.v1,
      CASE WHEN x.smoothed IS NULL THEN f.ref WHEN f.missing OR abs(x.smoothed - f.ref) >= lim THEN x.smoothed ELSE f.ref END AS ref,
      CASE WHEN x.smoothed IS NULL THEN f.applied WHEN f.missing OR abs(x.smoothed - f.ref) >= lim THEN x.v ELSE f.applied END AS applied,
      CASE WHEN f.t1 <= a THEN f.v1 ELSE f.v0 + (f.v1 - f.v0) * (a - f.t0) / (f.t1 - f.t0) END AS here
    FROM fold f JOIN fo x ON x.session_id = f.session_id AND x.metric = f.metric AND x.w = f.w + 1)),
fl AS (SELECT *, min(CASE WHEN flip THEN t0 END) OVER (PARTITION BY session_id, metric ORDER BY w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later, max(w) OVER (PARTITION BY session_id, metric) AS last FROM fold),
contr AS (SELECT session_id, metric, t0 AS t, v0 AS v FROM fl WHERE w = 0 OR flip UNION ALL SELECT session_id, metric, t1, v1 FROM fl WHERE center OR flip AND (later IS NULL OR t1 < later)
  UNION ALL SELECT session_id, metric, 180e0, v1 FROM fl WHERE w = last AND t1 < 180 UNION ALL SELECT session_id, metric, unnest([0e0, 180e0]), 0.5e0 FROM live WHERE NOT live)"""
SOUND = f"{SMOOTHED}, {C.RAW_STAGES}, {C.SEGMENTS}, {C.OVERLAP}, {C.MOVEMENT}, {SPANS}, {MAPPED}, {FOLLOWED}"
RESTLESS = f"""{C.FRACTIONS}, {C.STATES},
q0 AS (SELECT m.session_id, m.w, w_start, w_end, intensity > {S.RESTLESS} AS up, state FROM movement m JOIN states s ON s.session_id = m.session_id AND s.w = m.w JOIN windows x ON x.session_id = m.session_id AND x.w = m.w),
q1 AS (SELECT *, CASE WHEN up = lag(up) OVER (PARTITION BY session_id ORDER BY w) THEN 0 ELSE 1 END AS fresh FROM q0), q2 AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY w) AS run FROM q1),
restless AS (SELECT session_id, w, state = 'restless' OR up AND max(w_end) OVER (PARTITION BY session_id, run) - min(w_start) OVER (PARTITION BY session_id, run) >= 600000000 AS restless FROM q2)"""


@query(f"WITH {C.SESSIONS}, {C.WINDOWS}, {REPLAY} SELECT session_id, w, round(a, 6) AS t0, round(b, 6) AS t1 FROM rs")
def window_spans(spark, d):
    return _spans(Night(spark, d)).select("session_id", "w", rounded("t0"), rounded("t1"))


@query(f"WITH RECURSIVE {SOUND} SELECT session_id, metric, round(t, 6) AS t, round(v + 1.7e-9, 5) AS v FROM contr")
def contribution(spark, d):
    return _contributions(Night(spark, d)).select("session_id", "metric", rounded("t"), off_ties("v", digits=5))


@query(f"WITH {SMOOTHED}, {C.RAW_STAGES}, {C.SEGMENTS}, {C.OVERLAP}, {C.MOVEMENT}, {RESTLESS} SELECT session_id, w, restless FROM restless")
def restless_windows(spark, d):
    return _restless(Night(spark, d))


@query(f"""WITH RECURSIVE {SOUND}, {RESTLESS}, times AS (SELECT session_id, t FROM contr WHERE t <= 180 UNION SELECT session_id, (a + b) / 2 FROM rs UNION SELECT session_id, unnest([0e0, 180e0]) FROM sessions),
ask AS (SELECT t.session_id, metric, t FROM times t JOIN (SELECT DISTINCT session_id, metric FROM contr WHERE metric <> 'pressure') USING (session_id)),
e0 AS (SELECT q.*, c.t AS u0, c.v AS x0 FROM ask q ASOF LEFT JOIN contr c ON q.session_id = c.session_id AND q.metric = c.metric AND q.t >= c.t),
e1 AS (SELECT q.*, c.t AS u1, c.v AS x1 FROM e0 q ASOF LEFT JOIN contr c ON q.session_id = c.session_id AND q.metric = c.metric AND q.t <= c.t),
val AS (SELECT session_id, metric, t, coalesce(CASE WHEN u0 = u1 THEN x0 ELSE x0 + (x1 - x0) * ((t - u0) / (u1 - u0)) END, x0, x1) AS v, {SENS} AS s FROM e1),
mix AS (SELECT session_id, CASE metric WHEN 'heart_rate' THEN 'pulse_rate' WHEN 'steps' THEN 'texture_density' ELSE 'brightness' END AS param, t, sum(v * s) / sum(s) AS v FROM val GROUP BY ALL),
bp AS (SELECT r.session_id, (a + b) / 2 AS t, CASE WHEN restless THEN 0.25e0 * 0.8e0 ELSE 0e0 END AS v FROM restless r JOIN rs ON rs.session_id = r.session_id AND rs.w = r.w),
b0 AS (SELECT q.*, c.t AS u0, c.v AS x0 FROM times q ASOF LEFT JOIN bp c ON q.session_id = c.session_id AND q.t >= c.t), b1 AS (SELECT q.*, c.t AS u1, c.v AS x1 FROM b0 q ASOF LEFT JOIN bp c ON q.session_id = c.session_id AND q.t <= c.t),
bo AS (SELECT session_id, t, coalesce(CASE WHEN u0 = u1 THEN x0 ELSE x0 + (x1 - x0) * ((t - u0) / (u1 - u0)) END, x0, x1) AS boost FROM b1),
al AS (SELECT t.session_id, p.param, t.t, CASE WHEN p.param IN ('texture_density', 'transient_density') THEN least(1.0, coalesce(m.v, 0.5) + boost) ELSE coalesce(m.v, 0.5) END AS x, CASE WHEN p.param IN ('brightness', 'texture_density', 'modulation') THEN 0.2 ELSE 0.5 END AS rate
  FROM times t JOIN bo ON bo.session_id = t.session_id AND bo.t = t.t, (SELECT unnest(['pulse_rate', 'rhythmic_density', 'intensity', 'transient_density', 'brightness', 'texture_density', 'modulation']) AS param) p
  LEFT JOIN mix m ON m.session_id = t.session_id AND m.param = p.param AND m.t = t.t),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id, param ORDER BY t) AS i FROM al),
f AS (SELECT session_id, param, i, t, x AS v FROM o WHERE i = 1 UNION ALL SELECT o.session_id, o.param, o.i, o.t, least(1.0, greatest(0.0, least(f.v + rate * (o.t - f.t), greatest(f.v - rate * (o.t - f.t), o.x)))) FROM f JOIN o ON o.session_id = f.session_id AND o.param = f.param AND o.i = f.i + 1)
SELECT session_id, param, round(t, 6) AS t, round(v + 1.7e-9, 5) AS v FROM f""")
def weighted_combine(spark, d):
    night = Night(spark, d)
    out = T.combine(_contributions(night), _spans(night), ROUTES, C.TARGET_S, _restless(night))
    return out.select("session_id", "param", rounded("t"), off_ties("v", digits=5))


@query(f"""WITH RECURSIVE {SMOOTHED}, {SPANS}, {MAPPED}, o AS (SELECT session_id, metric, w, v, row_number() OVER (PARTITION BY session_id, metric ORDER BY w) AS i FROM mapped WHERE metric = 'temperature'),
f AS (SELECT session_id, i, w, v AS x, v AS r FROM o WHERE i = 1 UNION ALL SELECT o.session_id, o.i, o.w, o.v, greatest(f.r - 0.1, least(f.r + 0.1, o.v)) FROM f JOIN o ON o.session_id = f.session_id AND o.i = f.i + 1)
SELECT session_id, w, round(r + 1.7e-9, 5) AS v FROM f""")
def rate_limit(spark, d):
    own = _mapped(Night(spark, d)).filter("n is not null and metric = 'temperature'")
    return T.rate_limit(own).select("session_id", "w", F.col("out").alias("v")).select("session_id", F.col("w").cast("int").alias("w"), off_ties("v", digits=5))


@query(f"""WITH RECURSIVE {SMOOTHED}, {SPANS}, {MAPPED}, o AS (SELECT s.session_id, s.w, s.smoothed AS x, v FROM valued s LEFT JOIN mapped m ON m.session_id = s.session_id AND m.metric = s.metric AND m.w = s.w WHERE s.metric = 'hrv_rmssd'),
f AS (SELECT session_id, w, x AS ref, v AS r FROM o WHERE w = 0 UNION ALL SELECT o.session_id, o.w, CASE WHEN o.x IS NULL THEN NULL WHEN f.ref IS NULL OR abs(o.x - f.ref) >= 5.07 THEN o.x ELSE f.ref END,
  CASE WHEN o.x IS NULL THEN NULL WHEN f.ref IS NULL OR abs(o.x - f.ref) >= 5.07 THEN o.v ELSE f.r END FROM f JOIN o ON o.session_id = f.session_id AND o.w = f.w + 1)
SELECT session_id, w, round(r + 1.7e-9, 5) AS v FROM f""")
def hysteresis(spark, d):
    own = _mapped(Night(spark, d)).filter("metric = 'hrv_rmssd'").withColumn("smoothed", F.when(F.col("present"), F.col("smoothed")))
    return T.hysteresis(own, "smoothed", 5.07, applied="v").select("session_id", F.col("w").cast("int").alias("w"), F.col("out").alias("v")).select("session_id", "w", off_ties("v", digits=5))


@query(f"""WITH RECURSIVE {SMOOTHED}, {REPLAY}, nt AS (SELECT r.session_id, r.metric, r.w, least(180.0, (a + b) / 2) AS t,
  coalesce(CASE WHEN r.metric = 'temperature' AND smoothed IS NOT NULL THEN least(1.0, abs(smoothed - median(smoothed) OVER (PARTITION BY r.session_id, r.metric)) / 1.0) * 0.6 END, 0.0) AS x
  FROM (SELECT *, unnest(['temperature', 'humidity', 'pressure']) AS metric FROM rs) r LEFT JOIN valued s ON s.session_id = r.session_id AND s.metric = r.metric AND s.w = r.w),
f AS (SELECT session_id, metric, w, t, x AS v, x FROM nt WHERE w = 0 UNION ALL SELECT n.session_id, n.metric, n.w, n.t, f.v + greatest(-0.08 * (n.t - f.t), least(0.08 * (n.t - f.t), n.x - f.v)), n.x
  FROM f JOIN nt n ON n.session_id = f.session_id AND n.metric = f.metric AND n.w = f.w + 1)
SELECT session_id, metric, round(t, 6) AS t, round(v + 1.7e-9, 5) AS v FROM f UNION ALL SELECT session_id, metric, 0.0, round(v + 1.7e-9, 5) FROM f WHERE w = 0
UNION ALL SELECT session_id, metric, 180.0, round(arg_max(v, w) + 1.7e-9, 5) FROM f GROUP BY ALL""")
def variation_score(spark, d):
    night = Night(spark, d)
    out = T.nature_controls(night.smooth, _spans(night), ROUTES, C.TARGET_S)
    return out.select("session_id", "metric", rounded("t"), off_ties("v", digits=5))


PRESETS = f"""WITH {STAGED}, {C.STATES},
p0 AS (SELECT session_id, w, CASE state WHEN 'awake' THEN 'Awake' WHEN 'deep' THEN 'Deep' WHEN 'rem' THEN 'REM' WHEN 'unknown' THEN 'Neutral' ELSE 'Light' END AS preset FROM states),
p1 AS (SELECT *, CASE WHEN preset = lag(preset) OVER (PARTITION BY session_id ORDER BY w) THEN 0 ELSE 1 END AS fresh FROM p0), p2 AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY w) AS run FROM p1),
p3 AS (SELECT session_id, preset, min(w) * 0.5 AS t0, (max(w) + 1) * 0.5 AS t1 FROM p2 GROUP BY session_id, run, preset),
spans AS (SELECT *, CASE WHEN lag(t0) OVER o IS NULL THEN 0.0 ELSE least(2.0, t1 - t0, lag(t1 - t0) OVER o) END AS fade FROM p3 WINDOW o AS (PARTITION BY session_id ORDER BY t0))"""


@query(f"{PRESETS} SELECT session_id, preset, CAST(t0 AS DOUBLE) AS t0, CAST(t1 AS DOUBLE) AS t1, CAST(fade AS DOUBLE) AS fade FROM spans")
def preset_spans(spark, d):
    return T.preset_spans(_states(spark, d))


@query(f"""{PRESETS}, q AS (SELECT session_id, i * 0.7e0 AS t FROM sessions, range(0, 257) r(i)), z AS (SELECT *, coalesce(lead(fade) OVER (PARTITION BY session_id ORDER BY t0), 0.0) AS out FROM spans),
g AS (SELECT q.session_id, t, preset, CASE WHEN out > 0 AND t >= t1 - out / 2 AND t <= t1 + out / 2 THEN (t1 + out / 2 - t) / out WHEN fade > 0 AND t >= t0 - fade / 2 AND t < t0 + fade / 2 THEN (t - t0 + fade / 2) / fade
  WHEN t >= t0 AND t <= t1 THEN 1.0 END AS gain FROM q JOIN z ON z.session_id = q.session_id AND t >= t0 - fade / 2 AND t <= t1 + out / 2)
SELECT session_id, round(t, 3) AS t, preset, round(sum(gain), 6) AS gain FROM g GROUP BY ALL HAVING sum(gain) > 1e-9""")
def preset_gains(spark, d):
    probes = C.sessions(spark, d).select("session_id", F.explode(F.sequence(F.lit(0), F.lit(256))).alias("i")).select("session_id", (F.col("i") * F.lit(0.7)).alias("t"))
    return T.preset_gains(T.preset_spans(_states(spark, d)), probes).filter("gain > 1e-9").select("session_id", rounded("t", digits=3), "preset", rounded("gain"))


@query(f"""WITH {C.NORMAL}, b AS (SELECT * EXCLUDE metric FROM series WHERE metric = 'temperature'), q AS (SELECT session_id, start_us + i * 1800000000 AS us FROM sessions, range(0, 49) r(i) WHERE session_id IN (SELECT session_id FROM b)),
x AS (SELECT q.*, b.us AS u0, b.value AS v0 FROM q ASOF LEFT JOIN b ON q.session_id = b.session_id AND q.us >= b.us), y AS (SELECT x.*, b.us AS u1, b.value AS v1 FROM x ASOF LEFT JOIN b ON x.session_id = b.session_id AND x.us <= b.us)
SELECT session_id, us, round(coalesce(CASE WHEN u0 = u1 THEN v0 ELSE v0 + (v1 - v0) * ((us - u0) / CAST(u1 - u0 AS DOUBLE)) END, v0, v1) + 1.7e-9, 6) AS value FROM y""")
def piecewise_eval(spark, d):
    b = _series(spark, d).filter("metric = 'temperature'").drop("metric")
    q = C.sessions(spark, d).join(b.select("session_id").distinct(), "session_id").select("session_id", "start_us", F.explode(F.sequence(F.lit(0), F.lit(48))).alias("i")).select("session_id", (F.col("start_us") + F.col("i").cast("bigint") * 1_800_000_000).alias("us"))
    return T.evaluate(b, q, ["session_id"]).select("session_id", "us", off_ties("value"))


@query(f"""WITH {C.POINTS}, {C.SESSIONS}, {C.RAW_STAGES}, {C.SEGMENTS}, b AS (SELECT session_id, min(start_us) FILTER (stage <> 'awake') AS onset, max(end_us) FILTER (stage <> 'awake') AS wake FROM segments GROUP BY 1),
e AS (SELECT session_id, 'sleep_onset' AS type, onset AS us FROM b WHERE onset IS NOT NULL UNION ALL SELECT session_id, 'final_awakening', wake FROM b WHERE onset IS NOT NULL),
r AS (SELECT session_id, type, (us - start_us) * 180 / CAST(end_us - start_us AS DOUBLE) AS t FROM e JOIN sessions USING (session_id))
SELECT session_id, type, round(least(178.0, greatest(0.0, t - 1)), 6) AS t0, round(least(178.0, greatest(0.0, t - 1)) + 2, 6) AS t1 FROM r""")
def gestures(spark, d):
    ev = E.label_events(_stage_events(spark, d), C.sessions(spark, d), "UTC", C.TARGET_S)
    return T.gestures(ev, C.TARGET_S).select("session_id", "type", rounded("t0"), rounded("t1"))


def _daily(sessions):
    """Subject 0 has a daily figure of HRV."""
    return sessions.filter("session_id like '%/0'").select("session_id", F.lit(40.5).alias("rmssd"))


def _fingerprints(spark, d):
    s = C.sessions(spark, d)
    return A.fingerprint(s, C.points(spark, d), C.segments(spark, d), _daily(s))


FINGERPRINT = """records AS (SELECT session_id, sha256('session|' || start_us || '|' || end_us) AS h FROM sessions
  UNION ALL SELECT session_id, sha256(concat_ws('|', 'point', source, metric, us, CAST(value AS VARCHAR), unit)) FROM points
  UNION ALL SELECT session_id, sha256(concat_ws('|', 'segment', start_us, end_us, stage, is_brief)) FROM segments
  UNION ALL SELECT session_id, sha256('daily|40.5') FROM sessions WHERE session_id LIKE '%/0'),
counted AS (SELECT session_id, h, count(*) AS n FROM records GROUP BY ALL), many AS (SELECT session_id, CAST(ceil(count(*) / 4096.0) AS BIGINT) AS blocks FROM counted GROUP BY 1),
leaves AS (SELECT session_id, CAST('0x' || substr(h, 1, 15) AS BIGINT) % blocks AS block, sha256(string_agg(h || ':' || n, ',' ORDER BY h || ':' || n)) AS leaf FROM counted JOIN many USING (session_id) GROUP BY ALL),
prints AS (SELECT session_id, sha256('1|' || string_agg(leaf, ',' ORDER BY block)) AS fingerprint FROM leaves GROUP BY 1)"""


@query(f"WITH {C.POINTS}, {C.SESSIONS}, {C.RAW_STAGES}, {C.SEGMENTS}, {FINGERPRINT} SELECT session_id, fingerprint FROM prints")
def fingerprint(spark, d):
    return _fingerprints(spark, d)


def _manifests(spark, d):
    n = Night(spark, d)
    have = W.availability(n.timeline, n.sessions, _stages(spark, d, n), _daily(n.sessions))
    events = E.label_events(E.cap_events(written(E.merge_events(_night_events(spark, d, n)), "events")), n.sessions, "Europe/Berlin", C.TARGET_S)
    prints = A.fingerprint(n.sessions, C.points(spark, d), n.segments, _daily(n.sessions))
    parts = [n.states, n.smooth, written(have, "availability"), written(events, "labelled"), written(prints, "fingerprints")]
    return M.manifest(n.steps, *parts, ROUTES, C.TARGET_S, "Europe/Berlin")


@query()
def manifest_json(spark, d):
    return _manifests(spark, d)


@query(f"WITH {C.SESSIONS} SELECT session_id, 0 AS problems FROM sessions")
def manifest_problems(spark, d):
    """Every manifest that is written holds what it must. (Each check is broken once in the tests.)"""
    whole = written(_manifests(spark, d), "manifests")  # read twice below
    found = M.manifest_problems(whole).groupBy("session_id").agg(F.count(F.lit(1)).alias("problems"))
    return whole.select("session_id").join(found, "session_id", "left").select("session_id", F.coalesce("problems", F.lit(0)).alias("problems"))


# of the windows some are left out and some moved, of the fractions some are halved
BENT = """bent AS (SELECT session_id, w, w_start + CASE WHEN w % 50 = 3 THEN 1 ELSE 0 END AS w_start, w_end FROM windows WHERE NOT (w = 7 AND session_id LIKE '%/1') AND NOT (w = 359 AND session_id LIKE '%5/0'))"""


@query(f"""WITH {STAGED}, {BENT}, per AS (SELECT b.session_id, count(*) AS n, min(w_start) AS lo, max(w_end) AS hi, any_value(s.start_us) AS s0, any_value(s.end_us) AS s1 FROM bent b JOIN sessions s USING (session_id) GROUP BY 1),
o AS (SELECT *, lag(w_end) OVER (PARTITION BY session_id ORDER BY w) AS before FROM bent), sums AS (SELECT session_id, w, sum(us / CAST(length AS DOUBLE) * CASE WHEN w % 40 = 1 THEN 0.5 ELSE 1 END) AS f FROM fractions GROUP BY ALL)
SELECT 'window_count' AS check, count(*) FILTER (n <> 360) AS violations FROM per UNION ALL SELECT 'contiguous', count(*) FILTER (before IS NOT NULL AND before <> w_start OR w_end <= w_start) FROM o
UNION ALL SELECT 'coverage', count(*) FILTER (lo <> s0 OR hi <> s1) FROM per UNION ALL SELECT 'fractions', count(*) FILTER (abs(f - 1) > 1e-9) FROM sums""")
def manifest_checks(spark, d):
    w = _windows(spark, d).withColumn("w_start", F.col("w_start") + F.when(F.col("w") % 50 == 3, 1).otherwise(0))
    w = w.filter("not (w = 7 and session_id like '%/1') and not (w = 359 and session_id like '%5/0')")
    f = _fractions(spark, d).withColumn("fraction", F.col("fraction") * F.when(F.col("w") % 40 == 1, 0.5).otherwise(1.0))
    return M.violations(C.sessions(spark, d), w, f, C.TARGET_S)


@query("""WITH r AS (SELECT DISTINCT o_custkey AS fingerprint, o_orderpriority AS config FROM orders)
SELECT r.fingerprint, r.config, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS replay FROM r LEFT JOIN orders o ON o.o_custkey = r.fingerprint AND o.o_orderpriority = r.config AND o.o_orderstatus = 'F' GROUP BY ALL""")
def cache_lookup(spark, d):
    o = C.table(spark, d, "orders")
    replays = o.select(F.col("o_custkey").alias("fingerprint"), F.col("o_orderpriority").alias("config"), F.col("o_orderstatus").alias("version"), F.struct("o_orderdate", "o_orderkey").alias("seq"), F.col("o_orderkey").alias("replay"))
    asked = o.select(F.col("o_custkey").alias("fingerprint"), F.col("o_orderpriority").alias("config"), F.lit("F").alias("version")).distinct()
    return M.cache_lookup(asked, replays).drop("version")


@query("""WITH v AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND value > 100), e AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 100)
SELECT user_id, 'both' AS side FROM (SELECT * FROM v INTERSECT SELECT * FROM e) UNION ALL SELECT user_id, 'left' FROM (SELECT * FROM v EXCEPT SELECT * FROM e) UNION ALL SELECT user_id, 'right' FROM (SELECT * FROM e EXCEPT SELECT * FROM v)""")
def set_operations(spark, d):
    e = C.table(spark, d, "events").filter("value > 100")
    return A.set_sides(e.filter("event_type = 'view'"), e.filter("event_type = 'error'"), ["user_id"])


@query(f"""WITH {C.POINTS} SELECT session_id, count(DISTINCT source) AS sources, string_agg(DISTINCT metric, ',' ORDER BY metric) AS metrics FROM points WHERE us >= epoch_us(TIMESTAMP '2024-01-05') AND us < epoch_us(TIMESTAMP '2024-01-10') GROUP BY 1""")
def selection_window(spark, d):
    """The feature: only the days that are asked for are read, by the statistics of the column as it is stored."""
    days = C.points(spark, d, "ts >= '2024-01-05' and ts < '2024-01-10'")
    return days.groupBy("session_id").agg(F.countDistinct("source").alias("sources"), F.array_join(F.array_sort(F.collect_set("metric")), ",").alias("metrics"))


@query(f"""WITH {C.POINTS} SELECT session_id, count(*) FILTER (metric = 'heart_rate') AS heart_rate, count(*) FILTER (metric = 'steps') AS steps, count(*) FILTER (metric = 'pressure') AS pressure FROM points GROUP BY 1""")
def pivot_counts(spark, d):
    return A.pivot_counts(C.points(spark, d), ("heart_rate", "steps", "pressure"))


@query(f"""WITH {C.POINTS}, s AS (SELECT metric, us, lag(us) OVER (PARTITION BY metric ORDER BY us) AS before FROM points) SELECT metric, count(*) AS n, max(us - before) AS widest_us FROM s GROUP BY 1""")
def widest_gap(spark, d):
    return A.widest_gaps(C.points(spark, d))


@query(f"""WITH {C.NORMAL}, {C.GRID}, {C.RESAMPLED}, cover AS (SELECT session_id, avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END) AS c FROM resampled WHERE metric = 'heart_rate' GROUP BY 1)
SELECT x.session_id FROM sessions x LEFT JOIN cover USING (session_id) WHERE coalesce(c, 0) < 0.5 AND EXISTS
  (SELECT 1 FROM points p WHERE p.subject = x.subject AND p.metric = 'heart_rate' AND (p.us BETWEEN start_us - 50400000000 AND start_us - 1 OR p.us BETWEEN end_us + 1 AND end_us + 50400000000))""")
def nearby_exists(spark, d):
    resampled = _resampled(spark, d)
    return A.timezone_suspects(resampled, C.points(spark, d), C.sessions(spark, d)).filter("suspect").select("session_id")


@query(f"""WITH {C.ALIGNED}, {C.RAW_STAGES}, {C.SEGMENTS}, {C.WINDOWS}, {C.STATS}, {C.OVERLAP}, {C.MOVEMENT}, {REPLAY},
j AS (SELECT m.session_id, m.w, a, b, intensity, CAST('0x' || substr(md5('1:' || m.session_id || ':' || m.w), 1, 8) AS BIGINT) / 4294967296e0 AS u FROM movement m JOIN rs ON rs.session_id = m.session_id AND rs.w = m.w WHERE intensity > {S.TRANSIENT})
SELECT session_id, round(a + (b - a) * (0.25 + 0.5 * u), 6) AS t, round(0.8 * intensity + 1.7e-9, 6) AS amp, 'movement' AS kind FROM j
UNION ALL SELECT g.session_id, round((g.start_us - s.start_us) / 1e6 / ((s.end_us - s.start_us) / 1e6 / 180), 6), 0.4, 'brief_awakening' FROM segments g JOIN sessions s USING (session_id)
  WHERE stage = 'awake' AND (g.end_us - g.start_us) / 1e6 < (s.end_us - s.start_us) / 1e6 / 180""")
def schedule_transients(spark, d):
    night = Night(spark, d)
    brief = W.brief_starts(night.segments, night.sessions, C.TARGET_S)
    t = T.schedule_transients(night.movement, _spans(night), ROUTES, brief)
    return t.select("session_id", rounded("t"), off_ties("amp"), "kind")
