"""Queries: windowed features, runs, events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions import scalars as X
from tidewatch.operators import align as A
from tidewatch.operators import events as E
from tidewatch.operators import features as W
from tidewatch.operators import intervals as I
from tidewatch.plans import canonical as C
from tidewatch.plans.q_align import Night, _resampled, _timeline
from tidewatch.plans.register import Registry, off_ties, rounded
from tidewatch.session import written

query = Registry()
STAGED = ",".join((C.POINTS, C.SESSIONS, C.RAW_STAGES, C.SEGMENTS, C.WINDOWS, C.OVERLAP, C.FRACTIONS))
SAMPLED = ",".join((C.NORMAL, C.GRID, C.RAW_STAGES, C.SEGMENTS))
STAGE_AT = """stages AS (SELECT g.session_id, k, us, res_us, CASE WHEN us < s.end_us THEN stage ELSE 'unknown' END AS stage FROM grid g ASOF LEFT JOIN segments s ON g.session_id = s.session_id AND g.us >= s.start_us),
r0 AS (SELECT *, CASE WHEN stage = lag(stage) OVER (PARTITION BY session_id ORDER BY us) THEN 0 ELSE 1 END AS fresh FROM stages), r1 AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY us) AS run FROM r0),
runs AS (SELECT session_id, stage, min(us) AS start_us, min(us) + count(*) * any_value(res_us) AS end_us FROM r1 GROUP BY session_id, run, stage)"""


def _stages(spark, d, night=None):
    n = night or Night(spark, d)
    return A.assign_stages(n.segments, n.steps)


def _fractions(spark, d):
    return W.stage_fractions(C.segments(spark, d), C.sessions(spark, d), C.TARGET_S)


def _states(spark, d):
    return W.coarse_states(W.dominant_stage(_fractions(spark, d)))


def _movement(spark, d, steps=True):
    n = Night(spark, d)
    own = A.hold_steps(*n.base) if steps else spark.createDataFrame([], "session_id string, k bigint, us bigint, value double")
    return W.movement(own, n.segments, n.sessions, C.TARGET_S)


@query(f"WITH {C.SESSIONS}, {C.WINDOWS} SELECT session_id, w, w_start, w_end FROM windows")
def window_edges(spark, d):
    return W.windows(C.sessions(spark, d), C.TARGET_S)


@query(f"WITH {C.ALIGNED}, {C.WINDOWS}, {C.STATS} SELECT session_id, metric, w, n, present, round(mean + 1.7e-9, 6) AS mean, round(lo + 1.7e-9, 6) AS min, round(hi + 1.7e-9, 6) AS max FROM stats")
def tumbling_stats(spark, d):
    s = W.window_stats(_timeline(spark, d), C.sessions(spark, d), C.TARGET_S)
    return s.select("session_id", "metric", "w", "n", "present", *[off_ties(c) for c in ("mean", "min", "max")])


@query(f"WITH {C.ALIGNED}, {C.WINDOWS}, {C.STATS} SELECT session_id, metric, w, round(slope + 1.7e-9, 3) AS slope FROM stats")
def window_slope(spark, d):
    return W.window_stats(_timeline(spark, d), C.sessions(spark, d), C.TARGET_S).select("session_id", "metric", "w", off_ties("slope", digits=3))


@query(f"""WITH {C.ALIGNED}, {C.WINDOWS}, {C.STATS}, m AS (SELECT DISTINCT session_id, metric FROM timeline)
SELECT x.session_id, m.metric, x.w, round(coalesce(1 - present / CAST(n AS DOUBLE), 1.0), 6) AS missing FROM windows x JOIN m ON m.session_id = x.session_id
LEFT JOIN stats s ON s.session_id = x.session_id AND s.metric = m.metric AND s.w = x.w""")
def missing_fraction(spark, d):
    night = Night(spark, d)
    stats = W.window_stats(_timeline(spark, d, night.base), night.sessions, C.TARGET_S).select("session_id", "metric", "w", "n", "present")
    stats = written(stats, "window-counts")  # each sample is in a window, so these have all metrics of the timeline
    return W.missing_fraction(stats, night.sessions, stats.select("session_id", "metric").distinct(), C.TARGET_S).withColumn("missing", F.round("missing", 6))


@query(f"WITH {C.ALIGNED}, {C.WINDOWS}, {C.SMOOTH} SELECT session_id, metric, w, round(smoothed + 1.7e-9, 6) AS smoothed FROM smooth")
def window_smooth_mid(spark, d):
    night = Night(spark, d)
    return W.window_smooth(night.timeline, night.sessions, C.TARGET_S).select("session_id", "metric", "w", off_ties("smoothed"))


@query(f"""WITH {C.ALIGNED} SELECT session_id, metric, k, round(CASE WHEN value IS NOT NULL THEN CASE WHEN metric = 'heart_rate'
  THEN avg(value) OVER (PARTITION BY session_id, metric ORDER BY us RANGE BETWEEN 150000000 PRECEDING AND 150000000 FOLLOWING)
  ELSE avg(value) OVER (PARTITION BY session_id, metric ORDER BY us RANGE BETWEEN 450000000 PRECEDING AND 450000000 FOLLOWING) END END + 1.7e-9, 6) AS smoothed FROM timeline""")
def centered_smooth(spark, d):
    return W.sample_smooth(_timeline(spark, d)).select("session_id", "metric", "k", off_ties("smoothed"))


@query(f"WITH {STAGED} SELECT session_id, w, stage, us, round(us / CAST(length AS DOUBLE), 6) AS fraction FROM fractions")
def stage_fraction(spark, d):
    return _fractions(spark, d).withColumn("fraction", F.round("fraction", 6))


@query(f"WITH {STAGED} SELECT session_id, w, stage FROM dominant")
def dominant_stage(spark, d):
    return W.dominant_stage(_fractions(spark, d))


@query(f"WITH {STAGED}, {C.STATES} SELECT session_id, w, state FROM states")
def coarse_states(spark, d):
    return _states(spark, d)


@query(f"WITH {C.ALIGNED}, {C.RAW_STAGES}, {C.SEGMENTS}, {C.WINDOWS}, {C.STATS}, {C.OVERLAP}, {C.MOVEMENT} SELECT session_id, w, round(intensity, 6) AS intensity FROM movement")
def movement_intensity(spark, d):
    return _movement(spark, d).withColumn("intensity", F.round("intensity", 6))


@query(f"""WITH {C.ALIGNED.replace(C.TIMELINE, "timeline AS (SELECT session_id, metric, k, us, value FROM resampled UNION ALL SELECT session_id, 'steps', k, us, value FROM held WHERE false)")},
 {C.RAW_STAGES}, {C.SEGMENTS}, {C.WINDOWS}, {C.STATS}, {C.OVERLAP}, {C.MOVEMENT} SELECT session_id, w, round(intensity, 6) AS intensity FROM movement""")
def movement_fallback(spark, d):
    return _movement(spark, d, steps=False).withColumn("intensity", F.round("intensity", 6))


@query(f"WITH {C.POINTS}, {C.SESSIONS}, {C.RAW_STAGES}, {C.SEGMENTS} SELECT session_id, s.start_us, s.end_us FROM segments s JOIN sessions x USING (session_id) WHERE stage = 'awake' AND (s.end_us - s.start_us) / 1e6 < (x.end_us - x.start_us) / 1e6 / 48")
def brief_awakenings(spark, d):
    return W.brief_awakenings(C.segments(spark, d), C.sessions(spark, d), 48)


@query(f"""WITH {C.ALIGNED}, share AS (SELECT session_id, metric, 1 - count(value) / CAST(count(*) AS DOUBLE) AS missing FROM timeline GROUP BY session_id, metric)
SELECT x.session_id, x.metric, round(coalesce(missing, 1), 6) AS missing, coalesce(missing, 1) < 1 AS available
FROM (SELECT session_id, unnest(['heart_rate', 'hrv_rmssd', 'steps', 'temperature', 'humidity', 'pressure']) AS metric FROM sessions) x LEFT JOIN share a ON a.session_id = x.session_id AND a.metric = x.metric""")
def metric_availability(spark, d):
    return W.availability(_timeline(spark, d), C.sessions(spark, d)).withColumn("missing", F.round("missing", 6))


@query(f"WITH {SAMPLED}, {STAGE_AT} SELECT session_id, stage, start_us, end_us FROM runs")
def state_runs(spark, d):
    return E.stage_runs(_stages(spark, d))


def _threshold_sql(op: str, threshold: float, least: int) -> str:
    return f"""WITH {C.ALIGNED}, {C.RAW_STAGES}, {C.SEGMENTS}, {C.WINDOWS}, {C.STATS}, {C.OVERLAP}, {C.MOVEMENT},
h0 AS (SELECT *, intensity {op} {threshold} AS hit FROM movement), h1 AS (SELECT *, CASE WHEN hit = lag(hit) OVER (PARTITION BY session_id ORDER BY w) THEN 0 ELSE 1 END AS fresh FROM h0),
h2 AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY w) AS run FROM h1)
SELECT session_id, min(w) AS first, max(w) AS last, count(*) AS n, round(max(intensity), 6) AS most, round(avg(intensity), 6) AS mean FROM h2 WHERE hit GROUP BY session_id, run HAVING count(*) >= {least}"""


@query(_threshold_sql(">=", S.BURST, 1))
def threshold_runs(spark, d):
    return E.threshold_runs(_movement(spark, d), "intensity", S.BURST).select("session_id", "first", "last", "n", rounded("most"), rounded("mean"))


@query(_threshold_sql(">", S.RESTLESS, 2))
def strict_threshold_runs(spark, d):
    return E.threshold_runs(_movement(spark, d), "intensity", S.RESTLESS, strict=True, least=2).select("session_id", "first", "last", "n", rounded("most"), rounded("mean"))


BOUNDS = """bounds AS (SELECT session_id, min(start_us) FILTER (stage NOT IN ('awake', 'unknown')) AS onset_us, max(end_us) FILTER (stage NOT IN ('awake', 'unknown')) AS wake_us,
  CASE WHEN bool_or(stage IN ('light', 'deep', 'rem')) THEN 'stages' WHEN bool_or(stage <> 'unknown') THEN 'classic' ELSE 'none' END AS availability FROM segments GROUP BY 1)"""


@query(f"WITH {C.POINTS}, {C.SESSIONS}, {C.RAW_STAGES}, {C.SEGMENTS}, {BOUNDS} SELECT session_id, onset_us, wake_us, availability FROM bounds")
def sleep_bounds(spark, d):
    return I.sleep_bounds(C.segments(spark, d))


EVENTS = """events_ AS (SELECT session_id, 'sleep_onset' AS type, onset_us AS us, 1.0 AS magnitude FROM bounds WHERE onset_us IS NOT NULL
  UNION ALL SELECT session_id, 'final_awakening', wake_us, 1.0 FROM bounds WHERE onset_us IS NOT NULL
  UNION ALL SELECT session_id, 'awakening', start_us, least(1.0, (end_us - start_us) / 6e8) FROM runs JOIN bounds USING (session_id) WHERE stage = 'awake' AND start_us > onset_us AND end_us <= wake_us AND end_us - start_us >= 300000000
  UNION ALL SELECT session_id, stage || '_transition', start_us, least(1.0, (end_us - start_us) / 12e8) FROM runs JOIN bounds USING (session_id)
    WHERE stage IN ('light', 'deep', 'rem') AND start_us > onset_us AND end_us - start_us >= 600000000)"""


def _stage_events(spark, d, night=None):
    n = night or Night(spark, d)
    return E.stage_events(written(E.stage_runs(_stages(spark, d, n)), "stage-runs"), I.sleep_bounds(n.segments))


@query(f"WITH {SAMPLED}, {STAGE_AT}, {BOUNDS}, {EVENTS} SELECT session_id, type, us, round(magnitude, 6) AS magnitude FROM events_")
def stage_events(spark, d):
    return _stage_events(spark, d).withColumn("magnitude", F.round("magnitude", 6))


MOVES = f"""{C.STATS}, {C.MOVEMENT},
mv0 AS (SELECT m.*, w_start, w_end, intensity >= {S.BURST} AS b, intensity >= {S.RESTLESS} AS r FROM movement m JOIN windows x ON x.session_id = m.session_id AND x.w = m.w),
mv1 AS (SELECT *, CASE WHEN b = lag(b) OVER o THEN 0 ELSE 1 END AS fb, CASE WHEN r = lag(r) OVER o THEN 0 ELSE 1 END AS fr FROM mv0 WINDOW o AS (PARTITION BY session_id ORDER BY w)),
mv2 AS (SELECT *, sum(fb) OVER o AS gb, sum(fr) OVER o AS gr FROM mv1 WINDOW o AS (PARTITION BY session_id ORDER BY w)),
moves AS (SELECT session_id, 'movement_burst' AS type, min(w_start) AS us, max(intensity) AS magnitude FROM mv2 WHERE b GROUP BY session_id, gb
  UNION ALL SELECT session_id, 'restless_period', min(w_start), avg(intensity) FROM mv2 WHERE r GROUP BY session_id, gr HAVING max(w_end) - min(w_start) >= {S.RESTLESS_US})"""
MERGED = f"""am AS (SELECT *, row_number() OVER (PARTITION BY session_id, type ORDER BY us, magnitude) AS i FROM allof),
mg AS (SELECT session_id, type, i, us, us AS anchor, magnitude FROM am WHERE i = 1
  UNION ALL SELECT a.session_id, a.type, a.i, a.us, CASE WHEN a.us - m.anchor <= {S.MERGE_US} THEN m.anchor ELSE a.us END, a.magnitude FROM mg m JOIN am a ON a.session_id = m.session_id AND a.type = m.type AND a.i = m.i + 1),
merged AS (SELECT session_id, type, anchor AS us, max(magnitude) AS magnitude FROM mg GROUP BY session_id, type, anchor)"""
NIGHT = f"{C.ALIGNED}, {C.RAW_STAGES}, {C.SEGMENTS}, {C.WINDOWS}, {C.OVERLAP}, {STAGE_AT}, {BOUNDS}, {EVENTS}, {MOVES}"


def _movement_events(spark, d, night=None):
    n = night or Night(spark, d)
    return E.movement_events(n.movement, n.windows)


def _night_events(spark, d, night=None):
    n = night or Night(spark, d)
    return written(_stage_events(spark, d, n).unionByName(_movement_events(spark, d, n)), "night-events")


@query(f"WITH {C.ALIGNED}, {C.RAW_STAGES}, {C.SEGMENTS}, {C.WINDOWS}, {C.OVERLAP}, {MOVES} SELECT session_id, type, us, round(magnitude + 1.7e-9, 6) AS magnitude FROM moves")
def movement_events(spark, d):
    return _movement_events(spark, d).select("session_id", "type", "us", off_ties("magnitude"))


@query(f"WITH RECURSIVE {NIGHT}, allof AS (SELECT * FROM events_ UNION ALL SELECT * FROM moves), {MERGED} SELECT session_id, type, us, round(magnitude + 1.7e-9, 6) AS magnitude FROM merged")
def merge_events(spark, d):
    return E.merge_events(_night_events(spark, d)).select("session_id", "type", "us", off_ties("magnitude"))


@query(f"""WITH RECURSIVE {NIGHT}, allof AS (SELECT session_id, type, us, round(magnitude, 9) AS magnitude FROM events_ UNION ALL SELECT session_id, type, us, round(magnitude, 9) FROM moves), {MERGED},
p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY type NOT IN ('sleep_onset', 'final_awakening'), magnitude DESC, us,
  list_position(['sleep_onset', 'final_awakening', 'awakening', 'light_transition', 'deep_transition', 'rem_transition', 'movement_burst', 'restless_period'], type)) AS place FROM merged)
SELECT session_id, type, us, round(magnitude + 1.7e-9, 6) AS magnitude FROM p WHERE place <= 12""")
def topk_pinned(spark, d):
    both = E.merge_events(_night_events(spark, d).withColumn("magnitude", F.round("magnitude", 9)))
    return E.cap_events(both).select("session_id", "type", "us", off_ties("magnitude"))


@query(f"""WITH {SAMPLED}, {STAGE_AT}, {BOUNDS}, {EVENTS} SELECT session_id, type, us, round(magnitude, 6) AS magnitude, round((us - start_us) * 180 / CAST(end_us - start_us AS DOUBLE), 6) AS replay_s,
  strftime(timezone('Europe/Berlin', make_timestamptz(us)), '%H:%M') || ' ' || type AS label FROM events_ JOIN sessions USING (session_id) WHERE us BETWEEN start_us AND end_us""")
def label_events(spark, d):
    out = E.label_events(_stage_events(spark, d), C.sessions(spark, d), "Europe/Berlin", C.TARGET_S)
    return out.withColumn("magnitude", F.round("magnitude", 6)).withColumn("replay_s", F.round("replay_s", 6))


@query()
def change_points(spark, d):
    smooth = W.sample_smooth(_resampled(spark, d).select("session_id", "metric", "k", "us", "value"))
    return E.change_points(smooth).withColumn("delta", F.round("delta", 6))


@query()
def room_events(spark, d):
    smooth = W.sample_smooth(_resampled(spark, d).select("session_id", "metric", "k", "us", "value"))
    return E.merge_events(E.room_events(E.change_points(smooth))).withColumn("magnitude", F.round("magnitude", 6))


@query()
def cap_transients(spark, d):
    from tidewatch.operators import trajectories as T

    m, spans = written(_movement(spark, d), "movement"), T.window_spans(W.windows(C.sessions(spark, d), C.TARGET_S), C.sessions(spark, d), C.TARGET_S)
    drawn = [T.schedule_transients(m, spans, {"steps": T.Route("texture_density", 0.8)}, seed=k).withColumn("kind", F.lit(f"kind {k}")) for k in (1, 2, 3)]
    return E.cap_transients(drawn[0].unionByName(drawn[1]).unionByName(drawn[2]))


@query()
def detect_events(spark, d):
    """All kinds of events of all nights."""
    n = Night(spark, d)
    smooth = W.sample_smooth(_resampled(spark, d, n.base).select("session_id", "metric", "k", "us", "value"))
    stage_runs = written(E.stage_runs(_stages(spark, d, n)), "stage-runs")
    return E.detect(stage_runs, I.sleep_bounds(n.segments), n.movement, n.windows, smooth, n.sessions, "Europe/Berlin", C.TARGET_S)
