"""Queries: selection, merged sessions, compositions, times and texts, reasons of skipping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions import scalars as X
from tidewatch.operators import align as A
from tidewatch.operators import asof as J
from tidewatch.operators import events as E
from tidewatch.operators import features as W
from tidewatch.operators import intervals as I
from tidewatch.operators import trajectories as T
from tidewatch.plans import canonical as C
from tidewatch.plans.q_align import Night, _resampled, _series, _timeline
from tidewatch.plans.q_features import SAMPLED, STAGE_AT, STAGED, _night_events, _stages, _states
from tidewatch.plans.q_intervals import ISLANDS, ROUTES, _contributions, _restless, _spans
from tidewatch.plans.register import Registry, off_ties, rounded
from tidewatch.session import written
from tidewatch.sources import fitbit

query = Registry()
KEY = "strftime(make_timestamp(start_us), '%Y-%m-%dT%H:%M:%SZ') || '/' || strftime(make_timestamp(end_us), '%Y-%m-%dT%H:%M:%SZ')"


@query(f"""WITH {C.CANDIDATES}, k AS (SELECT subject, content, {KEY} AS choice FROM candidates), asked AS (SELECT subject, choice FROM k WHERE CAST(content AS BIGINT) % 5 = 0 UNION SELECT subject, 'none' FROM k)
SELECT a.subject, a.choice, min(k.content) AS content FROM asked a LEFT JOIN k ON k.subject = a.subject AND k.choice = a.choice GROUP BY ALL""")
def choose_session(spark, d):
    c = C.candidates(spark, d)
    asked = c.filter(F.col("content").cast("bigint") % 5 == 0).select("subject", X.session_key(F.col("start_us"), F.col("end_us")).alias("choice"))
    return I.choose(c, asked.union(c.select("subject", F.lit("none"))).distinct())


@query("""WITH r AS (SELECT o_orderkey AS subject, o_orderkey % 8 AS k, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
t AS (SELECT subject, CASE k WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'soon' ELSE day || ' 22:30' END AS "start",
  CASE k WHEN 3 THEN day WHEN 4 THEN day || 'T22:30' WHEN 5 THEN day || 'T23:00:30Z' WHEN 6 THEN day || ' 22:30:00.5-06:00' ELSE day || 'T23:45:00.25+00:30' END AS "end", k, day FROM r),
u AS (SELECT *, CASE WHEN k > 2 THEN epoch_us(timezone('Europe/Berlin', CAST(day || ' 22:30:00' AS TIMESTAMP))) END AS start_us, CASE k WHEN 3 THEN NULL WHEN 4 THEN epoch_us(timezone('Europe/Berlin', CAST(day || ' 22:30:00' AS TIMESTAMP)))
  WHEN 5 THEN epoch_us(CAST(day || ' 23:00:30' AS TIMESTAMP)) WHEN 6 THEN epoch_us(CAST(day || ' 22:30:00.5' AS TIMESTAMP)) + 21600000000 ELSE epoch_us(CAST(day || ' 23:45:00.25' AS TIMESTAMP)) - 1800000000 END AS end_us FROM t)
SELECT subject, coalesce(start_us, -1) AS start_us, coalesce(end_us, -1) AS end_us, CASE WHEN k < 2 THEN 'start is missing' WHEN k = 2 THEN 'start could not be read' WHEN k = 3 THEN 'end could not be read' WHEN end_us <= start_us THEN 'end is not after the start' END AS problem FROM u""")
def manual_ranges(spark, d):
    o = C.table(spark, d, "orders")
    k, day = F.col("o_orderkey") % 8, F.date_format("o_orderdate", "yyyy-MM-dd")
    start = F.when(k == 0, F.lit(None)).when(k == 1, " ").when(k == 2, "soon").otherwise(F.concat(day, F.lit(" 22:30")))
    end = F.when(k == 3, day).when(k == 4, F.concat(day, F.lit("T22:30"))).when(k == 5, F.concat(day, F.lit("T23:00:30Z"))).when(k == 6, F.concat(day, F.lit(" 22:30:00.5-06:00"))).otherwise(F.concat(day, F.lit("T23:45:00.25+00:30")))
    rows = o.select(F.col("o_orderkey").alias("subject"), start.alias("start"), end.alias("end"))
    known = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return I.manual_sessions(rows, "Europe/Berlin").select("subject", known("start_us"), known("end_us"), "problem")


@query(f"""WITH {C.CANDIDATES}, cur AS (SELECT subject, CASE subject % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'user' ELSE 'auto' END AS kind, arg_min(content, content) AS content, arg_min(start_us, content) AS s, arg_min(end_us, content) AS e
  FROM candidates WHERE subject % 4 < 3 GROUP BY subject),
now AS (SELECT * FROM candidates WHERE subject % 7 <> 0 AND (NOT is_main OR subject % 3 = 0)),
f AS (SELECT c.subject, c.content, arg_min(n.content, ((n.start_us, n.end_us) <> (c.s, c.e), n.end_us - n.start_us, n.content)) AS container FROM cur c LEFT JOIN now n ON n.subject = c.subject AND n.start_us <= c.s AND n.end_us >= c.e WHERE kind = 'user' GROUP BY ALL),
m AS (SELECT *, strftime(timezone('America/New_York', make_timestamptz(end_us)), '%Y-%m-%d') AS day FROM now),
au AS (SELECT subject, content FROM m QUALIFY row_number() OVER (PARTITION BY subject ORDER BY is_main DESC, CASE WHEN is_main THEN start_us END DESC, CASE WHEN is_main THEN end_us END DESC,
  CASE WHEN NOT is_main THEN day END DESC, CASE WHEN NOT is_main THEN end_us - start_us END DESC, start_us DESC, content DESC) = 1),
s AS (SELECT subject FROM cur UNION SELECT subject FROM now)
SELECT s.subject, CASE WHEN cur.kind = 'manual' THEN 'manual' WHEN au.content IS NULL THEN 'none' WHEN cur.kind = 'user' THEN 'user' ELSE 'auto' END AS kind,
  CASE WHEN cur.kind = 'manual' THEN cur.content WHEN au.content IS NULL THEN NULL WHEN cur.kind = 'user' THEN coalesce(f.container, cur.content) ELSE au.content END AS content
FROM s LEFT JOIN cur USING (subject) LEFT JOIN f USING (subject) LEFT JOIN au USING (subject)""")
def resolve_selection(spark, d):
    c = C.candidates(spark, d)
    kind = F.when(F.col("subject") % 4 == 0, "manual").when(F.col("subject") % 4 == 1, "user").otherwise("auto")
    first = c.filter("subject % 4 < 3").groupBy("subject").agg(F.min_by(F.struct("content", "start_us", "end_us"), "content").alias("f"))
    current = first.select("subject", kind.alias("kind"), "f.*")
    return I.resolve_selection(current, c.filter("subject % 7 <> 0 and (not is_main or subject % 3 = 0)"), "America/New_York")


@query(f"""WITH {C.CANDIDATES} SELECT subject, content FROM candidates WHERE strftime(timezone('Asia/Tokyo', make_timestamptz(end_us)), '%Y-%m-%d') = '1997-03-02'""")
def sessions_on_date(spark, d):
    return I.on_date(C.candidates(spark, d), "1997-03-02", "Asia/Tokyo").select("subject", "content")


@query(f"""WITH {C.CANDIDATES}, {ISLANDS}, seg AS (SELECT subject, content, start_us + i * ((end_us - start_us) // 3) AS start_us, CASE WHEN i = 2 THEN end_us ELSE start_us + (i + 1) * ((end_us - start_us) // 3) END AS end_us, ['light', 'deep', 'rem'][i + 1] AS stage FROM candidates, range(0, 3) r(i)),
pieces AS (SELECT subject, island, lo, lead(lo) OVER (PARTITION BY subject, island ORDER BY lo) AS hi FROM (SELECT subject, island, start_us AS lo FROM islands UNION SELECT subject, island, end_us FROM islands) QUALIFY hi IS NOT NULL),
won AS (SELECT p.subject, p.island, lo, hi, content FROM pieces p JOIN islands c ON c.subject = p.subject AND c.island = p.island AND start_us <= lo AND end_us >= hi
  QUALIFY row_number() OVER (PARTITION BY p.subject, p.island, lo ORDER BY is_main DESC, end_us - start_us DESC, start_us, content) = 1),
g0 AS (SELECT *, CASE WHEN lag(hi) OVER o = lo AND lag(content) OVER o = content THEN 0 ELSE 1 END AS fresh FROM won WINDOW o AS (PARTITION BY subject, island ORDER BY lo)),
g1 AS (SELECT *, sum(fresh) OVER (PARTITION BY subject, island ORDER BY lo) AS run FROM g0), own AS (SELECT subject, content, min(lo) AS s, max(hi) AS e FROM g1 GROUP BY subject, island, run, content)
SELECT o.subject, o.content, greatest(start_us, s) AS start_us, least(end_us, e) AS end_us, stage FROM own o JOIN seg g ON g.subject = o.subject AND g.content = o.content WHERE least(end_us, e) > greatest(start_us, s)""")
def merged_segments(spark, d):
    c = written(I.merge_islands(C.candidates(spark, d), ["subject"]), "islands")  # read by each part of what follows
    third = F.floor((F.col("end_us") - F.col("start_us")) / 3)
    seg = c.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        "subject", "island", "content", (F.col("start_us") + F.col("i") * third).alias("start_us"), F.when(F.col("i") == 2, F.col("end_us")).otherwise(F.col("start_us") + (F.col("i") + 1) * third).alias("end_us"),
        F.element_at(F.array(F.lit("light"), F.lit("deep"), F.lit("rem")), F.col("i") + 1).alias("stage"), F.lit(False).alias("is_brief"),
    )
    owners = I.ownership(c, ["subject", "island"])
    return I.merged_segments(owners, seg, ["subject", "island"]).select("subject", "content", "start_us", "end_us", "stage")


@query(f"""WITH {C.CANDIDATES}, {ISLANDS}, h AS (SELECT *, CASE WHEN CAST(content AS BIGINT) % 4 = 0 THEN CAST(content AS BIGINT) / 2.0 END AS hrv FROM islands)
SELECT subject, min(start_us) AS start_us, arg_min(hrv, (NOT is_main, start_us - end_us, start_us, content)) FILTER (hrv IS NOT NULL) AS hrv FROM h GROUP BY subject, island""")
def merged_scalars(spark, d):
    hrv = F.when(F.col("content").cast("bigint") % 4 == 0, F.col("content").cast("bigint") / 2.0)
    rows = I.merge_islands(C.candidates(spark, d).withColumn("hrv", hrv), ["subject"])
    starts = rows.groupBy("subject", "island").agg(F.min("start_us").alias("start_us"))
    return starts.join(I.first_of_rank(rows, ["subject", "island"], "hrv"), ["subject", "island"]).drop("island")


@query(f"""WITH {C.POINTS}, {C.CONVERTED} SELECT DISTINCT subject, us, source, metric, round(value, 6) AS value FROM converted WHERE value IS NOT NULL""")
def merged_points(spark, d):
    p = A.to_canonical(C.points(spark, d)).filter("value is not null").withColumn("value", F.round("value", 6)).withColumnRenamed("session_id", "content")
    members = p.select("content", "subject").distinct()
    return I.merged_points(p.drop("subject"), members, ["subject"]).select("subject", "us", "source", "metric", "value")


@query(f"""WITH {C.ALIGNED}, {C.WINDOWS}, {C.STATS}, {C.SMOOTH} SELECT m.session_id, m.metric, m.w, n, present, round(mean + 1.7e-9, 6) AS mean, round(lo + 1.7e-9, 6) AS min, round(hi + 1.7e-9, 6) AS max,
  round(coalesce(1 - present / CAST(n AS DOUBLE), 1.0), 6) AS missing, round(smoothed + 1.7e-9, 6) AS smoothed FROM smooth m LEFT JOIN stats s ON s.session_id = m.session_id AND s.metric = m.metric AND s.w = m.w WHERE m.metric <> 'steps'""")
def metric_window_features(spark, d):
    out = W.metric_window_features(_timeline(spark, d), C.sessions(spark, d), C.TARGET_S)
    return out.select("session_id", "metric", "w", "n", "present", *[off_ties(c) for c in ("mean", "min", "max")], rounded("missing"), off_ties("smoothed"))


@query(f"""WITH {C.ALIGNED}, {C.RAW_STAGES}, {C.SEGMENTS}, {C.WINDOWS}, {C.STATS}, {C.OVERLAP}, {C.FRACTIONS}, {C.STATES}, {C.MOVEMENT}
SELECT d.session_id, d.w, d.stage, state, round(intensity + 1.7e-9, 6) AS intensity FROM dominant d JOIN states s ON s.session_id = d.session_id AND s.w = d.w JOIN movement m ON m.session_id = d.session_id AND m.w = d.w""")
def extract_windows(spark, d):
    _, by_window = W.extract(_timeline(spark, d), C.segments(spark, d), C.sessions(spark, d), C.TARGET_S)
    return by_window.select("session_id", "w", "stage", "state", off_ties("intensity"))


@query(f"""WITH {SAMPLED}, {STAGE_AT}, {C.RESAMPLED}, t AS (SELECT session_id, metric, value FROM resampled),
a AS (SELECT x.session_id, x.metric, coalesce(1 - count(value) / CAST(nullif(count(t.metric), 0) AS DOUBLE), 1) AS missing
  FROM (SELECT session_id, unnest(['heart_rate', 'hrv_rmssd', 'steps', 'temperature', 'humidity', 'pressure']) AS metric FROM sessions) x LEFT JOIN t ON t.session_id = x.session_id AND t.metric = x.metric GROUP BY ALL),
k AS (SELECT session_id, count(*) FILTER (stage = 'unknown') / CAST(count(*) AS DOUBLE) AS unknown FROM stages GROUP BY 1)
SELECT a.session_id, metric, round(CASE WHEN metric = 'steps' AND missing = 1 AND unknown < 1 THEN unknown ELSE missing END, 6) AS missing,
  missing < 1 OR (metric = 'hrv_rmssd' AND a.session_id LIKE '%/0') OR (metric = 'steps' AND unknown < 1) AS available FROM a JOIN k USING (session_id)""")
def availability_fallbacks(spark, d):
    """As if no night had steps, and subject 0 had daily HRV."""
    s = C.sessions(spark, d)
    timeline = _resampled(spark, d).select("session_id", "metric", "k", "us", "value")
    daily = s.filter("session_id like '%/0'").select("session_id", F.lit(40.0).alias("rmssd"))
    return W.availability(timeline, s, _stages(spark, d), daily).withColumn("missing", F.round("missing", 6))


@query(f"""WITH {C.SESSIONS}, r AS (SELECT session_id, (end_us - start_us) / 180e6 AS ratio, end_us - start_us AS us FROM sessions) SELECT session_id, printf('%.3f', ratio) AS ratio, us <= 180000000 AS too_short,
  concat_ws(' ', CASE WHEN us // 3600000000 > 0 THEN (us // 3600000000) || ' h' END, CASE WHEN us % 3600000000 // 60000000 > 0 THEN (us % 3600000000 // 60000000) || ' min' END, '1 s') AS spoken,
  concat_ws(' ', CASE WHEN us // 3600000000 > 0 THEN (us // 3600000000) || ' h' END, CASE WHEN us % 3600000000 // 60000000 > 0 THEN (us % 3600000000 // 60000000) || ' min' END, '1.2346 s') AS elapsed FROM r""")
def compression_texts(spark, d):
    start, end = F.col("start_us"), F.col("end_us")
    return C.sessions(spark, d).select(
        "session_id", X.ratio_text(X.compression_ratio(start, end, C.TARGET_S)).alias("ratio"), X.too_short(start, end, C.TARGET_S).alias("too_short"), X.spoken_duration(end - start).alias("spoken"), X.elapsed_text(end - start).alias("elapsed"),
    )


@query(f"""WITH {STAGED}, {C.STATES}, r0 AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY session_id ORDER BY w) THEN 0 ELSE 1 END AS fresh FROM states), r1 AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY w) AS run FROM r0),
seg AS (SELECT session_id, state, min(w) * 0.5 AS t0, (max(w) + 1) * 0.5 AS t1 FROM r1 GROUP BY session_id, run, state), q AS (SELECT session_id, start_us, end_us, i * 2.5e0 AS t FROM sessions, range(0, 73) r(i))
SELECT q.session_id, round(t, 1) AS t, state, start_us + CAST(round(t * ((end_us - start_us) / 180e6) * 1e6) AS BIGINT) AS night_us, round(t / 180 * 100, 6) AS percent
FROM q LEFT JOIN seg g ON g.session_id = q.session_id AND t >= t0 AND (t < t1 OR t = 180 AND t1 = 180)""")
def segment_lookup(spark, d):
    seg = E.runs(_states(spark, d), "state", ["session_id"], "w").select("session_id", "state", (F.col("first") * S.WINDOW_S).alias("t0"), ((F.col("last") + 1) * S.WINDOW_S).alias("t1"))
    s = C.sessions(spark, d)
    probes = s.select("session_id", F.explode(F.sequence(F.lit(0), F.lit(72))).alias("i")).select("session_id", (F.col("i") * 2.5).alias("t"))
    at = J.segment_at(seg, probes, C.TARGET_S).join(s, "session_id")
    night = X.night_time(F.col("t"), F.col("start_us"), X.compression_ratio(F.col("start_us"), F.col("end_us"), C.TARGET_S))
    return at.select("session_id", rounded("t", digits=1), "state", night.alias("night_us"), rounded(X.marker_percent(F.col("t"), C.TARGET_S), "percent"))


@query("""WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%m/%d/%y %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, ' %m/%d/%y %H:%M:%S ') ELSE strftime(ts, '%m/%d/%y %H:%M:%S') END AS t,
  CASE event_id % 3 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN 'nan' ELSE CAST(value * 3 AS VARCHAR) END AS x, event_id % 5 <> 0 AS present, event_id % 10 AS f, value FROM events),
j AS (SELECT f, CASE WHEN NOT present OR event_id % 4 = 1 THEN 'row' WHEN event_id % 3 = 1 OR NOT (CASE WHEN event_id % 3 = 0 THEN value ELSE value * 3 END) BETWEEN 20 AND 250 THEN 'value' END AS skipped FROM r)
SELECT 'file ' || f AS source_file, skipped, count(*) AS n FROM j WHERE skipped IS NOT NULL GROUP BY ALL""")
def skip_reasons(spark, d):
    """A time that can't be read counts before a value that can't."""
    e, k = C.table(spark, d, "events"), F.col("event_id")
    text = F.date_format("ts", "MM/dd/yy HH:mm:ss")
    t = F.when(k % 4 == 1, F.date_format("ts", "yyyy-MM-dd")).when(k % 4 == 2, F.concat(F.lit(" "), text, F.lit(" "))).otherwise(text)
    wall = X.short_timestamp(F.trim(t))
    at = F.when(wall.isNotNull(), F.struct(wall.alias("wall"), F.lit(None).cast("bigint").alias("offset_us")))
    x = F.when(k % 3 == 0, F.col("value").cast("string")).when(k % 3 == 1, "nan").otherwise((F.col("value") * 3).cast("string"))
    rows = e.select(F.concat(F.lit("file "), (k % 10).cast("string")).alias("name"), (k % 5 != 0).alias("present"), at.alias("at"), x.alias("x"))
    return fitbit.skipped_of(fitbit.judged(rows, "heart_rate", "bpm", "UTC"))


@query("""WITH r AS (SELECT event_id, date_trunc('second', ts) AS t FROM events) SELECT event_id, CASE event_id % 5 WHEN 0 THEN epoch_us(t) WHEN 1 THEN epoch_us(t) - 19800000000 WHEN 2 THEN epoch_us(t) + 16200000000
  WHEN 3 THEN epoch_us(timezone('America/New_York', t)) ELSE epoch_us(timezone('America/New_York', date_trunc('minute', t))) END AS us FROM r""")
def parse_offsets(spark, d):
    """An offset that is written wins over the zone."""
    e, k = C.table(spark, d, "events"), F.col("event_id") % 5
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, F.concat(iso, F.lit("+05:30"))).when(k == 2, F.concat(iso, F.lit(" -04:30"))).when(k == 3, iso).otherwise(F.date_format("ts", "M/d/yyyy   h:mma"))
    return e.select("event_id", F.unix_micros(X.instant(X.sensor_parts(text), "America/New_York")).alias("us"))


@query("""WITH w AS (SELECT o_orderkey % 20 AS f, CAST(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP) + to_minutes(CAST(o_orderkey % 1440 AS INT)) AS t FROM orders),
j AS (SELECT f, timezone('Europe/Berlin', timezone('Europe/Berlin', t)) <> t AS gap, epoch_us(timezone('Europe/Berlin', t)) AS u, t FROM w),
k AS (SELECT f, CASE WHEN gap THEN 'nonexistent' WHEN timezone('Europe/Berlin', make_timestamptz(u + 3600000000)) = t OR timezone('Europe/Berlin', make_timestamptz(u - 3600000000)) = t THEN 'ambiguous' END AS adjustment FROM j)
SELECT 'file ' || f AS source_file, adjustment, count(*) AS n FROM k WHERE adjustment IS NOT NULL GROUP BY ALL""")
def dst_counts(spark, d):
    o = C.table(spark, d, "orders")
    t = F.timestamp_micros(F.unix_micros(F.to_date("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 1440 * S.MINUTE).cast("timestamp_ntz")
    at = F.struct(t.alias("wall"), F.lit(None).cast("bigint").alias("offset_us"))
    rows = o.select(F.concat(F.lit("file "), (F.col("o_orderkey") % 20).cast("string")).alias("name"), X.dst_adjustment(at, "Europe/Berlin").alias("dst"))
    return fitbit.adjusted_of(rows)


@query(f"""WITH {C.CANDIDATES}, i AS (SELECT c_custkey AS import_id, c_custkey * 7 % 1000 AS seq FROM customer WHERE c_nationkey < 20)
SELECT import_id, seq, content, row_number() OVER (PARTITION BY import_id ORDER BY content) AS place FROM candidates c JOIN i ON i.import_id = c.subject""")
def sessions_with_imports(spark, d):
    imports = C.table(spark, d, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("import_id"), (F.col("c_custkey") * 7 % 1000).alias("seq"))
    own = C.candidates(spark, d).withColumnRenamed("subject", "import_id").withColumn("position", F.col("content"))
    return I.with_imports(own, imports).select("import_id", "seq", "content", "place")


@query(f"""WITH {C.POINTS} SELECT metric, session_id, min(us) AS us, arg_min(event_id, (us, event_id)) AS event_id FROM points GROUP BY ALL""")
def first_of_each(spark, d):
    return A.first_distinct(C.points(spark, d).select("metric", "session_id", "us", "event_id"), ["metric", "session_id"], ["us", "event_id"])


@query()
def render_plan(spark, d):
    n = Night(spark, d)
    events = E.label_events(E.cap_events(written(E.merge_events(_night_events(spark, d, n)), "events")), n.sessions, "UTC", C.TARGET_S)
    transients = E.cap_transients(T.schedule_transients(n.movement, _spans(n), ROUTES, W.brief_starts(n.segments, n.sessions, C.TARGET_S)))
    return T.render_plan(_contributions(n), _spans(n), n.states, _restless(n), n.smooth, written(events, "labelled"), written(transients, "transients"), ROUTES, C.TARGET_S)


@query(f"WITH {C.NORMAL} SELECT subject, metric, count(*) AS n FROM series JOIN sessions USING (session_id) GROUP BY ALL")
def points_by_subject(spark, d):
    """Provenance: points of a session carry its subject through a join on the session alone."""
    return _series(spark, d).join(C.sessions(spark, d).select("session_id", "subject"), "session_id").groupBy("subject", "metric").agg(F.count(F.lit(1)).alias("n"))
