"""Normalising points and aligning them on a regular grid, for all sessions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions import scalars as X
from tidewatch.operators.asof import lerp
from tidewatch.session import written


def _clamped_mean(c: str) -> Column:
    return F.least(F.greatest(F.avg(c), F.min(c)), F.max(c))


def attach(points: DataFrame, sessions: DataFrame) -> DataFrame:
    """Points within their session, both ends included."""
    return points.join(sessions, "session_id").filter((F.col("us") >= F.col("start_us")) & (F.col("us") <= F.col("end_us")))


def to_canonical(points: DataFrame) -> DataFrame:
    return points.withColumn("value", X.to_canonical(F.col("metric"), F.col("unit"), F.col("value"))).withColumn("unit", X.lookup(F.col("metric"), S.CANONICAL_UNIT))


def inconvertible(points: DataFrame) -> DataFrame:
    """Points left out because their unit can't be converted, counted by source, metric and unit."""
    bad = points.filter(X.to_canonical(F.col("metric"), F.col("unit"), F.lit(1.0)).isNull())
    return bad.groupBy("source", "metric", "unit").agg(F.count(F.lit(1)).alias("n"))


def dedup_mean(points: DataFrame, keys: tuple[str, ...] = ("session_id", "source", "metric", "us")) -> DataFrame:
    """One point for each key: the mean, within the values' bounds, and how many were merged into it."""
    return points.groupBy(*keys).agg(_clamped_mean("value").alias("value"), (F.count(F.lit(1)) - 1).alias("removed"))


def select_sensor(series: DataFrame) -> DataFrame:
    """(session_id, metric, source, n, ignored): the room sensor with the most points, ties by name, and the others sorted."""
    n = series.filter(F.col("metric").isin(*S.ROOM_METRICS)).groupBy("session_id", "metric", "source").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("session_id", "metric").agg(
        F.min_by(F.struct("source", "n"), F.struct(-F.col("n"), F.col("source"))).alias("b"), F.array_sort(F.collect_set("source")).alias("all")
    )
    return best.select("session_id", "metric", F.col("b.source").alias("source"), F.col("b.n").alias("n"), F.array_remove("all", F.col("b.source")).alias("ignored"))


def combine_sources(series: DataFrame) -> DataFrame:
    """One value for each (session, metric, time): the chosen sensor's for room metrics, else the mean of the sources' means."""
    chosen = select_sensor(series).select("session_id", "metric", F.col("source").alias("_chosen"))
    own = series.join(chosen, ["session_id", "metric"], "left").filter(F.col("_chosen").isNull() | (F.col("source") == F.col("_chosen")))
    return own.groupBy("session_id", "metric", "us").agg(_clamped_mean("value").alias("value"))


def normalize(points: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, metric, us, value): converted, within the session, merged, one value for each time."""
    good = to_canonical(points).filter("value is not null")
    return combine_sources(dedup_mean(attach(good, sessions)))


def median_interval(series: DataFrame) -> DataFrame:
    """The median step between points in microseconds; null below two points."""
    step = F.col("us") - F.lag("us").over(Window.partitionBy("session_id", "metric").orderBy("us"))
    return series.withColumn("step", step).groupBy("session_id", "metric").agg(F.percentile("step", F.lit(0.5)).alias("median_us"))


def choose_resolution(series: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, resolution_s) for every session: the least of the choices that the densest continuous metric's median step doesn't exceed;
    the fallback without two points of one, or if they are further apart."""
    least = median_interval(series.filter(F.col("metric").isin(*S.CONTINUOUS))).groupBy("session_id").agg(F.min("median_us").alias("m"))
    pick = F.lit(S.FALLBACK_RESOLUTION_S)
    for r in reversed(S.RESOLUTIONS_S):
        pick = F.when(F.col("m") <= r * S.US, r).otherwise(pick)
    return sessions.select("session_id").join(least, "session_id", "left").select("session_id", pick.alias("resolution_s"))


def with_steps(sessions: DataFrame, series: DataFrame) -> DataFrame:
    """Sessions with ``res_us``, the step of their grid, chosen by the density of their own series."""
    step = (F.col("resolution_s") * F.lit(S.US)).cast("bigint").alias("res_us")
    return sessions.join(choose_resolution(series, sessions).select("session_id", step), "session_id")


def _stepped(sessions: DataFrame, res_us: int | None) -> DataFrame:
    """Sessions with the step given, or with their own, and the number of their samples."""
    own = sessions if res_us is None else sessions.withColumn("res_us", F.lit(res_us).cast("bigint"))
    n = F.ceil((F.col("end_us") - F.col("start_us")) / F.col("res_us")).cast("bigint")
    return own.select("session_id", "start_us", "end_us", "res_us", n.alias("_n"))


def _samples(first: Column, last: Column) -> Column:
    return F.explode(F.when(last >= first, F.sequence(first, last)))


def sample_grid(sessions: DataFrame, res_us: int | None = None) -> DataFrame:
    """(session_id, k, us): every step from the start on that comes before the end. Here and below the step is ``res_us``, or without it the
    column of that name in ``sessions``."""
    ks = _stepped(sessions, res_us).select("session_id", "start_us", "res_us", _samples(F.lit(0).cast("bigint"), F.col("_n") - 1).alias("k"))
    return ks.select("session_id", "k", (F.col("start_us") + F.col("k") * F.col("res_us")).alias("us"))


def bucket_means(series: DataFrame, sessions: DataFrame, res_us: int | None = None) -> DataFrame:
    """(session_id, metric, k, value): the mean of the points of each grid step; a point at the end is in none."""
    inside = series.join(_stepped(sessions, res_us), "session_id").filter((F.col("us") >= F.col("start_us")) & (F.col("us") < F.col("end_us")))
    k = F.floor((F.col("us") - F.col("start_us")) / F.col("res_us")).cast("bigint")
    return inside.withColumn("k", k).groupBy("session_id", "metric", "k").agg(_clamped_mean("value").alias("value"))


def resample(series: DataFrame, sessions: DataFrame, res_us: int | None = None) -> DataFrame:
    """(session_id, metric, k, us, value, prev_us, next_us) of continuous metrics that have a point: bucket means, and where a
    bucket is empty the line between its neighbours if they are close enough; never beyond the first or last point.

    Points are gathered by bucket before they are ordered, so a series is never longer than its grid; each bucket then makes the
    samples since the one before, and nothing is joined with the grid.
    """
    own = series.filter(F.col("metric").isin(*S.CONTINUOUS)).join(_stepped(sessions, res_us), "session_id").filter("us >= start_us and us <= end_us")
    # a point at the very end stands behind all samples
    k = F.when(F.col("us") < F.col("end_us"), F.floor((F.col("us") - F.col("start_us")) / F.col("res_us")).cast("bigint")).otherwise(F.col("_n"))
    point = F.struct("us", "value")
    buckets = own.groupBy("session_id", "metric", "start_us", "res_us", "_n", k.alias("_b")).agg(_clamped_mean("value").alias("_mean"), F.min(point).alias("_first"), F.max(point).alias("_last"))
    order = Window.partitionBy("session_id", "metric").orderBy("_b")
    near = buckets.select("*", F.lag("_b").over(order).alias("_before"), F.lag("_last").over(order).alias("_prev"), F.lead("_b").over(order).isNull().alias("_end"))
    until = F.when(F.col("_end"), F.col("_n") - 1).otherwise(F.least(F.col("_b"), F.col("_n") - 1))
    made = near.withColumn("k", _samples(F.coalesce(F.col("_before") + 1, F.lit(0).cast("bigint")), until)).withColumn("us", F.col("start_us") + F.col("k") * F.col("res_us"))
    upto = F.col("k") <= F.col("_b")
    gap = F.col("_first.us") - F.col("_prev.us")
    line = F.when(gap <= X.lookup(F.col("metric"), S.MAX_GAP_US), lerp(F.col("us"), F.col("_prev.us"), F.col("_prev.value"), F.col("_first.us"), F.col("_first.value")))
    value = F.when(F.col("k") == F.col("_b"), F.col("_mean")).when(upto, line)
    return made.select(
        "session_id", "metric", "k", "us", value.alias("value"), F.when(upto, F.col("_prev.us")).otherwise(F.col("_last.us")).alias("prev_us"), F.when(upto, F.col("_first.us")).alias("next_us")
    )


def _latest(marks: DataFrame, sessions: DataFrame, res_us: int | None, carry: tuple[str, ...]) -> DataFrame:
    """(session_id, k, us, res_us, prev_us, prev_*): each sample of every session with the last of the marks (session_id, us, ...) at or before it.

    Of the marks between two samples only the last is kept; each makes the samples up to the next one.
    """
    at = _stepped(sessions, res_us)
    first = F.least(F.col("_n"), F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("us") - F.col("start_us")) / F.col("res_us")).cast("bigint")))
    held = marks.select("session_id", "us", F.struct("us", *carry).alias("_m"))
    own = held.join(at, "session_id").select("session_id", first.alias("_b"), "_m").groupBy("session_id", "_b").agg(F.max("_m").alias("_m"))
    order = Window.partitionBy("session_id").orderBy("_b")
    near = at.join(own, "session_id", "left").withColumn("_b", F.coalesce("_b", "_n"))
    near = near.select("*", F.lag("_b").over(order).isNull().alias("_start"), F.coalesce(F.lead("_b").over(order), F.col("_n")).alias("_until"))
    made = near.withColumn("k", _samples(F.when(F.col("_start"), F.lit(0).cast("bigint")).otherwise(F.col("_b")), F.col("_until") - 1))
    mark = lambda c: F.when(F.col("k") >= F.col("_b"), F.col(f"_m.{c}")).alias(f"prev_{c}")
    return made.select("session_id", "k", (F.col("start_us") + F.col("k") * F.col("res_us")).alias("us"), "res_us", mark("us"), *[mark(c) for c in carry])


def gaps(resampled: DataFrame) -> DataFrame:
    """(session_id, metric, last_us, elapsed_us): bracketing pairs too wide that left a sample missing."""
    open_ = resampled.filter("value is null and prev_us is not null and next_us is not null")
    return open_.select("session_id", "metric", F.col("prev_us").alias("last_us"), (F.col("next_us") - F.col("prev_us")).alias("elapsed_us")).distinct()


def gap_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("session_id", "metric").agg(F.count(F.lit(1)).alias("n_gaps"), F.sum("elapsed_us").alias("total_us"))


def hold_steps(series: DataFrame, sessions: DataFrame, res_us: int | None = None, hold_us: int = S.STEPS_HOLD_US) -> DataFrame:
    """(session_id, k, us, value) of steps: the latest point since the start, held for its span."""
    own = series.filter("metric = 'steps'").join(sessions.select("session_id", "start_us"), "session_id").filter("us >= start_us").select("session_id", "us", "value")
    held = _latest(own, sessions, res_us, ("value",))
    return held.select("session_id", "k", "us", F.when(F.col("us") - F.col("prev_us") < hold_us, F.col("prev_value")).alias("value"))


def assign_stages(segments: DataFrame, sessions: DataFrame, res_us: int | None = None) -> DataFrame:
    """(session_id, k, us, stage, res_us): the stage whose segment holds the sample, else unknown."""
    found = _latest(segments.select("session_id", F.col("start_us").alias("us"), "end_us", "stage"), sessions, res_us, ("end_us", "stage"))
    stage = F.when(F.col("us") < F.col("prev_end_us"), F.col("prev_stage")).otherwise("unknown")
    return found.select("session_id", "k", "us", stage.alias("stage"), "res_us")


def timeline(series: DataFrame, sessions: DataFrame, res_us: int | None = None) -> DataFrame:
    """(session_id, metric, k, us, value): continuous metrics and steps together; null is missing. Without ``res_us`` and a column of that name
    each session has the step of its own density. The series and the steps are written, as they are read several times."""
    if res_us is None and "res_us" not in sessions.columns:
        series = written(series, "series")
        sessions = written(with_steps(sessions, series), "steps")
    stepped = sessions
    steps = hold_steps(series, stepped, res_us).withColumn("metric", F.lit("steps"))
    cols = ["session_id", "metric", "k", "us", "value"]
    return resample(series, stepped, res_us).select(*cols).unionByName(steps.select(*cols))


def unavailable(series: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, metric) without a point in the session."""
    metrics = F.explode(F.array(*[F.lit(m) for m in S.METRICS]))
    return sessions.select("session_id", metrics.alias("metric")).join(series.select("session_id", "metric").distinct(), ["session_id", "metric"], "left_anti")


def timezone_suspects(resampled: DataFrame, points: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, coverage, suspect): little heart rate in the session, though its subject has some near it. Points have ``subject``, sessions too."""
    cover = resampled.filter("metric = 'heart_rate'").groupBy("session_id").agg(F.avg(F.when(F.col("value").isNotNull(), 1.0).otherwise(0.0)).alias("coverage"))
    hr = points.filter("metric = 'heart_rate'").select("subject", F.col("us").alias("p_us")).distinct()
    day = 24 * S.HOUR
    slots = sessions.withColumn("slot", F.explode(F.sequence(F.floor((F.col("start_us") - S.NEARBY_US) / day), F.floor((F.col("end_us") + S.NEARBY_US) / day))))
    near = slots.join(hr.withColumn("slot", F.floor(F.col("p_us") / day)), ["subject", "slot"]).filter(
        (F.col("p_us") >= F.col("start_us") - S.NEARBY_US) & (F.col("p_us") <= F.col("end_us") + S.NEARBY_US) & ((F.col("p_us") < F.col("start_us")) | (F.col("p_us") > F.col("end_us")))
    )
    out = sessions.join(cover, "session_id", "left").join(near.select("session_id").distinct().withColumn("near", F.lit(True)), "session_id", "left")
    coverage = F.coalesce("coverage", F.lit(0.0))
    return out.select("session_id", coverage.alias("coverage"), ((coverage < S.COVERAGE) & F.coalesce("near", F.lit(False))).alias("suspect"))


def fingerprint(sessions: DataFrame, points: DataFrame, segments: DataFrame, daily: DataFrame | None = None, version: str = "1", block: int = 4096) -> DataFrame:
    """(session_id, fingerprint): a digest of all that a session's results come from: its bounds, points, segments and daily figure
    (session_id, rmssd), and the version. Any change changes it, copies count, the order of rows doesn't.

    It is a tree: equal records are counted, then dealt out by their digests to blocks of about ``block``, which are digested in
    order; the session's digest is that of its blocks in order. Where a block begins depends on the records alone.
    """
    text = lambda *cs: F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) if isinstance(c, str) else c for c in cs])
    parts = [
        sessions.select("session_id", text(F.lit("session"), "start_us", "end_us").alias("r")),
        points.select("session_id", text(F.lit("point"), "source", "metric", "us", "value", "unit").alias("r")),
        segments.select("session_id", text(F.lit("segment"), "start_us", "end_us", "stage", "is_brief").alias("r")),
    ]
    if daily is not None:
        parts.append(daily.select("session_id", text(F.lit("daily"), "rmssd").alias("r")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    records = every.groupBy("session_id", F.sha2("r", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    blocks = records.groupBy("session_id").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    at = F.pmod(F.conv(F.substring("h", 1, 15), 16, 10).cast("bigint"), F.col("blocks"))
    leaf = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "h", F.col("n").cast("string")))), ","), 256)
    leaves = records.join(blocks, "session_id").groupBy("session_id", at.alias("block")).agg(leaf.alias("leaf"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", "leaf"))), lambda x: x["leaf"])
    return leaves.groupBy("session_id").agg(F.sha2(F.concat_ws("|", F.lit(version), F.array_join(ordered, ",")), 256).alias("fingerprint"))


def widest_gaps(points: DataFrame) -> DataFrame:
    """(metric, n, widest_us): the longest time between neighbouring points of a metric. Days are scanned for themselves, then their ends are
    held against each other."""
    day = 24 * S.HOUR
    within = Window.partitionBy("metric", "_day").orderBy("us")
    own = points.select("metric", "us", F.floor(F.col("us") / day).alias("_day")).withColumn("_gap", F.col("us") - F.lag("us").over(within))
    days = own.groupBy("metric", "_day").agg(F.count(F.lit(1)).alias("n"), F.max("_gap").alias("_gap"), F.min("us").alias("_first"), F.max("us").alias("_last"))
    across = F.col("_first") - F.lag("_last").over(Window.partitionBy("metric").orderBy("_day"))
    return days.withColumn("_across", across).groupBy("metric").agg(F.sum("n").alias("n"), F.max(F.greatest("_gap", "_across")).alias("widest_us"))


def pivot_counts(points: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(session_id, a column for each metric): how many points a session has."""
    return points.groupBy("session_id").agg(*[F.count(F.when(F.col("metric") == m, 1)).alias(m) for m in metrics])


def attach_daily(sessions: DataFrame, series: DataFrame, daily: DataFrame, zone: str) -> DataFrame:
    """(session_id, rmssd): the mean of the daily figures (subject, date, rmssd) of the date on which a session ends, for sessions without HRV of
    their own."""
    daily = daily.groupBy("subject", "date").agg(_clamped_mean("rmssd").alias("rmssd")).filter("rmssd is not null")
    ends = sessions.withColumn("date", F.to_date(F.from_utc_timestamp(F.timestamp_micros("end_us"), zone))).select("session_id", "subject", "date")
    have = series.filter("metric = 'hrv_rmssd'").select("session_id").distinct()
    return ends.join(have, "session_id", "left_anti").join(daily.select("subject", "date", "rmssd"), ["subject", "date"]).select("session_id", "rmssd")


def set_sides(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): keys that are in the left rows, the right ones or both, once each; in one grouping."""
    mark = lambda df, k: df.select(*keys, F.lit(k).alias("_k"))
    sides = mark(left, 1).unionByName(mark(right, 2)).groupBy(*keys).agg(F.bit_or("_k").alias("_k"))
    return sides.select(*keys, F.element_at(F.array(F.lit("left"), F.lit("right"), F.lit("both")), F.col("_k")).alias("side"))


def first_distinct(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows equal in ``keys`` the first by ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order, *rest)).alias("_r")).select(*keys, "_r.*")
