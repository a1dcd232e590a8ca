"""Features of tumbling windows, for all sessions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions import scalars as X
from tidewatch.session import written


def windows(sessions: DataFrame, target_s: int = S.DEFAULT_TARGET_S) -> DataFrame:
    """(session_id, w, w_start, w_end): half a replay second each, edges to the nearest microsecond.

    They join by sorting: Spark takes what is exploded to be as small as the sessions, and would broadcast all windows of all sessions.
    """
    n = int(target_s / S.WINDOW_S)
    w = sessions.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("w"))
    edge = lambda i: X.window_edge(i, F.col("start_us"), F.col("end_us"), target_s)
    return w.select("session_id", "w", edge(F.col("w")).alias("w_start"), edge(F.col("w") + 1).alias("w_end")).hint("merge")


def window_of(us: Column, start_us: Column, end_us: Column, target_s: int) -> Column:
    """The window that holds an instant, by arithmetic on the edges instead of a range join; the last also holds the end."""
    n = int(target_s / S.WINDOW_S)
    guess = F.floor((us - start_us) * F.lit(n) / (end_us - start_us)).cast("int")
    edge = lambda i: X.window_edge(i, start_us, end_us, target_s)
    exact = F.when(us < edge(guess), guess - 1).when(us >= edge(guess + 1), guess + 1).otherwise(guess)
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), exact)).cast("int")


def window_stats(timeline: DataFrame, sessions: DataFrame, target_s: int = S.DEFAULT_TARGET_S) -> DataFrame:
    """(session_id, metric, w, n, present, mean, min, max, slope): windows without samples are absent here.

    ``slope`` is the least-squares change an hour; null below two samples.
    """
    at = timeline.join(sessions, "session_id").withColumn("w", window_of(F.col("us"), F.col("start_us"), F.col("end_us"), target_s))
    hours = F.when(F.col("value").isNotNull(), (F.col("us") - F.col("start_us")) / float(S.HOUR))
    return at.groupBy("session_id", "metric", "w").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("value").alias("present"),
        F.least(F.greatest(F.avg("value"), F.min("value")), F.max("value")).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.when(F.count("value") > 1, F.regr_slope("value", hours)).alias("slope"),
    )


def missing_fraction(stats: DataFrame, sessions: DataFrame, metrics: DataFrame, target_s: int = S.DEFAULT_TARGET_S) -> DataFrame:
    """(session_id, metric, w, missing): 1 for windows without samples."""
    every = windows(sessions, target_s).select("session_id", "w").join(metrics, "session_id")
    share = 1 - F.col("present") / F.col("n")
    return every.join(stats.select("session_id", "metric", "w", "n", "present").hint("merge"), ["session_id", "metric", "w"], "left").select("session_id", "metric", "w", F.coalesce(share, F.lit(1.0)).alias("missing"))


def _by_width(metric: Column, widths: dict[str, int], value: Column, order: Window, half: int) -> Column:
    """The mean within a metric's width around a row, kept within the values' bounds: a frame for each width, all over one sorting."""
    out = F.lit(None).cast("double")
    for width in sorted(set(widths.values())):
        frame = order.rangeBetween(-(width // half), width // half)
        mean = F.least(F.greatest(F.avg(value).over(frame), F.min(value).over(frame)), F.max(value).over(frame))
        out = F.when(metric.isin(*[m for m, w in widths.items() if w == width]), mean).otherwise(out)
    return out


def window_smooth(timeline: DataFrame, sessions: DataFrame, target_s: int = S.DEFAULT_TARGET_S, widths: dict[str, int] = S.SMOOTHING_US) -> DataFrame:
    """(session_id, metric, w, smoothed): the mean of the samples around the window's middle, both ends included.

    Samples with a value and middles stand in one order, of twice their time, so middles are whole numbers; each is read once.
    """
    have = timeline.select("session_id", "metric").distinct()
    none = lambda t: F.lit(None).cast(t)
    middles = windows(sessions, target_s).join(have, "session_id").select("session_id", "metric", (F.col("w_start") + F.col("w_end")).alias("twice"), none("double").alias("value"), "w")
    samples = timeline.filter("value is not null").select("session_id", "metric", (2 * F.col("us")).alias("twice"), "value", none("int").alias("w"))
    order = Window.partitionBy("session_id", "metric").orderBy("twice")
    both = samples.unionByName(middles).withColumn("smoothed", _by_width(F.col("metric"), widths, F.col("value"), order, 1))
    return both.filter("w is not null").select("session_id", "metric", "w", "smoothed")


def window_values(timeline: DataFrame, sessions: DataFrame, target_s: int = S.DEFAULT_TARGET_S, widths: dict[str, int] = S.SMOOTHING_US) -> DataFrame:
    """(session_id, metric, w, smoothed, present): smoothing also reaches windows without a sample of their own; these aren't ``present``. The timeline
    is written, as it is read several times."""
    timeline = written(timeline, "timeline")
    at = timeline.filter("value is not null").join(sessions.select("session_id", "start_us", "end_us"), "session_id")
    own = at.select("session_id", "metric", window_of(F.col("us"), F.col("start_us"), F.col("end_us"), target_s).alias("w")).distinct().withColumn("_own", F.lit(True))
    smooth = window_smooth(timeline, sessions, target_s, widths)
    return smooth.join(own, ["session_id", "metric", "w"], "left").select("session_id", "metric", "w", "smoothed", F.coalesce("_own", F.lit(False)).alias("present"))


def sample_smooth(timeline: DataFrame, widths: dict[str, int] = S.SMOOTHING_US) -> DataFrame:
    """Each sample with ``smoothed``: the mean within half a width to both sides; missing samples stay missing."""
    order = Window.partitionBy("session_id", "metric").orderBy("us")
    there = timeline.filter("value is not null").withColumn("smoothed", _by_width(F.col("metric"), widths, F.col("value"), order, 2))
    return there.unionByName(timeline.filter("value is null").withColumn("smoothed", F.lit(None).cast("double")))


def metric_window_features(timeline: DataFrame, sessions: DataFrame, target_s: int = S.DEFAULT_TARGET_S, widths: dict[str, int] = S.SMOOTHING_US) -> DataFrame:
    """(session_id, metric, w, n, present, mean, min, max, slope, missing, smoothed) for every window and every metric with samples."""
    own = written(timeline.filter(F.col("metric").isin(*S.CONTINUOUS)), "timeline")  # read several times below
    stats = window_stats(own, sessions, target_s)
    smooth = window_smooth(own, sessions, target_s, widths)
    missing = F.coalesce(1 - F.col("present") / F.col("n"), F.lit(1.0))
    return smooth.join(stats, ["session_id", "metric", "w"], "left").select("session_id", "metric", "w", "n", "present", "mean", "min", "max", "slope", missing.alias("missing"), "smoothed")


def extract(timeline: DataFrame, segments: DataFrame, sessions: DataFrame, target_s: int = S.DEFAULT_TARGET_S, widths: dict[str, int] = S.SMOOTHING_US) -> tuple[DataFrame, DataFrame]:
    """All features of a night: (session_id, metric, w, ...) by metric, and (session_id, w, stage, state, intensity) by window."""
    fractions = stage_fractions(segments, sessions, target_s)
    dominant = dominant_stage(fractions)
    by_window = dominant.join(coarse_states(dominant), ["session_id", "w"]).join(movement(timeline.filter("metric = 'steps'"), segments, sessions, target_s), ["session_id", "w"])
    return metric_window_features(timeline, sessions, target_s, widths), by_window


def stage_overlap(segments: DataFrame, sessions: DataFrame, target_s: int = S.DEFAULT_TARGET_S) -> DataFrame:
    """(session_id, w, stage, is_brief, overlap_us): each segment is dealt to the windows that it touches."""
    first = window_of(F.col("seg_start"), F.col("start_us"), F.col("end_us"), target_s)
    last = window_of(F.col("seg_end"), F.col("start_us"), F.col("end_us"), target_s)
    cut = segments.select("session_id", F.greatest("start_us", F.lit(0)).alias("seg_start"), F.col("end_us").alias("seg_end"), "stage", "is_brief").join(sessions, "session_id")
    dealt = cut.filter("seg_end > seg_start").withColumn("w", F.explode(F.sequence(first, last)))
    edge = lambda i: X.window_edge(i, F.col("start_us"), F.col("end_us"), target_s)
    over = F.least(F.col("seg_end"), edge(F.col("w") + 1)) - F.greatest(F.col("seg_start"), edge(F.col("w")))
    return dealt.select("session_id", "w", "stage", "is_brief", over.alias("overlap_us")).filter("overlap_us > 0")


def stage_fractions(segments: DataFrame, sessions: DataFrame, target_s: int = S.DEFAULT_TARGET_S) -> DataFrame:
    """(session_id, w, stage, us, fraction) for every stage and window; what no segment covers is unknown."""
    over = stage_overlap(segments, sessions, target_s).groupBy("session_id", "w", "stage").agg(F.sum("overlap_us").alias("us"))
    wide = windows(sessions, target_s).withColumn("length", F.col("w_end") - F.col("w_start"))
    every = wide.select("session_id", "w", "length", F.explode(F.array(*[F.lit(s) for s in S.STAGES])).alias("stage"))
    got = every.join(over, ["session_id", "w", "stage"], "left").withColumn("us", F.coalesce("us", F.lit(0)))
    known = F.sum("us").over(Window.partitionBy("session_id", "w"))
    us = F.when(F.col("stage") == "unknown", F.col("us") + F.col("length") - known).otherwise(F.col("us"))
    return got.withColumn("us", us).select("session_id", "w", "stage", "us", X.clamp(F.col("us") / F.col("length")).alias("fraction"))


def dominant_stage(fractions: DataFrame) -> DataFrame:
    """(session_id, w, stage): the longest, ties in a fixed order."""
    rank = X.lookup(F.col("stage"), {s: i for i, s in enumerate(S.STAGE_TIE_ORDER)})
    return fractions.groupBy("session_id", "w").agg(F.max_by("stage", F.struct(F.col("us"), -rank)).alias("stage"))


def coarse_states(dominant: DataFrame) -> DataFrame:
    """(session_id, w, state): runs of a single window are replaced by the state before, or at the start by the one after.

    A state stays where its run has two windows, and the second run stays where the first has one; others repeat what stayed last.
    """
    order = Window.partitionBy("session_id").orderBy("w")
    runs = dominant.withColumn("_new", F.when(F.col("stage") == F.lag("stage").over(order), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    sized = runs.withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy("session_id", "_run")))
    whole = Window.partitionBy("session_id")
    first = F.max(F.when(F.col("_run") == 1, F.col("_len"))).over(whole)
    second = F.max(F.when(F.col("_run") == 2, F.col("stage"))).over(whole)
    marked = sized.withColumn("_first", first).withColumn("_second", second)
    stays = (F.col("_len") >= 2) | ((F.col("_run") == 2) & (F.col("_first") == 1))
    state = F.when((F.col("_run") == 1) & (F.col("_first") == 1), F.coalesce("_second", "stage"))
    kept = marked.withColumn("_kept", F.coalesce(state, F.when(stays, F.col("stage"))))
    return kept.select("session_id", "w", F.last("_kept", ignorenulls=True).over(order).alias("state"))


def movement(steps: DataFrame, segments: DataFrame, sessions: DataFrame, target_s: int = S.DEFAULT_TARGET_S) -> DataFrame:
    """(session_id, w, intensity): from the mean of held steps; in sessions without any, the share of restless and brief segments."""
    stats = window_stats(steps.withColumn("metric", F.lit("steps")), sessions, target_s).select("session_id", "w", "mean", "present")
    rest = stage_overlap(segments, sessions, target_s).filter("stage = 'restless' or is_brief").groupBy("session_id", "w").agg(F.sum("overlap_us").alias("rest_us"))
    every = windows(sessions, target_s).join(stats, ["session_id", "w"], "left").join(rest, ["session_id", "w"], "left")
    counted = F.sum(F.coalesce("present", F.lit(0))).over(Window.partitionBy("session_id"))
    share = X.clamp(F.coalesce("rest_us", F.lit(0)) / (F.col("w_end") - F.col("w_start")))
    return every.withColumn("_any", counted).select("session_id", "w", F.when(F.col("_any") > 0, X.movement_intensity(F.col("mean"))).otherwise(share).alias("intensity"))


def brief_awakenings(segments: DataFrame, sessions: DataFrame, target_s: int = S.DEFAULT_TARGET_S) -> DataFrame:
    """Awake segments shorter, in seconds, than the compression ratio."""
    s = sessions.select("session_id", ((F.col("end_us") - F.col("start_us")) / float(S.US) / target_s).alias("ratio"))
    own = segments.filter("stage = 'awake'").join(s, "session_id")
    return own.filter((F.col("end_us") - F.col("start_us")) / float(S.US) < F.col("ratio")).select("session_id", "start_us", "end_us")


def brief_starts(segments: DataFrame, sessions: DataFrame, target_s: int = S.DEFAULT_TARGET_S) -> DataFrame:
    """(session_id, t): when brief awakenings begin, in replay seconds."""
    own = brief_awakenings(segments, sessions, target_s).select("session_id", F.col("start_us").alias("us")).join(sessions.select("session_id", "start_us", "end_us"), "session_id")
    ratio = X.compression_ratio(F.col("start_us"), F.col("end_us"), target_s)
    return own.select("session_id", ((F.col("us") - F.col("start_us")) / float(S.US) / ratio).alias("t"))


def availability(timeline: DataFrame, sessions: DataFrame, stages: DataFrame | None = None, daily_hrv: DataFrame | None = None) -> DataFrame:
    """(session_id, metric, missing, available) for each metric of every session: the share of samples without a value, and whether there is any
    to follow. A metric without rows misses all.

    HRV is available in sessions with a daily figure (session_id, rmssd), too. Where there are no steps but samples of known stages
    (session_id, us, stage), movement is available, and its missing share is that of the samples of the unknown stage.
    """
    every = sessions.select("session_id", F.explode(F.array(*[F.lit(m) for m in S.METRICS])).alias("metric"))
    share = timeline.groupBy("session_id", "metric").agg((1 - F.count("value") / F.count(F.lit(1))).alias("missing"))
    out = every.join(share, ["session_id", "metric"], "left").withColumn("missing", F.coalesce("missing", F.lit(1.0)))
    day, unknown = F.lit(False), F.lit(None).cast("double")
    if daily_hrv is not None:
        out = out.join(daily_hrv.filter("rmssd is not null").select("session_id", F.lit(True).alias("_day")), "session_id", "left")
        day = (F.col("metric") == "hrv_rmssd") & F.coalesce("_day", F.lit(False))
    if stages is not None:
        dark = stages.groupBy("session_id").agg((F.count(F.when(F.col("stage") == "unknown", 1)) / F.count(F.lit(1))).alias("_unknown"))
        out = out.join(dark.filter("_unknown < 1"), "session_id", "left")
        unknown = F.when((F.col("metric") == "steps") & (F.col("missing") == 1), F.col("_unknown"))
    missing = F.coalesce(unknown, F.col("missing"))
    return out.select("session_id", "metric", missing.alias("missing"), ((F.col("missing") < 1) | day | unknown.isNotNull()).alias("available"))


def merge_reports(reports: DataFrame) -> DataFrame:
    """(metric, n, first_us, last_us): reports of several imports or sessions (metric, n, first_us, last_us) as one."""
    return reports.groupBy("metric").agg(F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


def report(points: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """(keys, metric, n, first_us, last_us): how many points, and when."""
    return points.groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
