"""Parameter trajectories: normalising, contributions with hysteresis and glides, combining, rate limits, presets, schedules.

Tables by window join by sorting: those of long runs are small as files and large in memory, so their size says nothing.

Times are seconds of the replay. Windows that have no sample of their own (not
``present``) are missing, although smoothing gives them a value. Hysteresis and
glides are a fold over the windows of a session, which are as many as the replay
is long; rate limits are scans that take keys of any length.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions import scalars as X
from tidewatch.functions.arrays import fold_each, let
from tidewatch.operators.asof import as_of, lerp
from tidewatch.operators.events import runs
from tidewatch.operators.scans import slew
from tidewatch.session import written


@dataclass(frozen=True)
class Route:
    """What a metric drives: a parameter or None, how strongly, and by how much its raw value must move."""

    target: str | None
    sensitivity: float
    hysteresis: float = 0.0

    @property
    def enabled(self) -> bool:
        return self.target is not None and self.sensitivity > 0


Routes = Mapping[str, Route]


def _of_metric(values: Mapping[str, object], default=None, metric: str = "metric") -> Column:
    return X.lookup(F.col(metric), dict(values), default)


def window_spans(windows: DataFrame, sessions: DataFrame, target_s: int) -> DataFrame:
    """(session_id, w, t0, t1): the windows in replay seconds, by the compression ratio."""
    ratio = (F.col("end_us") - F.col("start_us")) / float(S.US) / target_s
    at = lambda c: (F.col(c) - F.col("start_us")) / float(S.US) / ratio
    return windows.join(sessions.select("session_id", "start_us", "end_us"), "session_id").select("session_id", "w", at("w_start").alias("t0"), at("w_end").alias("t1"))


def _span(lo: Column, hi: Column, metric: Column) -> tuple[Column, Column]:
    half = F.greatest(hi - lo, X.lookup(metric, S.LEAST_SPAN, 1.0)) / 2
    return (lo + hi) / 2 - half, (lo + hi) / 2 + half


def _value() -> Column:
    """A window's smoothed value, if it has a sample of its own."""
    return F.when(F.col("present"), F.col("smoothed"))


def spans(smoothed: DataFrame) -> DataFrame:
    """(session_id, metric, low, high): the range of the windows' values, widened around its middle to the metric's least span."""
    r = smoothed.filter("present and smoothed is not null").groupBy("session_id", "metric").agg(F.min("smoothed").alias("lo"), F.max("smoothed").alias("hi"))
    low, high = _span(F.col("lo"), F.col("hi"), F.col("metric"))
    return r.select("session_id", "metric", low.alias("low"), high.alias("high"))


def normalize_windows(smoothed: DataFrame, sensitivity: Mapping[str, float]) -> DataFrame:
    """(session_id, metric, w, smoothed, present, n, v): values within their span, and mapped by sensitivity; missing stays missing."""
    smoothed = written(smoothed, "smoothed-windows")  # read twice below
    own = smoothed.withColumn("_v", _value()).join(spans(smoothed), ["session_id", "metric"], "left")
    n = F.when(F.col("_v").isNotNull(), X.normalized(F.col("_v"), F.col("low"), F.col("high")))
    mapped = own.select("session_id", "metric", "w", "smoothed", "present", n.alias("n"))
    return mapped.withColumn("v", F.when(F.col("n").isNotNull(), X.mapped_value(F.col("n"), F.col("metric"), _of_metric(sensitivity, 1.0))))


def _fold(rows: DataFrame, keys: list[str], order: str, values: list[str], start: Column, step, kind: str) -> DataFrame:
    """Each row's ``out``: the state of a fold over the key's rows in order. ``step(state, row)`` gives the next state."""
    arr = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *values))).alias("_a"))
    both = arr.withColumn("_s", fold_each(F.col("_a"), start, step, kind))
    each = both.select(*keys, F.explode(F.arrays_zip("_a", "_s")).alias("_e"))
    return each.select(*keys, F.col("_e._a._o").alias(order), *[F.col(f"_e._a.{v}").alias(v) for v in values], F.col("_e._s").alias("out"))


def rate_limit(rows: DataFrame, value: str = "v", rate: float = S.RATE_SLOW, dt: float = S.WINDOW_S, keys: tuple[str, ...] = ("session_id", "metric"), order: str = "w") -> DataFrame:
    """(keys, order, value, out): each value as near to its target as a largest change per step of ``dt`` allows."""
    return slew(rows.withColumn("_most", F.lit(float(rate * dt))), list(keys), [order], value, "_most")


def hysteresis(rows: DataFrame, value: str, threshold: float, applied: str | None = None, keys: tuple[str, ...] = ("session_id", "metric")) -> DataFrame:
    """``out``: what ``applied`` (the value itself by default) was when the value last moved by ``threshold`` from where it had moved before;
    null where the value is missing, and forgotten there."""
    then = applied or value

    def step(last: Column, x: Column) -> Column:
        moves = last["ref"].isNull() | (F.abs(x[value] - last["ref"]) >= threshold)
        new = F.struct(F.when(moves, x[value]).otherwise(last["ref"]).alias("ref"), F.when(moves, x[then]).otherwise(last["out"]).alias("out"))
        return F.when(x[value].isNotNull(), new).otherwise(F.struct(F.lit(None).cast("double").alias("ref"), F.lit(None).cast("double").alias("out")))

    kind = "struct<ref:double,out:double>"
    folded = _fold(rows, list(keys), "w", list(dict.fromkeys([value, then])), F.struct(F.lit(None).alias("ref"), F.lit(None).alias("out")), step, kind)
    return folded.withColumn("out", F.col("out.out"))


STATE = "struct<missing:boolean,ref:double,applied:double,t0:double,v0:double,t1:double,v1:double,flip:boolean,center:boolean>"


def contributions(mapped: DataFrame, spans_: DataFrame, routes: Routes, target_s: int, daily_hrv: DataFrame | None = None) -> DataFrame:
    """(session_id, metric, t, v): each metric's trajectory as breakpoints.

    ``mapped`` has (session_id, metric, w, smoothed, present, v) for every window. A metric that drives nothing, or has no value in
    the session, with or without rows, rests at the middle; HRV without samples takes the session's daily figure (session_id,
    rmssd) if there is one.
    Values follow the raw value with hysteresis, at the windows' middles. Where values go missing or come back, the
    trajectory glides within a second from where it is, at the window's start; a glide that another one interrupts is cut.
    """
    end = float(target_s)
    mapped = written(mapped, "contribution-windows")  # read twice below
    own = mapped.groupBy("session_id", "metric").agg(F.count(_value()).alias("_have"), F.max("present").alias("_own"))
    every = spans_.select("session_id").distinct().select("session_id", F.explode(F.array(*[F.lit(m) for m in routes])).alias("metric"))
    have = every.join(own, ["session_id", "metric"], "left").na.fill({"_have": 0, "_own": False})
    enabled = F.col("metric").isin([m for m, r in routes.items() if r.enabled])
    # movement is never missing, so it is followed whatever it is
    alive = have.withColumn("_live", enabled & (F.col("_have") > 0))
    if daily_hrv is not None:
        alive = alive.join(daily_hrv.select("session_id", "rmssd"), "session_id", "left")
    else:
        alive = alive.withColumn("rmssd", F.lit(None).cast("double"))
    of_day = X.mapped_value(X.clamp(F.col("rmssd") / 100), F.col("metric"), _of_metric({m: r.sensitivity for m, r in routes.items()}, 0.0))
    still = F.when((F.col("metric") == "hrv_rmssd") & enabled & ~F.col("_own") & F.col("rmssd").isNotNull(), of_day).otherwise(F.lit(S.NEUTRAL))
    flat = alive.filter("not _live").select("session_id", "metric", F.explode(F.array(F.lit(0.0), F.lit(end))).alias("t"), still.alias("v"))

    rows = mapped.withColumn("smoothed", _value()).join(alive.filter("_live").select("session_id", "metric").hint("merge"), ["session_id", "metric"]).join(spans_.hint("merge"), ["session_id", "w"])
    rows = rows.withColumn("limit", _of_metric({m: float(r.hysteresis) for m, r in routes.items()}, 0.0)).withColumnsRenamed({"t0": "a", "t1": "b"})

    def step(s: Column, x: Column) -> Column:
        first, gone = s["missing"].isNull(), x["smoothed"].isNull()
        flip = ~first & (gone != s["missing"])
        moves = s["ref"].isNull() | F.coalesce(s["missing"], F.lit(False)) | (F.abs(x["smoothed"] - s["ref"]) >= x["limit"])
        here = F.when(s["t1"] <= x["a"], s["v1"]).otherwise(s["v0"] + (s["v1"] - s["v0"]) * (x["a"] - s["t0"]) / (s["t1"] - s["t0"]))
        center = (x["a"] + x["b"]) / 2
        seen = F.struct(
            first.alias("first"), gone.alias("gone"), flip.alias("flip"), center.alias("c"), (first | ~flip & (s["t1"] < center)).alias("center"), here.alias("here"),
            F.when(gone | ~moves, s["ref"]).otherwise(x["smoothed"]).alias("ref"), F.when(gone | ~moves, s["applied"]).otherwise(x["v"]).alias("applied"),
        )

        def after(y: Column) -> Column:
            value = F.when(y["gone"], F.lit(S.NEUTRAL)).otherwise(y["applied"])
            return F.struct(
                y["gone"].alias("missing"), y["ref"].alias("ref"), y["applied"].alias("applied"),
                F.when(y["first"], F.lit(0.0)).when(y["flip"], x["a"]).when(y["center"], s["t1"]).otherwise(s["t0"]).alias("t0"),
                F.when(y["first"], value).when(y["flip"], y["here"]).when(y["center"], s["v1"]).otherwise(s["v0"]).alias("v0"),
                F.when(y["flip"], x["a"] + S.GLIDE_S).when(y["center"], y["c"]).otherwise(s["t1"]).alias("t1"),
                F.when(y["flip"] | y["center"], value).otherwise(s["v1"]).alias("v1"), y["flip"].alias("flip"), y["center"].alias("center"),
            )

        return let(seen, after)

    nothing = F.from_json(F.lit("{}"), STATE)
    folded = _fold(rows, ["session_id", "metric"], "w", ["a", "b", "smoothed", "v", "limit"], nothing, step, STATE)
    s = written(folded.select("session_id", "metric", "w", "out.*"), "contribution-steps")
    order = Window.partitionBy("session_id", "metric").orderBy("w")
    later = F.min(F.when(F.col("flip"), F.col("t0"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    last = F.row_number().over(Window.partitionBy("session_id", "metric").orderBy(F.desc("w"))) == 1
    s = s.withColumn("_later", later).withColumn("_last", last).withColumn("_first", F.row_number().over(order) == 1)
    point = lambda t, v: F.struct(t.alias("t"), v.alias("v"))
    none = F.lit(None).cast("struct<t:double,v:double>")
    points = F.array(
        F.when(F.col("_first"), point(F.lit(0.0), F.col("v0"))).otherwise(none),
        F.when(F.col("flip"), point(F.col("t0"), F.col("v0"))).otherwise(none),
        F.when(F.col("flip") & (F.col("_later").isNull() | (F.col("t1") < F.col("_later"))) | F.col("center"), point(F.col("t1"), F.col("v1"))).otherwise(none),
        F.when(F.col("_last") & (F.col("t1") < end), point(F.lit(end), F.col("v1"))).otherwise(none),
    )
    moving = s.select("session_id", "metric", F.explode(F.array_compact(points)).alias("p")).select("session_id", "metric", "p.t", "p.v")
    return flat.unionByName(moving)


def restless_windows(intensity: DataFrame, states: DataFrame, windows: DataFrame) -> DataFrame:
    """(session_id, w, restless): windows in a restless state, or in a run of movement above a threshold that lasts ten minutes of the night."""
    both = windows.select("session_id", "w", "w_start", "w_end").join(intensity, ["session_id", "w"]).join(states.select("session_id", "w", "state").hint("merge"), ["session_id", "w"])
    order = Window.partitionBy("session_id").orderBy("w")
    up = F.col("intensity") > S.RESTLESS
    marked = both.withColumn("_up", up).withColumn("_run", F.sum(F.when(F.col("_up").eqNullSafe(F.lag("_up").over(order)), 0).otherwise(1)).over(order))
    run = Window.partitionBy("session_id", "_run")
    long = F.col("_up") & (F.max("w_end").over(run) - F.min("w_start").over(run) >= S.RESTLESS_US)
    return marked.select("session_id", "w", (long | (F.col("state") == "restless")).alias("restless"))


def evaluate(breakpoints: DataFrame, probes: DataFrame, keys: list[str], at: str = "us", value: str = "value") -> DataFrame:
    """Piecewise-linear values at the probes; before the first and after the last point these stand."""
    both = as_of(breakpoints, probes, keys, at=at, carry=(at, value), forward=True)
    prev, nxt = F.col(f"prev_{at}"), F.col(f"next_{at}")
    inside = F.when(prev == nxt, F.col(f"prev_{value}")).otherwise(lerp(F.col(at), prev, F.col(f"prev_{value}"), nxt, F.col(f"next_{value}")))
    own = [c for c in probes.columns if c not in (*keys, at)]
    return both.select(*keys, at, *own, F.coalesce(inside, F.col(f"prev_{value}"), F.col(f"next_{value}")).alias(value))


def combine(contributions_: DataFrame, spans_: DataFrame, routes: Routes, target_s: int, restless: DataFrame | None = None) -> DataFrame:
    """(session_id, param, t, v): the parameters' trajectories, at the times of all breakpoints and of the windows' middles.

    A parameter is the mean of the metrics that drive it, weighted by sensitivity, or the middle without any; restless windows
    raise some parameters; a value changes no faster than the parameter's rate.
    """
    end = float(target_s)
    contributions_ = written(contributions_, "contributions")  # read twice below
    drives = {m: r for m, r in routes.items() if r.enabled}
    movement = drives.get("steps")
    middles = spans_.select("session_id", "w", ((F.col("t0") + F.col("t1")) / 2).alias("t"))
    ends = spans_.select("session_id").distinct().select("session_id", F.explode(F.array(F.lit(0.0), F.lit(end))).alias("t"))
    times = contributions_.select("session_id", "t").filter(F.col("t") <= end).unionByName(middles.select("session_id", "t")).unionByName(ends).distinct()
    # every metric once at all times, the raising of restless windows like one of them
    lines = contributions_.filter(F.col("metric").isin(list(drives))).select("session_id", "metric", "t", "v")
    if restless is not None and movement is not None:
        more = F.when(F.col("restless"), F.lit(S.RESTLESS_BOOST * movement.sensitivity)).otherwise(0.0)
        lines = lines.unionByName(middles.join(restless.hint("merge"), ["session_id", "w"]).select("session_id", F.lit("boost").alias("metric"), "t", more.alias("v")))
    else:
        lines = lines.unionByName(ends.select("session_id", F.lit("boost").alias("metric"), "t", F.lit(0.0).alias("v")))
    probes = times.select("session_id", F.explode(F.array(*[F.lit(m) for m in (*drives, "boost")])).alias("metric"), "t")
    values = evaluate(lines, probes, ["session_id", "metric"], at="t", value="v")
    at = lambda m: F.max(F.when(F.col("metric") == m, F.col("v")))
    wide = values.groupBy("session_id", "t").agg(*[at(m).alias(f"_{m}") for m in (*drives, "boost")])

    def mean(param: str) -> Column:
        some = [(F.col(f"_{m}"), float(r.sensitivity)) for m, r in drives.items() if r.target == param]
        total = sum((F.when(v.isNotNull(), F.lit(s)).otherwise(0.0) for v, s in some), F.lit(0.0))
        v = F.coalesce(sum((F.coalesce(v * s, F.lit(0.0)) for v, s in some), F.lit(0.0)) / F.when(total > 0, total), F.lit(S.NEUTRAL))
        return F.least(F.lit(1.0), v + F.coalesce("_boost", F.lit(0.0))) if param in S.BOOSTED else v

    rate = lambda p: F.lit(S.RATE_FAST if p in S.FAST_PARAMETERS else S.RATE_SLOW)
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("param"), mean(p).alias("v"), rate(p).alias("rate")) for p in S.PARAMETERS]))
    rated = wide.select("session_id", "t", each.alias("p")).select("session_id", "p.param", "t", "p.v", "p.rate")
    return slew(rated, ["session_id", "param"], ["t"], "v", "rate", by_time=True).select("session_id", "param", "t", F.col("out").alias("v"))


def nature_controls(smoothed: DataFrame, spans_: DataFrame, routes: Routes, target_s: int, scales: Mapping[str, float] = S.VARIATION_SCALES) -> DataFrame:
    """(session_id, metric, t, v): how far a room metric is from the session's median, in its scale and by its sensitivity, moving slowly.

    Missing windows and metrics that drive nothing have 0 as their target, and so have metrics without any. Windows beyond the end
    stand at the end.
    """
    end = float(target_s)
    own = smoothed.filter(F.col("metric").isin(*scales)).select("session_id", "metric", "w", _value().alias("_v"))
    middle = own.groupBy("session_id", "metric").agg(F.percentile("_v", F.lit(0.5)).alias("_mid"))
    strength = _of_metric({m: float(r.sensitivity) if r.enabled else 0.0 for m, r in routes.items()}, 0.0)
    every = spans_.select("session_id", "w", F.least(F.lit(end), (F.col("t0") + F.col("t1")) / 2).alias("t"), F.explode(F.array(*[F.lit(m) for m in scales])).alias("metric"))
    both = every.join(own.hint("merge"), ["session_id", "metric", "w"], "left").join(middle, ["session_id", "metric"], "left")
    away = F.when(F.col("_v").isNotNull(), F.least(F.lit(1.0), F.abs(F.col("_v") - F.col("_mid")) / _of_metric(scales)) * strength)
    rows = both.select("session_id", "metric", "t", "w", F.coalesce(away, F.lit(0.0)).alias("target"), F.lit(S.RATE_NATURE).alias("rate"))
    out = written(slew(rows, ["session_id", "metric"], ["t", "w"], "target", "rate", by_time=True), "nature-steps")
    # windows at one time are one point; the first target stands at the start, the last value up to the end
    points = out.groupBy("session_id", "metric", "t").agg(F.min_by("out", "w").alias("v")).filter("t > 0")
    first = out.groupBy("session_id", "metric").agg(F.min_by("target", F.struct("t", "w")).alias("v"), F.max("t").alias("_t"), F.max_by("out", F.struct("t", "w")).alias("_v"))
    start = first.select("session_id", "metric", F.lit(0.0).alias("t"), "v")
    stop = first.filter(F.col("_t") < end).select("session_id", "metric", F.lit(end).alias("t"), F.col("_v").alias("v"))
    return points.select("session_id", "metric", "t", "v").unionByName(start).unionByName(stop)


def preset_spans(states: DataFrame, window_s: float = S.WINDOW_S) -> DataFrame:
    """(session_id, preset, t0, t1, fade): runs of the states' presets, and the crossfade at their start: at most as long as they and the run before."""
    p = states.withColumn("preset", X.lookup(F.col("state"), S.STATE_PRESETS))
    r = runs(p, "preset", ["session_id"], "w").select("session_id", "preset", (F.col("first") * window_s).alias("t0"), ((F.col("last") + 1) * window_s).alias("t1"))
    order = Window.partitionBy("session_id").orderBy("t0")
    own = F.col("t1") - F.col("t0")
    before = F.lag(own).over(order)
    return r.withColumn("fade", F.when(before.isNull(), 0.0).otherwise(F.least(F.lit(S.CROSSFADE_S), own, before)))


def preset_gains(spans_: DataFrame, probes: DataFrame) -> DataFrame:
    """(session_id, t, preset, gain): at each time the presets that sound. A crossfade has its middle on the boundary of two spans."""
    order = Window.partitionBy("session_id").orderBy("t0")
    lead = lambda c, name: F.lead(c).over(order).alias(name)
    near = spans_.select("session_id", F.col("t0").alias("us"), "t0", "t1", "fade", "preset", F.lag("preset").over(order).alias("before"), lead("preset", "after"), lead("fade", "out"))
    found = as_of(near, probes.select("session_id", F.col("t").alias("us")), ["session_id"], carry=("t0", "t1", "fade", "preset", "before", "after", "out"))
    t = F.col("us")
    at = found.filter(t <= F.col("prev_t1")).select("session_id", t.alias("t"), *[F.col(f"prev_{c}").alias(c) for c in ("t0", "t1", "fade", "preset", "before", "after", "out")])
    t, t0, t1, fade, out = (F.col(c) for c in ("t", "t0", "t1", "fade", "out"))
    leaving, coming = (out > 0) & (t >= t1 - out / 2), (fade > 0) & (t <= t0 + fade / 2)
    own = F.when(leaving, (t1 + out / 2 - t) / out).when((fade > 0) & (t < t0 + fade / 2), (t - t0 + fade / 2) / fade).otherwise(1.0)
    three = F.array(
        F.struct(F.col("preset").alias("preset"), own.alias("gain")),
        F.struct(F.col("before").alias("preset"), F.when(coming, (t0 + fade / 2 - t) / fade).alias("gain")),
        F.struct(F.col("after").alias("preset"), F.when(leaving, (t - t1 + out / 2) / out).alias("gain")),
    )
    each = at.select("session_id", "t", F.explode(three).alias("g")).filter("g.preset is not null and g.gain is not null")
    return each.groupBy("session_id", "t", F.col("g.preset").alias("preset")).agg(F.sum("g.gain").alias("gain"))


def gestures(events: DataFrame, target_s: int = S.DEFAULT_TARGET_S) -> DataFrame:
    """(session_id, type, t0, t1): two seconds around onset and final awakening, moved inward at the ends of the replay."""
    own = events.filter(F.col("type").isin(*S.PINNED_EVENTS))
    t0 = F.least(F.lit(target_s - 2.0), F.greatest(F.lit(0.0), F.col("replay_s") - 1))
    return own.select("session_id", "type", t0.alias("t0"), (t0 + 2).alias("t1"))


def schedule_transients(intensity: DataFrame, spans_: DataFrame, routes: Routes, brief: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """(session_id, t, amp, kind): one in the middle half of each window with movement, at a place given by a hash of the seed, as strong as
    movement and its sensitivity; and one for each brief awakening (session_id, t), before any cap."""
    movement = routes.get("steps")
    named = F.concat_ws(":", F.lit(str(seed)), "session_id", F.col("w").cast("string"))
    jitter = F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("bigint") / float(1 << 32)
    both = intensity.filter(F.col("intensity") > S.TRANSIENT).join(spans_.hint("merge"), ["session_id", "w"])
    t = F.col("t0") + (F.col("t1") - F.col("t0")) * (0.25 + 0.5 * jitter)
    strength = movement.sensitivity if movement is not None and movement.enabled else 0.0
    out = both.filter(F.lit(strength > 0)).select("session_id", t.alias("t"), (F.lit(strength) * F.col("intensity")).alias("amp"), F.lit("movement").alias("kind"))
    if brief is not None:
        out = out.unionByName(brief.select("session_id", "t", F.lit(S.BRIEF_AMPLITUDE).alias("amp"), F.lit("brief_awakening").alias("kind")))
    return out


def render_plan(contributions_: DataFrame, spans_: DataFrame, states: DataFrame, restless: DataFrame, smoothed: DataFrame, events: DataFrame, transients: DataFrame, routes: Routes, target_s: int) -> DataFrame:
    """(session_id, part, name, t, v): all that a renderer needs, as rows: trajectories, controls, presets (v: the crossfade), gestures and
    transients (v: the amplitude). ``transients`` are capped already."""
    row = lambda df, part, name, t, v: df.select("session_id", F.lit(part).alias("part"), F.col(name).alias("name"), F.col(t).cast("double").alias("t"), F.col(v).cast("double").alias("v"))
    parts = [
        row(combine(contributions_, spans_, routes, target_s, restless), "trajectory", "param", "t", "v"),
        row(nature_controls(smoothed, spans_, routes, target_s), "control", "metric", "t", "v"),
        row(preset_spans(states), "preset", "preset", "t0", "fade"),
        row(gestures(events, target_s), "gesture", "type", "t0", "t1"),
        row(transients, "transient", "kind", "t", "amp"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
