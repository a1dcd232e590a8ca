"""The manifest document of a session, and checks of what goes into it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.operators.events import runs
from tidewatch.operators.trajectories import Route


def room_windows(smoothed: DataFrame) -> DataFrame:
    """(session_id, room): for each window the temperature, humidity and pressure, null where the window has no sample of its own."""
    own = smoothed.withColumn("_v", F.when(F.col("present"), F.col("smoothed")))
    wide = own.groupBy("session_id", "w").agg(F.array(*[F.max(F.when(F.col("metric") == m, F.col("_v"))) for m in S.ROOM_METRICS]).alias("v"))
    return wide.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("room"))


#: The manifest as JSON; keys of a document stand in the order of the alphabet.
MANIFEST = (
    "struct<availability:map<string,struct<missing_fraction:double,status:string>>,coarse_states:array<struct<t0:double,t1:double,state:string>>,compression_ratio:double,"
    "display_timezone:string,environmental_windows:array<array<double>>,input_fingerprint:string,mapping_config:map<string,struct<hysteresis:double,sensitivity:double,target:string>>,"
    "night_events:array<struct<label:string,magnitude:double,night_time:string,replay_time_s:double,type:string>>,random_seed:bigint,session_end:string,session_start:string,"
    "target_duration_s:int,timeline_resolution_s:int,unavailable_metrics:array<string>,version:string,warnings:array<string>>"
)


def manifest(
    sessions: DataFrame, states: DataFrame, smoothed: DataFrame, availability: DataFrame, events: DataFrame, fingerprints: DataFrame, routes: Mapping[str, Route],
    target_s: int, zone: str = "UTC", seed: int = 1, version: str = "1", warnings: DataFrame | None = None,
) -> DataFrame:
    """(session_id, manifest): a JSON document with sorted keys: bounds and resolution, states, events, room windows, availability, what drove
    the replay, the fingerprint of the input and warnings (session_id, at, warning).

    ``sessions`` have their step (res_us), ``events`` their labels; times are written in the zone, with its offset.
    """
    by = lambda df, c, name: df.groupBy("session_id").agg(F.array_sort(F.collect_list(c)).alias(name))
    at = lambda c: F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_micros(c).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    offset = lambda c: F.concat_ws("", at(c), _offset(c, zone))
    seg = by(runs(states, "state", ["session_id"], "w"), F.struct((F.col("first") * S.WINDOW_S).alias("t0"), ((F.col("last") + 1) * S.WINDOW_S).alias("t1"), "state"), "coarse_states")
    told = F.struct("us", "type", F.struct("label", F.round("magnitude", 9).alias("magnitude"), offset("us").alias("night_time"), F.round("replay_s", 9).alias("replay_time_s"), "type").alias("e"))
    happened = by(events, told, "_events")
    status = F.struct(F.round("missing", 9).alias("missing_fraction"), F.when(F.col("available"), "available").otherwise("unavailable").alias("status"))
    have = availability.groupBy("session_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", status)))).alias("availability"), F.array_sort(F.collect_list(F.when(~F.col("available"), F.col("metric")))).alias("unavailable_metrics")
    )
    both = sessions.select("session_id", "start_us", "end_us", "res_us")
    for part in (seg, room_windows(smoothed), have, happened, fingerprints.withColumnRenamed("fingerprint", "input_fingerprint")):
        both = both.join(part, "session_id", "left")
    said = F.array().cast("array<string>")
    if warnings is not None:
        both = both.join(by(warnings, F.struct("at", "warning"), "_warnings"), "session_id", "left")
        said = F.coalesce(F.transform("_warnings", lambda x: x["warning"]), said)
    config = [x for m, r in sorted(routes.items()) for x in (F.lit(m), F.struct(F.lit(float(r.hysteresis)).alias("hysteresis"), F.lit(float(r.sensitivity)).alias("sensitivity"), F.lit(r.target or "none").alias("target")))]
    fields = F.struct(
        "availability", F.coalesce("coarse_states", F.array()).alias("coarse_states"), F.round((F.col("end_us") - F.col("start_us")) / float(S.US) / target_s, 6).alias("compression_ratio"),
        F.lit(zone).alias("display_timezone"), F.coalesce("room", F.array()).alias("environmental_windows"), "input_fingerprint", F.create_map(*config).alias("mapping_config"),
        F.coalesce(F.transform("_events", lambda x: x["e"]), F.array()).alias("night_events"), F.lit(seed).cast("bigint").alias("random_seed"), offset("end_us").alias("session_end"),
        offset("start_us").alias("session_start"), F.lit(target_s).alias("target_duration_s"), (F.col("res_us") / S.US).cast("int").alias("timeline_resolution_s"), "unavailable_metrics",
        F.lit(version).alias("version"), said.alias("warnings"),
    )
    return both.select("session_id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("manifest"))


def _offset(us: str, zone: str) -> Column:
    """The zone's offset at an instant, as +hh:mm."""
    t = F.timestamp_micros(us)
    minutes = (F.unix_micros(F.from_utc_timestamp(t, zone)) - F.unix_micros(t)) / (60 * S.US)
    part = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(F.when(minutes < 0, "-").otherwise("+"), part(F.abs(minutes) / 60), F.lit(":"), part(F.abs(minutes) % 60))


def manifest_problems(manifests: DataFrame) -> DataFrame:
    """(session_id, problem): what a manifest (session_id, manifest) breaks of what must hold, each once; no rows for a right one."""
    m = lambda c: F.col(f"m.{c}")
    when = lambda c: F.try_to_timestamp(c)
    n = m("target_duration_s")
    start, end = when(m("session_start")), when(m("session_end"))
    states, events, rooms = m("coarse_states"), m("night_events"), m("environmental_windows")
    outside = lambda x, lo, hi: x.isNull() | (x < lo) | (x > hi)
    ends = F.slice(F.transform(states, lambda x: x["t1"]), 1, F.greatest(F.size(states) - 1, F.lit(0)))
    starts = F.slice(F.transform(states, lambda x: x["t0"]), 2, F.greatest(F.size(states) - 1, F.lit(0)))
    seconds = (F.unix_micros(end) - F.unix_micros(start)) / float(S.US)
    lost = F.map_keys(F.map_filter(m("availability"), lambda k, v: v["status"] == "unavailable"))
    checks = {
        "document": F.col("m").isNull(),
        "session_start": start.isNull(), "session_end": end.isNull() | (end <= start), "target_duration_s": ~n.isin(*S.TARGETS_S),
        "compression_ratio": F.abs(m("compression_ratio") - seconds / n) > 1e-5, "timeline_resolution_s": ~m("timeline_resolution_s").isin(*S.RESOLUTIONS_S),
        "coarse_states": (F.size(states) == 0) | (F.get(states, F.lit(0))["t0"] != 0) | (F.element_at(states, -1)["t1"] != n) | (ends != starts)
        | F.exists(states, lambda x: (x["t1"] <= x["t0"]) | ~x["state"].isin(*S.STAGES)),
        "night_events.night_time": F.exists(events, lambda x: outside(when(x["night_time"]), start, end)),
        "night_events.replay_time_s": F.exists(events, lambda x: outside(x["replay_time_s"], F.lit(0.0), n)),
        "night_events.magnitude": F.exists(events, lambda x: outside(x["magnitude"], F.lit(0.0), F.lit(1.0))),
        "night_events.type": F.exists(events, lambda x: ~x["type"].isin(*S.EVENT_TYPES) | x["label"].isNull()),
        "environmental_windows": (F.size(rooms) != 2 * n) | F.exists(rooms, lambda x: F.size(x) != len(S.ROOM_METRICS)),
        "availability": F.array_sort(F.map_keys(m("availability"))) != F.array(*[F.lit(x) for x in sorted(S.METRICS)]),
        "availability.missing_fraction": F.exists(F.map_values(m("availability")), lambda v: outside(v["missing_fraction"], F.lit(0.0), F.lit(1.0)) | ~v["status"].isin("available", "unavailable")),
        "unavailable_metrics": F.array_sort(lost) != F.array_sort(m("unavailable_metrics")),
        "random_seed": outside(m("random_seed"), F.lit(0), F.lit(2**32 - 1)), "input_fingerprint": F.coalesce(m("input_fingerprint"), F.lit("")) == "", "version": F.coalesce(m("version"), F.lit("")) == "",
        "warnings": F.exists(m("warnings"), lambda x: x.isNull()),
    }
    broken = lambda name, c: c if name == "document" else F.col("m").isNotNull() & F.coalesce(c, F.lit(True))
    found = F.array_compact(F.array(*[F.when(broken(name, c), F.lit(name)) for name, c in checks.items()]))
    parsed = manifests.select("session_id", F.when(F.try_parse_json("manifest").isNotNull(), F.from_json("manifest", MANIFEST)).alias("m"))
    return parsed.select("session_id", F.explode(found).alias("problem"))


def violations(sessions: DataFrame, windows: DataFrame, fractions: DataFrame, target_s: int) -> DataFrame:
    """(check, violations): how many sessions or windows break what must hold."""
    order = Window.partitionBy("session_id").orderBy("w")
    n = int(target_s / S.WINDOW_S)
    per = windows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min("w_start").alias("lo"), F.max("w_end").alias("hi")).join(sessions, "session_id")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
    broken = windows.withColumn("before", F.lag("w_end").over(order)).filter("before is not null and before <> w_start or w_end <= w_start")
    sums = fractions.groupBy("session_id", "w").agg(F.sum("fraction").alias("f")).filter("abs(f - 1) > 1e-9")
    parts = [count(per.filter(F.col("n") != n), "window_count"), count(broken, "contiguous"), count(per.filter("lo <> start_us or hi <> end_us"), "coverage"), count(sums, "fractions")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cache_lookup(asked: DataFrame, replays: DataFrame) -> DataFrame:
    """Each (fingerprint, config, version) that is asked for with its newest ``replay`` (by ``seq``), or null."""
    key = ["fingerprint", "config", "version"]
    newest = replays.groupBy(*key).agg(F.max_by("replay", "seq").alias("replay"))
    return asked.join(newest, key, "left")
