"""Interval algebra: stage segments, candidate sessions, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions import scalars as X
from tidewatch.session import written

#: Up to so many members pieces are held against all of them, which is less to send than a row for each level.
FEW = 32


def _slices(rows: DataFrame, keys: list[str], start: str = "start_us", end: str = "end_us") -> DataFrame:
    """(keys, lo, hi): the pieces between neighbouring bounds of the rows of a key."""
    bounds = rows.select(*keys, F.explode(F.array(start, end)).alias("lo")).distinct()
    return bounds.withColumn("hi", F.lead("lo").over(Window.partitionBy(*keys).orderBy("lo"))).filter("hi is not null")


def _dyadic(rows: DataFrame, unit_us: int) -> DataFrame:
    """Rows (start_us, end_us) once for each cell (``_level``, ``_cell``) of the fewest dyadic stretches of ``unit_us`` that cover them: two a level
    at most, so the logarithm of their length."""
    first = F.floor(F.col("start_us") / unit_us).cast("bigint")
    behind = F.greatest(first + 1, F.ceil(F.col("end_us") / unit_us).cast("bigint"))
    at = rows.withColumn("_a", first).withColumn("_b", behind)
    top = F.ceil(F.log2((F.col("_b") - F.col("_a")).cast("double"))).cast("int")

    def cells(level):
        a = F.call_function("shiftright", F.col("_a") + F.call_function("shiftleft", F.lit(1).cast("bigint"), level) - 1, level)
        b = F.call_function("shiftright", F.col("_b"), level)
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        cell = lambda x: F.struct(level.alias("_level"), x.alias("_cell"))
        return F.array(F.when((a < b) & odd(a), cell(a)), F.when((a < b) & odd(b), cell(b - 1)))

    every = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), top), cells)), lambda x: x.isNotNull())
    return at.withColumn("_c", F.explode(every)).select(*rows.columns, "_c._level", "_c._cell")


def _covering(pieces: DataFrame, rows: DataFrame, keys: list[str], unit_us: int) -> DataFrame:
    """Pieces (lo, hi) with the rows that cover them. A piece looks for the cells that hold its start, one on each level that the key has."""
    cells = _dyadic(rows, unit_us)
    levels = cells.groupBy(*keys).agg(F.max("_level").alias("_top"))
    at = pieces.join(levels, keys).withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_top")))).drop("_top")
    at = at.withColumn("_cell", F.call_function("shiftright", F.floor(F.col("lo") / unit_us).cast("bigint"), F.col("_level")))
    return at.join(cells, [*keys, "_level", "_cell"]).filter("start_us <= lo and end_us >= hi").drop("_level", "_cell")


def stage_segments(intervals: DataFrame, sessions: DataFrame, unit_us: int = 15 * S.MINUTE) -> DataFrame:
    """Segments that don't overlap, from intervals (session_id, src_idx, start_us, end_us, stage, is_brief) that may.

    Intervals are clipped to the session. Where several cover an instant, the largest (is_brief, start, src_idx) wins;
    neighbouring pieces of one interval are one segment, those of different ones stay apart.
    """
    cut = intervals.join(sessions.select("session_id", F.col("start_us").alias("_s"), F.col("end_us").alias("_e")), "session_id")
    cut = cut.withColumn("start_us", F.greatest("start_us", "_s")).withColumn("end_us", F.least("end_us", "_e")).filter("end_us > start_us")
    pieces = _slices(cut, ["session_id"])
    over = _covering(pieces, cut, ["session_id"], unit_us)
    won = over.groupBy("session_id", "lo", "hi").agg(F.max_by(F.struct("src_idx", "stage", "is_brief"), F.struct("is_brief", "start_us", "src_idx")).alias("w"))
    order = Window.partitionBy("session_id").orderBy("lo")
    same = (F.lag("hi").over(order) == F.col("lo")) & (F.lag("w.src_idx").over(order) == F.col("w.src_idx"))
    runs = won.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(order))
    return runs.groupBy("session_id", "run").agg(
        F.min("lo").alias("start_us"), F.max("hi").alias("end_us"), F.first("w.stage").alias("stage"), F.first("w.is_brief").alias("is_brief")
    ).select("session_id", "start_us", "end_us", "stage", "is_brief")


def sleep_bounds(segments: DataFrame) -> DataFrame:
    """(session_id, onset_us, wake_us, availability): first and last sleep; stages, classic or none."""
    asleep = ~F.col("stage").isin("awake", "unknown")
    staged = F.bool_or(F.col("stage").isin("light", "deep", "rem"))
    any_ = F.bool_or(F.col("stage") != "unknown")
    return segments.groupBy("session_id").agg(
        F.min(F.when(asleep, F.col("start_us"))).alias("onset_us"),
        F.max(F.when(asleep, F.col("end_us"))).alias("wake_us"),
        F.when(staged, "stages").when(any_, "classic").otherwise("none").alias("availability"),
    )


def merge_islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with ``island``: a new one begins where a start is at or after all ends before it; touching doesn't merge."""
    order = Window.partitionBy(*keys).orderBy("start_us", "end_us", "content")
    upto = F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(upto.isNull() | (F.col("start_us") >= upto), 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each island: its bounds, members, first log id in the order of rank, and whether any is a main sleep."""
    best = F.struct(~F.col("is_main"), -(F.col("end_us") - F.col("start_us")), F.col("start_us"), F.col("content"))
    return merge_islands(rows, keys).groupBy(*keys, "island").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count(F.lit(1)).alias("members"),
        F.min_by("log_id", F.when(F.col("log_id").isNotNull(), best)).alias("log_id"), F.bool_or("is_main").alias("is_main"),
    )


def ownership(rows: DataFrame, keys: list[str], unit_us: int = 6 * S.HOUR) -> DataFrame:
    """(keys, content, start_us, end_us): each instant belongs to the best member that covers it (main, longest, earliest, content);
    neighbouring pieces of one owner are joined. A member alone in its group owns itself and isn't cut in pieces.

    In groups of ``FEW`` at most all pieces meet all members, which sends each once; in larger ones they meet in dyadic cells.
    """
    counted = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    alone = counted.filter("_n = 1 and end_us > start_us").select(*keys, "content", "start_us", "end_us")
    few, many = counted.filter((F.col("_n") > 1) & (F.col("_n") <= FEW)).drop("_n"), counted.filter(F.col("_n") > FEW).drop("_n")
    best = F.struct(~F.col("is_main"), -(F.col("end_us") - F.col("start_us")), F.col("start_us"), F.col("content"))
    order = Window.partitionBy(*keys).orderBy("lo")

    def owned(over: DataFrame) -> DataFrame:
        won = over.groupBy(*keys, "lo", "hi").agg(F.min_by("content", best).alias("owner"))
        same = (F.lag("hi").over(order) == F.col("lo")) & (F.lag("owner").over(order) == F.col("owner"))
        runs = won.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(order))
        return runs.groupBy(*keys, "run").agg(F.first("owner").alias("content"), F.min("lo").alias("start_us"), F.max("hi").alias("end_us")).drop("run")

    met = _slices(few, keys).join(few, keys).filter("start_us <= lo and end_us >= hi")
    return alone.unionByName(owned(met)).unionByName(owned(_covering(_slices(many, keys), many, keys, unit_us)))


def merged_segments(owners: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content, start_us, end_us, stage, is_brief): each owner's segments (keys, content, ...), cut to the stretches that it owns."""
    names = [k for k in keys if k in segments.columns]
    own = owners.select(*keys, "content", F.col("start_us").alias("_s"), F.col("end_us").alias("_e")).join(segments, [*names, "content"])
    cut = own.select(*keys, "content", F.greatest("start_us", "_s").alias("start_us"), F.least("end_us", "_e").alias("end_us"), "stage", "is_brief")
    return cut.filter("end_us > start_us")


def first_of_rank(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value): the value of the best member of each group that has one (main, longest, earliest, content)."""
    best = F.struct(~F.col("is_main"), -(F.col("end_us") - F.col("start_us")), F.col("start_us"), F.col("content"))
    return rows.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), best)).alias(value))


def merged_points(points: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, us, source, metric, value, unit): the members' points (content, ...) by group, equal ones once."""
    return points.join(members.select(*keys, "content"), "content").select(*keys, "us", "source", "metric", "value", "unit").distinct()


def duplicate_groups(rows: DataFrame, key: str = "subject") -> DataFrame:
    """Each row with ``root``: the least content key among its duplicates, taken transitively.

    Rows of a subject are duplicates if they share a log id or both bounds. Each round takes the least label of every such
    group, as window functions, and then the label of the label, until labels stay.
    """
    out = rows.withColumn("root", F.col("content"))
    by_log, by_bounds = Window.partitionBy(key, "log_id"), Window.partitionBy(key, "start_us", "end_us")
    while True:
        log = F.when(F.col("log_id").isNotNull(), F.min("root").over(by_log)).otherwise(F.col("root"))
        new = out.withColumn("_a", log).withColumn("_b", F.min("_a").over(by_bounds))
        up = new.groupBy(F.col(key), F.col("content").alias("_b")).agg(F.min("_b").alias("_up"))
        new = new.join(up, [key, "_b"], "left").withColumn("_b", F.least("_b", "_up"))
        new = written(new.withColumn("_changed", F.col("_b") != F.col("root")).withColumn("root", F.col("_b")).select(*out.columns, "_changed"), "duplicate-groups")
        out = new.drop("_changed")
        if not new.filter("_changed").limit(1).count():
            return out


def deduplicate(rows: DataFrame, key: str = "subject") -> DataFrame:
    """The best row of each group of duplicates: main sleep first, then one with stages, then the least content."""
    rank = F.struct(~F.col("is_main"), ~F.col("has_stages"), F.col("content"))
    grouped = duplicate_groups(rows, key)
    return grouped.groupBy(key, "root").agg(F.min_by(F.struct("content", "start_us", "end_us", "log_id", "is_main"), rank).alias("b"), F.count(F.lit(1)).alias("n")).select(key, "b.*", "n")


def latest_first(sessions: DataFrame, key: str = "subject") -> DataFrame:
    """Sessions with ``place`` (latest start, latest end, content) and whole minutes."""
    order = Window.partitionBy(key).orderBy(F.desc("start_us"), F.desc("end_us"), "content")
    return sessions.withColumn("place", F.row_number().over(order)).withColumn("minutes", F.floor((F.col("end_us") - F.col("start_us")) / S.MINUTE))


def auto_select(sessions: DataFrame, zone: str, key: str = "subject") -> DataFrame:
    """(subject, content): the latest main sleep; without one, the longest on the latest local end date, then the later, then the largest content."""
    date = F.to_date(F.from_utc_timestamp(F.timestamp_micros("end_us"), zone))
    main = F.struct(F.col("is_main"), F.when(F.col("is_main"), F.col("start_us")), F.when(F.col("is_main"), F.col("end_us")), F.when(~F.col("is_main"), date),
                    F.when(~F.col("is_main"), F.col("end_us") - F.col("start_us")), F.col("start_us"), F.col("content"))
    return sessions.groupBy(key).agg(F.max_by("content", main).alias("content"))


def containing(old: DataFrame, new: DataFrame, key: str = "subject", unit_us: int = 24 * S.HOUR) -> DataFrame:
    """Each old session with the new one that contains it, or null: one with the same bounds, else the shortest (ties: least content).

    Sessions meet in dyadic cells of time, so a long one makes few rows.
    """
    pieces = old.select(key, "content", F.col("start_us").alias("lo"), F.col("end_us").alias("hi"))
    inside = _covering(pieces, new.select(key, "start_us", "end_us", F.col("content").alias("_holder")), [key], unit_us)
    other = (F.col("start_us") != F.col("lo")) | (F.col("end_us") != F.col("hi"))
    rank = F.struct(other.alias("other"), (F.col("end_us") - F.col("start_us")).alias("d"), F.col("_holder").alias("c"))
    best = inside.groupBy(key, "content").agg(F.min(rank)["c"].alias("container"))
    return old.select(key, "content").distinct().join(best, [key, "content"], "left")


def choose(sessions: DataFrame, choices: DataFrame, key: str = "subject") -> DataFrame:
    """(subject, choice, content): the listed session with the chosen key (:func:`~tidewatch.functions.scalars.session_key`), the least content
    of several; null where none has it."""
    own = sessions.select(key, F.col("content"), X.session_key(F.col("start_us"), F.col("end_us")).alias("choice"))
    return choices.select(key, "choice").join(own, [key, "choice"], "left").groupBy(key, "choice").agg(F.min("content").alias("content"))


def manual_sessions(ranges: DataFrame, zone: str) -> DataFrame:
    """Rows (subject, start, end) as written, with start_us, end_us and ``problem``: null for a range that ends after its start and lasts a day
    at most. Times without an offset are of the zone; a date alone is none. A manual session has one stage, unknown, and is no main sleep."""
    us = lambda c: F.unix_micros(X.instant(F.when(X.has_time(F.col(c)), X.iso_parts(F.col(c))), zone))
    both = ranges.withColumn("start_us", us("start")).withColumn("end_us", us("end"))
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    problem = (
        F.when(blank("start"), "start is missing").when(F.col("start_us").isNull(), "start could not be read").when(blank("end"), "end is missing")
        .when(F.col("end_us").isNull(), "end could not be read").when(F.col("end_us") <= F.col("start_us"), "end is not after the start")
        .when(F.col("end_us") - F.col("start_us") > S.MANUAL_CAP_US, "longer than 24 hours")
    )
    return both.withColumn("problem", problem)


def resolve_selection(current: DataFrame, sessions: DataFrame, zone: str, key: str = "subject") -> DataFrame:
    """(subject, kind, content): the selection after an import, from the one before (subject, kind, content, start_us, end_us; no row for none).

    A manual one stays. A user's choice follows the session that contains it now, or stays. Else the automatic rule picks; a
    subject without candidates has kind ``none``.
    """
    subjects = current.select(key).union(sessions.select(key)).distinct()
    user = current.filter("kind = 'user'")
    follow = containing(user, sessions, key).withColumnsRenamed({"content": "_c"})
    kept = user.select(key, F.col("content").alias("_c")).join(follow, [key, "_c"], "left").select(key, F.coalesce("container", "_c").alias("_user"))
    manual = current.filter("kind = 'manual'").select(key, F.col("content").alias("_manual"))
    auto = auto_select(sessions, zone, key).withColumnRenamed("content", "_auto")
    every = subjects.join(manual, key, "left").join(kept, key, "left").join(auto, key, "left")
    kind = F.when(F.col("_manual").isNotNull(), "manual").when(F.col("_auto").isNull(), "none").when(F.col("_user").isNotNull(), "user").otherwise("auto")
    content = F.when(kind == "manual", F.col("_manual")).when(kind == "user", F.col("_user")).when(kind == "auto", F.col("_auto"))
    return every.select(key, kind.alias("kind"), content.alias("content"))


def on_date(sessions: DataFrame, day: str, zone: str) -> DataFrame:
    """Sessions that end on a date of the zone."""
    return sessions.filter(F.to_date(F.from_utc_timestamp(F.timestamp_micros("end_us"), zone)) == F.lit(day).cast("date"))


def with_imports(sessions: DataFrame, imports: DataFrame) -> DataFrame:
    """Sessions (import_id, position, ...) of completed imports (import_id, seq), with ``place``: in the order of import and position."""
    own = sessions.join(imports.select("import_id", "seq"), "import_id")
    return own.withColumn("place", F.row_number().over(Window.partitionBy("import_id").orderBy("position"))).orderBy("seq", "position")
