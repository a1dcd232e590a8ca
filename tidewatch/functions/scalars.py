"""Scalar functions as column expressions: units, numbers, timestamps, time maps, texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions.arrays import let

NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def lookup(c: Column, values: dict, default=None) -> Column:
    """A CASE over a small fixed map."""
    out = F.lit(default)
    for k, v in reversed(list(values.items())):
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def to_canonical(metric: Column, unit: Column, value: Column) -> Column:
    """The value in the metric's canonical unit; null where the unit can't be converted."""
    u = F.lower(F.trim(unit))
    return (
        F.when((metric == "temperature") & (u == "fahrenheit"), (value - 32) * 5 / 9)
        .when((metric == "pressure") & (u == "inhg"), value * S.HPA_PER_INHG)
        .when((metric == "pressure") & (u == "kpa"), value * S.HPA_PER_KPA)
        .when((metric == "pressure") & (u == "mbar"), value)
        .when(u == lookup(metric, S.CANONICAL_UNIT), value)
    )


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def rejection(us: Column, source: Column, metric: Column, value: Column, unit: Column) -> Column:
    """The first reason, in the fixed order, for which a point is no valid measurement; null for a valid one."""
    return (
        F.when(metric.isNull() | source.isNull() | unit.isNull(), S.REASONS[0])
        .when(us.isNull(), S.REASONS[1])
        .when(~metric.isin(*S.METRICS), S.REASONS[2])
        .when(~is_finite(value), S.REASONS[3])
        .when(to_canonical(metric, unit, F.lit(1.0)).isNull(), S.REASONS[4])
        .when(F.trim(source) == "", S.REASONS[5])
    )


def is_valid(us: Column, source: Column, metric: Column, value: Column, unit: Column) -> Column:
    """Whether a point is a valid measurement."""
    return rejection(us, source, metric, value, unit).isNull()


def in_range(metric: Column, value: Column) -> Column:
    """Heart rate and steps within bounds, rmssd above zero up to its bound; other metrics have no gate."""
    out = F.lit(True)
    for m, (lo, hi) in S.RANGES.items():
        out = F.when(metric == m, (value > lo if m == "hrv_rmssd" else value >= lo) & (value <= hi)).otherwise(out)
    return out


def parse_number(text: Column) -> Column:
    """A strict decimal; null for words such as nan, for underscores and for numbers beyond double."""
    t = F.trim(text)
    number = F.when(t.rlike(NUMBER), t.try_cast("double"))
    return F.when(F.abs(number) != float("inf"), number)


def decimal_comma(text: Column, delimiter: Column) -> Column:
    """One comma and no dot is a decimal comma where columns are split by semicolons."""
    one = (F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))) == 1
    return F.when((delimiter == ";") & one & ~F.contains(text, F.lit(".")), F.replace(text, F.lit(","), F.lit("."))).otherwise(text)


def short_timestamp(text: Column) -> Column:
    """``MM/DD/YY HH:MM:SS`` with exactly two digits each, years 2000 to 2099, as a time without zone."""
    return F.when(text.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"), F.try_to_timestamp(F.concat(F.substr(text, F.lit(1), F.lit(6)), F.lit("20"), F.substr(text, F.lit(7))), F.lit("MM/dd/yyyy HH:mm:ss")).cast("timestamp_ntz"))


OFFSET = r"([Zz]|[+-][0-9]{2}(?::?[0-9]{2}(?::?[0-9]{2})?)?)"
ISO = rf"^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})(?:[Tt ]([0-9]{{2}})(?::?([0-9]{{2}})(?::?([0-9]{{2}})(?:[.,]([0-9]+))?)?)?{OFFSET}?)?$"
SENSOR_ISO = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[Tt]|\s+)([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]{1,6}))?)?\s*([Zz]|[+-][0-9]{2}:[0-9]{2})?$"
SENSOR_US = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\s+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?:\s*([AaPp])[Mm])?$"


def _offset_us(token: Column) -> Column:
    """Microseconds east of UTC of an offset as written; null for none, and for one that no place has."""
    part = lambda k: F.coalesce(F.regexp_extract(token, r"^[+-]([0-9]{2}):?([0-9]{2})?:?([0-9]{2})?$", k).try_cast("bigint"), F.lit(0))
    size = (part(1) * 3600 + part(2) * 60 + part(3)) * S.US
    signed = F.when(token.startswith("-"), -size).otherwise(size)
    return F.when(token.isin("Z", "z"), F.lit(0).cast("bigint")).when((token != "") & (part(2) < 60) & (part(3) < 60) & (size < 24 * S.HOUR), signed)


def _parts(wall: Column, token: Column) -> Column:
    """(wall, offset_us): a time as written; null where either can't be read."""
    both = F.struct(wall.alias("wall"), token.alias("token"), _offset_us(token).alias("offset_us"))
    return let(both, lambda x: F.when(x["wall"].isNotNull() & ((x["token"] == "") | x["offset_us"].isNotNull()), F.struct(x["wall"].alias("wall"), x["offset_us"].alias("offset_us"))))


def _wall(day: Column, hour: Column, minute: Column, second: Column, fraction: Column) -> Column:
    digits = lambda c: F.when(c == "", "00").otherwise(c)
    return F.concat(day, F.lit(" "), digits(hour), F.lit(":"), digits(minute), F.lit(":"), digits(second), F.lit("."), F.rpad(F.substring(fraction, 1, 6), 6, "0")).try_cast("timestamp_ntz")


def iso_parts(text: Column) -> Column:
    """(wall, offset_us) of an ISO date, with or without a time, with or without an offset; null for anything else."""
    t = F.trim(text)
    g = lambda k: F.regexp_extract(t, ISO, k)
    return F.when(t.rlike(ISO), _parts(_wall(g(1), g(2), g(3), g(4), g(5)), g(6)))


def has_time(text: Column) -> Column:
    """Whether an ISO text has a time of day."""
    return F.length(F.trim(text)) > 10


def sensor_parts(text: Column) -> Column:
    """(wall, offset_us) of ISO dates with a time, or month-first US dates with or without AM/PM; never day-first."""
    t = F.trim(text)
    i, u = (lambda k: F.regexp_extract(t, SENSOR_ISO, k)), (lambda k: F.regexp_extract(t, SENSOR_US, k))
    day = F.concat(u(3), F.lit("-"), F.lpad(u(1), 2, "0"), F.lit("-"), F.lpad(u(2), 2, "0"))
    hour, half = u(4).try_cast("int"), F.upper(u(7))
    of_day = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "P", 12).otherwise(0))
    us = _wall(day, F.lpad(of_day.cast("string"), 2, "0"), u(5), u(6), F.lit(""))
    return F.when(t.rlike(SENSOR_ISO), _parts(_wall(i(1), i(2), i(3), i(4), i(5)), i(6))).when(t.rlike(SENSOR_US), _parts(us, F.lit("")))


def sensor_timestamp(text: Column) -> Column:
    """The wall time of :func:`sensor_parts`."""
    return sensor_parts(text)["wall"]


def instant(parts: Column, zone: Column | str) -> Column:
    """The instant of (wall, offset_us): an offset that is written wins over the zone."""
    fixed = lambda p: F.timestamp_micros(F.unix_micros(p["wall"].cast("timestamp")) - p["offset_us"])
    return let(parts, lambda p: F.when(p["offset_us"].isNotNull(), fixed(p)).otherwise(localize(p["wall"], zone)))


def localize(wall: Column, zone: Column | str) -> Column:
    """Wall time to instant: an ambiguous time is the earlier instant, one in a gap moves forward by the gap."""
    return F.to_utc_timestamp(wall.cast("timestamp"), zone)


def in_gap(wall: Column, zone: Column | str) -> Column:
    """Whether the zone skips this wall time."""
    return F.from_utc_timestamp(localize(wall, zone), zone) != wall.cast("timestamp")


def is_ambiguous(wall: Column, zone: Column | str, widest_us: int = 2 * S.HOUR) -> Column:
    """Whether the zone has this wall time twice: some instant up to two hours later reads the same."""
    first = F.unix_micros(localize(wall, zone))
    later = [F.from_utc_timestamp(F.timestamp_micros(first + k), zone) == wall.cast("timestamp") for k in range(S.MINUTE * 30, widest_us + 1, S.MINUTE * 30)]
    return F.coalesce(F.array_contains(F.array(*later), True), F.lit(False))


def dst_adjustment(parts: Column, zone: Column | str) -> Column:
    """``nonexistent`` or ``ambiguous`` for a wall time that the zone skips or has twice; null for others and for written offsets."""
    plain = parts["offset_us"].isNull()
    return F.when(plain & in_gap(parts["wall"], zone), "nonexistent").when(plain & is_ambiguous(parts["wall"], zone), "ambiguous")


def stage_name(text: Column) -> Column:
    return F.coalesce(lookup(F.lower(F.trim(text)), S.STAGE_NAMES), F.lit("unknown"))


def sensor_id(base: Column, own: Column) -> Column:
    """``base:own``, or the base alone where the sensor has no id."""
    return F.concat_ws(":", base, F.nullif(F.trim(own), F.lit("")))


def replay_time(us: Column, start_us: Column, end_us: Column, target_s: int) -> Column:
    """Seconds into the compressed night; null outside of it."""
    return F.when((us >= start_us) & (us <= end_us), (us - start_us) * F.lit(target_s) / (end_us - start_us).cast("double"))


def compression_ratio(start_us: Column, end_us: Column, target_s: int) -> Column:
    """Seconds of the night to a second of the replay."""
    return (end_us - start_us) / F.lit(float(target_s * S.US))


def ratio_text(ratio: Column) -> Column:
    """With three decimals."""
    return F.format_string("%.3f", F.bround(ratio, 3))


def too_short(start_us: Column, end_us: Column, target_s: int) -> Column:
    """Whether a session isn't longer than its replay."""
    return end_us - start_us <= target_s * S.US


def target_duration(request: object = None, configured: object = None) -> int:
    """The replay's seconds: as requested, else as configured, else the default. A value that isn't allowed is an error, not passed over."""
    value = request if request is not None else configured if configured is not None else S.DEFAULT_TARGET_S
    if isinstance(value, bool) or not isinstance(value, int | float) or value not in S.TARGETS_S:
        raise ValueError(f"the target duration is one of {S.TARGETS_S} seconds, not {value!r}")
    return int(value)


def half_even_div(n: Column, d: Column) -> Column:
    """n / d to the nearest integer, ties to even, in whole numbers (n, d not negative)."""
    q = ((n - F.pmod(n, d)) / d).cast("bigint")
    twice = F.pmod(n, d) * 2
    return F.when((twice > d) | ((twice == d) & (F.pmod(q, F.lit(2)) == 1)), q + 1).otherwise(q)


def window_edge(i: Column, start_us: Column, end_us: Column, target_s: int) -> Column:
    """The start of window i of half a replay second; the one after the last is the end of the night."""
    n = int(target_s / S.WINDOW_S)
    whole = i.cast("bigint") * (end_us - start_us)
    return F.when(i >= n, end_us).otherwise(start_us + half_even_div(whole, F.lit(n).cast("bigint")))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Within the bounds; null stays null, which the functions below would otherwise skip."""
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def movement_intensity(mean_steps: Column) -> Column:
    return clamp(F.coalesce(mean_steps, F.lit(0.0)) / S.MOVEMENT_FULL)


def duration_magnitude(duration_us: Column, least_us: int) -> Column:
    return clamp(duration_us / (2.0 * least_us))


def normalized(value: Column, low: Column, high: Column) -> Column:
    return clamp((value - low) / (high - low))


def mapped_value(n: Column, metric: Column, sensitivity: Column) -> Column:
    """Sensitivity around the middle; pressure moves half as far."""
    return clamp(0.5 + sensitivity * (n - 0.5) * F.when(metric == "pressure", 0.5).otherwise(1.0))


def duration_text(us: Column) -> Column:
    """``7 h 05 min`` with the seconds left out."""
    m = F.floor(us / S.MINUTE).cast("bigint")
    return F.format_string("%d h %02d min", F.floor(m / 60).cast("bigint"), F.pmod(m, F.lit(60)))


def _spoken(hours: Column, minutes: Column, seconds: Column, some: Column) -> Column:
    h, m = F.when(hours > 0, F.concat(hours.cast("string"), F.lit(" h"))), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit(" min")))
    return F.concat_ws(" ", h, m, F.when(some | (hours == 0) & (minutes == 0), F.concat(seconds, F.lit(" s"))))


def spoken_duration(us: Column) -> Column:
    """``1 h 5 min 30 s``: to the nearest second, parts that are 0 left out."""
    total = half_even_div(us, F.lit(S.US).cast("bigint"))
    seconds = F.pmod(total, F.lit(60))
    return _spoken(F.floor(total / 3600).cast("bigint"), F.floor(F.pmod(total, F.lit(3600)) / 60).cast("bigint"), seconds.cast("string"), seconds > 0)


def elapsed_text(us: Column) -> Column:
    """``2 min 10 s`` or ``45.5 s``: seconds keep their fraction (six figures of it); nothing is below ``0 s``."""
    total = F.greatest(us, F.lit(0))
    rest = F.pmod(total, F.lit(S.MINUTE))
    seconds = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", rest / float(S.US)), "0+$", ""), r"\.$", "")
    return _spoken(F.floor(total / S.HOUR).cast("bigint"), F.floor(F.pmod(total, F.lit(S.HOUR)) / S.MINUTE).cast("bigint"), seconds, rest > 0)


def night_time(replay_s: Column, start_us: Column, ratio: Column) -> Column:
    """The instant of the night, in microseconds, at a place of the replay."""
    return start_us + F.round(replay_s * ratio * float(S.US)).cast("bigint")


def marker_percent(replay_s: Column, target_s: int) -> Column:
    """Where an event stands on a bar, in per cent."""
    return clamp(replay_s, 0.0, float(target_s)) / float(target_s) * 100


def add_elapsed(us: Column, seconds: Column) -> Column:
    """An instant, in microseconds, so many seconds later."""
    return us + F.round(seconds * float(S.US)).cast("bigint")


def display_time(us: Column, zone: Column | str) -> Column:
    """The wall time of an instant in the zone."""
    return F.from_utc_timestamp(F.timestamp_micros(us), zone).cast("timestamp_ntz")


def clock_label(us: Column, zone: str, text: Column) -> Column:
    return F.concat_ws(" ", F.date_format(F.from_utc_timestamp(F.timestamp_micros(us), zone), "HH:mm"), text)


def session_key(start_us: Column, end_us: Column) -> Column:
    stamp = lambda c: F.concat(F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return F.concat_ws("/", stamp(start_us), stamp(end_us))


def display_value(metric: Column, value: Column) -> Column:
    """Celsius as Fahrenheit and hPa as inHg, for display; other metrics as they are."""
    return F.when(metric == "temperature", value * 9 / 5 + 32).when(metric == "pressure", value / 33.8638866667).otherwise(value)
