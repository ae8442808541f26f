"""Timestamps without zone and durations, with Python's rounding rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: strptime codes and the Spark pattern letters for them.
CODES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%p": "a", "%I": "hh"}
PARTS = ("year", "month", "day", "hour", "minute", "second")


def pattern(fmt: str) -> str:
    """A strptime format as a Spark datetime pattern; other letters are quoted."""
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%":
            out, i = out + CODES[fmt[i : i + 2]], i + 2
        else:
            out, i = out + (f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]), i + 1
    return out


def now() -> Column:
    return F.localtimestamp()


def from_timestamp(seconds: Column) -> Column:
    """Seconds since 1970 as a local timestamp of the session's zone."""
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def from_components(year, month, day, hour=0, minute=0, second=0) -> Column:
    c = [x if isinstance(x, Column) else F.lit(x) for x in (year, month, day, hour, minute, second)]
    return F.make_timestamp_ntz(*c)


def from_string(text: Column, fmt: str = "%Y-%m-%d %H:%M:%S") -> Column:
    """Raises on text that does not fit the format."""
    return F.to_timestamp_ntz(text, F.lit(pattern(fmt)))


def parse_or_null(text: Column, fmt: str | None = None) -> Column:
    """Like from_string, but null where the text does not fit."""
    out = F.try_to_timestamp(text, F.lit(pattern(fmt))) if fmt else F.try_to_timestamp(text)
    return out.cast("timestamp_ntz")


def part(ts: Column, name: str) -> Column:
    return getattr(F, {"day": "dayofmonth"}.get(name, name))(ts)


def replace(ts: Column, **parts: int) -> Column:
    """The timestamp with the given parts replaced; -1 keeps a part. Fractions of a second are dropped."""
    c = [F.lit(parts[p]) if parts.get(p, -1) != -1 else part(ts, p) for p in PARTS]
    return F.make_timestamp_ntz(*c)


def to_text(ts: Column, fmt: str = "%Y-%m-%d %H:%M:%S") -> Column:
    return F.date_format(ts, pattern(fmt))


def between(a: Column, b: Column) -> Column:
    """a - b as a day-time interval."""
    return a - b


def seconds(n) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n if isinstance(n, Column) else F.lit(n))


def _micros(delta: Column) -> Column:
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.expr("unix_micros(timestamp '1970-01-01 00:00:00+00:00')") + F.unix_micros((start + delta).cast("timestamp")) - F.unix_micros(start.cast("timestamp"))


def total_seconds(delta: Column) -> Column:
    """Whole seconds, rounded towards 0."""
    m = _micros(delta)
    return F.when(m < 0, -F.floor(-m / 1_000_000)).otherwise(F.floor(m / 1_000_000)).cast("long")


def days(delta: Column) -> Column:
    """Whole days, rounded down, as Python's timedelta has them."""
    return F.floor(_micros(delta) / 86_400_000_000).cast("long")


def years(delta: Column) -> Column:
    return F.floor(days(delta) / 365).cast("long")


def months(delta: Column) -> Column:
    return F.floor(days(delta) / 30).cast("long")


def _in_day(delta: Column) -> Column:
    return F.pmod(F.floor(_micros(delta) / 1_000_000), F.lit(86_400))


def hours(delta: Column) -> Column:
    """Hours beyond whole days."""
    return F.floor(_in_day(delta) / 3600).cast("long")


def minutes(delta: Column) -> Column:
    """Minutes beyond whole days, 0 to 1439."""
    return F.floor(_in_day(delta) / 60).cast("long")


def month_label(ts: Column, missing: str = "Sem data") -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit(missing))


def event_time(nanoseconds: Column) -> Column:
    """Nanoseconds since 1970 as a timestamp of microseconds."""
    return F.timestamp_micros(F.call_function("div", nanoseconds, F.lit(1000)))


def plus_days(date: Column, n) -> Column:
    return F.date_add(date, n)
