"""Dates, instants, times of day and 96-bit timestamps, as column expressions.

Instants before 1970 are floored, not cut toward zero. Times of day are nanoseconds since midnight in a long.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

JULIAN_EPOCH = 2440588
DAY_US = 86_400_000_000
NANOS = {"NANOS": 1, "MICROS": 1_000, "MILLIS": 1_000_000, "SECONDS": 1_000_000_000}
DAY = 86_400 * NANOS["SECONDS"]


def _long(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("long")


def _floor_div(a: Column, b: int) -> Column:
    """Of longs, without a detour over doubles."""
    return F.call_function("div", a - F.pmod(a, F.lit(b).cast("long")), F.lit(b).cast("long"))


# 96-bit timestamps


def int96_parts(ts: Column) -> tuple[Column, Column]:
    """The Julian day and the nanoseconds of the day of a timestamp (UTC)."""
    us = F.unix_micros(ts.cast("timestamp"))
    return (_floor_div(us, DAY_US) + JULIAN_EPOCH).cast("int"), F.pmod(us, F.lit(DAY_US).cast("long")) * 1000


def _little_endian(x: Column, digits: int) -> Column:
    """A number as bytes, the lowest first."""
    text = F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(text, 17 - 2 * (k + 1), 2) for k in range(digits)]))


def timestamp_to_int96(ts: Column) -> Column:
    """The 12 bytes: nanoseconds of the day, then the Julian day."""
    day, nanos = int96_parts(ts)
    return F.concat(_little_endian(nanos, 8), _little_endian(day, 4))


def int96_to_timestamp(b: Column) -> Column:
    """The timestamp of 12 bytes, to the microsecond; null for any other length."""
    def number(first: int, n: int) -> Column:
        return F.conv(F.concat(*[F.hex(F.substring(b, first + n - 1 - k, 1)) for k in range(n)]), 16, 10).cast("decimal(20,0)").cast("long")

    us = (number(9, 4) - JULIAN_EPOCH) * F.lit(DAY_US) + _floor_div(number(1, 8), 1000)
    return F.when(F.octet_length(b) == 12, F.timestamp_micros(us))


def is_after_epoch(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) > 0


# dates and instants


def date_to_days(d: Column) -> Column:
    return F.unix_date(d.cast("date"))


def days_to_date(n: Column) -> Column:
    return F.date_from_unix_date(n.cast("int"))


def timestamp_to_unit(ts: Column, unit: str) -> Column:
    """Units since the epoch: MILLIS, MICROS or NANOS."""
    us = F.unix_micros(ts.cast("timestamp"))
    return us * 1000 if unit == "NANOS" else us if unit == "MICROS" else _floor_div(us, 1000)


def unit_to_timestamp(n: Column, unit: str, utc: bool = True) -> Column:
    """A timestamp, or a local one without a zone. Nanoseconds lose what is below a microsecond."""
    us = _long(n) * 1000 if unit == "MILLIS" else _long(n) if unit == "MICROS" else _floor_div(_long(n), 1000)
    ts = F.timestamp_micros(us)
    return ts if utc else ts.cast("timestamp_ntz")


def guess_unix(n: Column) -> Column:
    """A timestamp from a number of seconds, milliseconds, microseconds or nanoseconds, by its digits: up to 10, 13, 16, 19."""
    x = _long(n)
    digits = F.length(F.abs(x.cast("decimal(20,0)")).cast("string"))
    us = F.when(digits <= 10, x * 1_000_000).when(digits <= 13, x * 1000).when(digits <= 16, x).otherwise(_floor_div(x, 1000))
    return F.timestamp_micros(us)


#: Forms of text that parse_any reads, beside ISO 8601; a weekday before them is passed over.
FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "M/d/yyyy HH:mm:ss", "M/d/yyyy", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy", "yyyyMMddHHmmss", "yyyyMMdd",
    "MMM d, yyyy HH:mm:ss", "MMM d, yyyy", "MMMM d, yyyy HH:mm:ss", "MMMM d, yyyy", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "d MMMM yyyy HH:mm:ss", "d MMMM yyyy", "MMM d HH:mm:ss yyyy",
)


def _shape(form: str) -> str:
    """What a text in a format must look like at least: parsing one in vain costs an exception."""
    kinds = {"X": ".+", "z": ".+", "Z": ".+"}
    tokens = re.findall(r"'([^']*)'|(([A-Za-z])\3*)|(.)", form)
    parts = [re.escape(literal) if literal else re.escape(sign) if sign else r"[^\d\s]+" if run in ("MMM", "MMMM") else kinds.get(letter, r"[+-]?\d+") for literal, run, letter, sign in tokens]
    return "(?is)^" + "".join(parts) + "$"


def parse_any(s: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """A timestamp from text in one of the formats, or from the digits of a Unix time (10, 13, 16 or 19 of them); null if none fits."""
    text = F.regexp_replace(F.regexp_replace(F.trim(s), r"^(?i)(mon|tues?|wed(nes)?|thu(rs)?|fri|sat(ur)?|sun)(day)?,?\s+", ""), r"\s+", " ")

    def parsed(text: Column) -> Column:
        unix = F.when(text.rlike(r"^\d{10}$|^\d{13}$|^\d{16}$|^\d{19}$"), guess_unix(text.try_cast("long")))
        return F.coalesce(unix, *[F.when(text.rlike(_shape(f)), F.try_to_timestamp(text, F.lit(f))) for f in formats], F.try_to_timestamp(text))

    return F.element_at(F.transform(F.array(text), parsed), 1)  # the text is made once, not for each format


# times of day


def make_time(h: Column, m: Column, s: Column, ns: Column | int = 0) -> Column:
    """A time of day; a part out of its range fails the query."""
    n = F.lit(ns) if isinstance(ns, int) else ns
    ok = h.between(0, 23) & m.between(0, 59) & s.between(0, 59) & n.between(0, NANOS["SECONDS"] - 1)
    return F.when(ok, _long(h) * 3600 * NANOS["SECONDS"] + _long(m) * 60 * NANOS["SECONDS"] + _long(s) * NANOS["SECONDS"] + _long(n)).otherwise(F.raise_error(F.concat_ws(":", F.lit("no time of day"), h, m, s, n)).cast("long"))


def time_from(n: Column, unit: str) -> Column:
    return _long(n) * NANOS[unit]


def time_to(t: Column, unit: str) -> Column:
    return _floor_div(_long(t), NANOS[unit])


def time_part(t: Column, part: str) -> Column:
    """hour, minute, second; millisecond, microsecond, nanosecond of the second."""
    size, count = {"hour": (3600 * 10**9, 24), "minute": (60 * 10**9, 60), "second": (10**9, 60), "millisecond": (10**6, 1000), "microsecond": (10**3, 10**6), "nanosecond": (1, 10**9)}[part]
    return F.pmod(_floor_div(_long(t), size), F.lit(count).cast("long")).cast("int")


def time_string(t: Column) -> Column:
    """HH:MM:SS, and nine more digits if there is a fraction."""
    ns = time_part(t, "nanosecond")
    base = F.format_string("%02d:%02d:%02d", time_part(t, "hour"), time_part(t, "minute"), time_part(t, "second"))
    return F.when(ns == 0, base).otherwise(F.concat(base, F.format_string(".%09d", ns)))


def time_of(ts: Column) -> Column:
    """The time of day of a timestamp (UTC)."""
    return F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(DAY_US).cast("long")) * 1000


def on_that_day(t: Column, day: Column, utc: bool = True) -> Column:
    """The timestamp of a time on a day, to the microsecond."""
    us = F.unix_date(day.cast("date")).cast("long") * F.lit(DAY_US) + _floor_div(_long(t), 1000)
    ts = F.timestamp_micros(us)
    return ts if utc else ts.cast("timestamp_ntz")


def today(t: Column) -> Column:
    return on_that_day(t, F.current_date())


def spark_time(t: Column) -> Column:
    """As Spark's own TIME type (spark.sql.timeType.enabled), to the microsecond."""
    return F.make_time(time_part(t, "hour"), time_part(t, "minute"), (F.pmod(_floor_div(_long(t), 1000), F.lit(60_000_000).cast("long")) / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(16,6)"))


def interval_parts(b: Column) -> tuple[Column, Column, Column]:
    """Months, days and milliseconds of the 12 bytes of an interval."""
    def number(first: int) -> Column:
        return F.conv(F.concat(*[F.hex(F.substring(b, first + 3 - k, 1)) for k in range(4)]), 16, 10).cast("long")

    return number(1), number(5), number(9)
