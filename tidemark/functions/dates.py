"""Date columns: harmonising string dates, ages, UTC days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# The accepted non-ISO shapes, tried in this order. Each has a guard because
# Spark patterns are more lenient about surrounding text than the shapes are meant to be.
FORMATS = (
    ("iso_datetime", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d'T'H:m:s"),
    ("space_datetime", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
    ("rfc_offset", r"^\d{1,2} [A-Z][a-z]{2} \d{4} \d{1,2}:\d{1,2}:\d{1,2} [+-]\d{4}$", "d MMM yyyy H:m:s xx"),
    ("rfc_zone", r"^\d{1,2} [A-Z][a-z]{2} \d{4} \d{1,2}:\d{1,2}:\d{1,2} (GMT|UTC|Z)$", "d MMM yyyy H:m:s z"),
    ("day_month_year", r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    ("loose_day", r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    ("us_day", r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    ("us_month", r"^\d{1,2}/\d{4}$", "M/yyyy"),
    ("slash_day", r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    ("long_month", r"^[A-Z][a-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    ("short_month", r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    ("year", r"^\d{4}$", "yyyy"),
)

_CLOCK = r"(?:[T ]\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d{1,9})?)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?"
_ISO = r"^\d{4}-\d{2}-\d{2}" + _CLOCK + "$"
_COMPACT = r"^\d{8}" + _CLOCK + "$"
_WEEKDAY = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), (?=\d{1,2} [A-Z][a-z]{2} \d{4} )"


def _iso(text: Column) -> Column:
    """ISO 8601 date with optional clock and offset, both in long or compact spelling."""
    day = F.regexp_extract(text, r"^(\d{4})-?(\d{2})-?(\d{2})", 0)
    day = F.regexp_replace(day, r"^(\d{4})-?(\d{2})-?(\d{2})$", "$1-$2-$3")
    rest = F.regexp_extract(text, r"^(?:\d{4}-\d{2}-\d{2}|\d{8})[T ](.*)$", 1)
    clock = F.regexp_extract(rest, r"^[\d:.,]+", 0)
    zone = F.regexp_extract(rest, r"(Z|[+-]\d{2}:?(?:\d{2})?)$", 1)
    hour = F.regexp_extract(clock, r"^(\d{2})", 1)
    minute = F.regexp_extract(clock, r"^\d{2}:?(\d{2})", 1)
    second = F.regexp_extract(clock, r"^\d{2}:?\d{2}:?(\d{2})", 1)
    fraction = F.substring(F.regexp_extract(clock, r"[.,](\d+)$", 1), 1, 6)

    def padded(part: Column) -> Column:
        return F.when(part == "", F.lit("00")).otherwise(part)

    digits = F.regexp_replace(zone, ":", "")
    offset = F.when(zone.isin("", "Z"), F.lit("+00:00")).otherwise(
        F.concat(F.substring(digits, 1, 3), F.lit(":"), F.rpad(F.substring(digits, 4, 2), 2, "0"))
    )
    spelled = F.concat(
        day, F.lit("T"), padded(hour), F.lit(":"), padded(minute), F.lit(":"), padded(second),
        F.when(fraction == "", F.lit("")).otherwise(F.concat(F.lit("."), fraction)), offset,
    )
    return F.when(text.rlike(_ISO) | text.rlike(_COMPACT), F.try_to_timestamp(spelled))


def _iso_week(text: Column) -> Column:
    """ISO week date ``yyyy-Www`` or ``yyyy-Www-d``."""
    pattern = r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?$"
    year = F.regexp_extract(text, pattern, 1).try_cast("int")
    week = F.regexp_extract(text, pattern, 2).try_cast("int")
    day = F.coalesce(F.regexp_extract(text, pattern, 3).try_cast("int"), F.lit(1))
    monday = F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date")
    when = F.date_add(monday, (week - 1) * 7 + day - 1)
    in_year = (week >= 1) & (week <= F.weekofyear(F.make_date(year, F.lit(12), F.lit(28))))
    return F.when(text.rlike(pattern) & in_year, when.cast("timestamp"))


def _candidates(text: Column) -> list[tuple[str, Column]]:
    trimmed = F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))
    plain = F.regexp_replace(trimmed, _WEEKDAY, "")
    found = [("iso", _iso(trimmed)), ("iso_week", _iso_week(trimmed))]
    for name, guard, fmt in FORMATS:
        subject = plain if name.startswith("rfc") else trimmed
        found.append((name, F.when(subject.rlike(guard), F.try_to_timestamp(subject, F.lit(fmt)))))
    return found


def _named(name: str):
    return lambda v: F.when(v.isNotNull(), F.struct(F.lit(name).alias("format"), v.alias("value")))


def parsed_date(text: Column) -> Column:
    """``struct<format, value>`` of a string date of any accepted shape; NULL when unreadable."""
    return F.coalesce(
        *[
            let(value, _named(name)) for name, value in _candidates(text)
        ]
    )


def parse_datetime(text: Column) -> Column:
    """String date of any accepted shape to a UTC timestamp; NULL when unreadable.

    A date without offset is UTC, so the session time zone must be UTC.
    """
    return F.coalesce(*[value for _, value in _candidates(text)])


def age_hours(now: Column, moment: Column) -> Column:
    """Hours from ``moment`` to ``now``, never negative; NULL without a moment."""
    hours = F.timestamp_diff("MICROSECOND", moment, now) / F.lit(3.6e9)
    return F.when(hours < 0, F.lit(0.0)).otherwise(hours)


def day_key(moment: Column) -> Column:
    """UTC day as ``yyyy-MM-dd``."""
    return F.date_format(moment, "yyyy-MM-dd")


def hours_before(now: Column, hours) -> Column:
    """``now`` minus a number of hours (number or column)."""
    hours = hours if isinstance(hours, Column) else F.lit(float(hours))
    return F.timestamp_add("MICROSECOND", -(hours * F.lit(3.6e9)).cast("bigint"), now)
