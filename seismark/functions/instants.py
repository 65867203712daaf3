"""Calendar and clock components out of free date text, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month names by their first three letters.
MONTH_NUMBERS = {"JAN": 1, "FEB": 2, "MAR": 3, "APR": 4, "MAY": 5, "JUN": 6, "JUL": 7, "AUG": 8, "SEP": 9, "OCT": 10, "NOV": 11, "DEC": 12}

# Offsets in minutes of zone abbreviations that mean one thing in any news text.
UNIVERSAL_ZONES = {"Z": 0, "UTC": 0, "UT": 0, "GMT": 0}

_WEEKDAY = r"(?:(?:MON|TUE|WED|THU|FRI|SAT|SUN)[A-Z]*\.?,?\s+)?"
_ZONE = r"((?:UTC|GMT)?\s*[+-]\d{2}(?::?\d{2})?|[A-Z]{1,5})"
_CLOCK = r"(?:(?:\s*,?\s*(?:AT\s+)?|\s*T\s*)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d{1,9})?)?(?:\s*([AP])\.?M\.?)?(?:\s*" + _ZONE + r")?)?"
_ORDINAL = r"(?:ST|ND|RD|TH)?"
_MONTH = r"((?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]{0,6})\.?"

# Each notation: its name, its pattern, and the order of its groups as
# year, month, day, hour, minute, second, half of the day, zone.
_NOTATIONS = (
    ("ymd", rf"^{_WEEKDAY}(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}}){_CLOCK}$", "$1|$3|$4|$5|$6|$7|$8|$9"),
    ("numeric", rf"^{_WEEKDAY}(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}}){_CLOCK}$", "$4|$3|$1|$5|$6|$7|$8|$9"),
    ("named_dmy", rf"^{_WEEKDAY}(\d{{1,2}}){_ORDINAL}[-\s]+(?:OF\s+)?{_MONTH},?[-\s]+(\d{{4}}){_CLOCK}$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    ("named_mdy", rf"^{_WEEKDAY}{_MONTH}\s+(\d{{1,2}}){_ORDINAL},?\s+(\d{{4}}){_CLOCK}$", "$3|$1|$2|$4|$5|$6|$7|$8"),
    ("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[T ]?(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,]\d{{1,9}})?\s*{_ZONE}?)?$", "$1|$2|$3|$4|$5|$6||$7"),
)


def date_components(text: Column) -> Column:
    """Array of notation, year, month, day, hour, minute, second, half of the day and zone; null if no notation fits.

    ``numeric`` holds the first number as day and the second as month; which of the two orders is meant is for
    the caller to settle. Bare counts give the notation ``epoch`` with the seconds in the place of the year.
    """
    value = F.upper(F.trim(F.regexp_replace(text, r"\s+", " ")))
    parts = F.when(value.rlike(r"^-?\d{9,10}$"), F.concat(F.lit("epoch|"), value, F.lit("|||||||")))
    parts = parts.when(value.rlike(r"^-?\d{13}$"), F.concat(F.lit("epoch|"), F.floor(value.try_cast("bigint") / 1000).cast("string"), F.lit("|||||||")))
    for name, pattern, order in _NOTATIONS:
        parts = parts.when(value.rlike(pattern), F.regexp_replace(value, pattern, f"{name}|{order}"))
    return F.split(parts, r"\|", -1)


def number_at(parts: Column, position: int) -> Column:
    """The integer at a position of ``date_components``; null where the text has none."""
    return F.get(parts, F.lit(position)).try_cast("int")


def month_number(parts: Column, position: int) -> Column:
    """A month given as digits or as an English name."""
    text = F.get(parts, F.lit(position))
    names = F.create_map(*[F.lit(x) for pair in MONTH_NUMBERS.items() for x in pair])
    return F.coalesce(text.try_cast("int"), names[F.substring(text, 1, 3)])


def zone_offset_seconds(zone: Column) -> Column:
    """Seconds east of UTC of ``Z``, ``UTC``, ``GMT`` and numeric offsets; null for other abbreviations."""
    digits = F.regexp_replace(F.regexp_replace(zone, r"^(?:UTC|GMT)\s*(?=[+-])", ""), ":", "")
    sign = F.when(digits.startswith("-"), -1).otherwise(1)
    hours, minutes = F.substring(digits, 2, 2).try_cast("int"), F.coalesce(F.nullif(F.substring(digits, 4, 2), F.lit("")).try_cast("int"), F.lit(0))
    universal = F.create_map(*[F.lit(x) for k, v in UNIVERSAL_ZONES.items() for x in (k, v * 60)])
    return F.when(digits.rlike(r"^[+-]\d{2}(\d{2})?$"), sign * (hours * 3600 + minutes * 60)).otherwise(universal[zone])


def wall_seconds(year: Column, month: Column, day: Column, second_of_day: Column) -> Column:
    """Seconds from 1970-01-01 00:00 on the same wall clock; null where there is no such calendar day."""
    month_start = F.when(month.between(1, 12) & year.between(1, 9999), F.make_date(year, month, F.lit(1)))
    exists = day.between(1, F.dayofmonth(F.last_day(month_start)))
    return F.when(exists, (F.unix_date(month_start).cast("bigint") + day - 1) * 86400 + second_of_day)
