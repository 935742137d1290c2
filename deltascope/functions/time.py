"""Dates written as text, and bucketing of a time column into comparable periods."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, functions as F

from deltascope.functions.text import once, strip

# How dates arrive as text: a gate for the day, then the formats to try in order behind it.
# The gate means that a value is handed to one parser instead of failing through all of
# them. Month-first wins where day and month are ambiguous. A clock time may follow.
DAY_SHAPES = (
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ("M/d/yyyy", "d/M/yyyy")),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", ("M/d/yy", "d/M/yy")),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ("M-d-yyyy", "d-M-yyyy")),
    (r"^\d{1,2}-\d{1,2}-\d{2}$", ("M-d-yy", "d-M-yy")),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", ("M.d.yyyy", "d.M.yyyy")),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", ("yyyy/M/d",)),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", ("yyyy-M-d",)),
    # spaces, hyphens and slashes around a month's name are made hyphens first
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", ("d-MMM-yyyy",)),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{2}$", ("d-MMM-yy",)),
    (r"^\d{1,2}-[A-Za-z]{4,}-\d{4}$", ("d-MMMM-yyyy",)),
    (r"^[A-Za-z]{3}-\d{1,2}-\d{4}$", ("MMM-d-yyyy",)),
    (r"^[A-Za-z]{4,}-\d{1,2}-\d{4}$", ("MMMM-d-yyyy",)),
)
# these have no clock time
DATE_ONLY = (
    (r"^(19|20)\d{2}(0[1-9]|1[0-2])\d{2}$", ("yyyyMMdd",)),
    (r"^\d{4}-\d{2}$", ("yyyy-MM",)),
    (r"^[A-Za-z]{3}-\d{4}$", ("MMM-yyyy",)),
    (r"^[A-Za-z]{4,}-\d{4}$", ("MMMM-yyyy",)),
)
CLOCK = r" (\d{1,2}):(\d{2})(?::(\d{2}))?(?: ?([AaPp][Mm]))?$"
# a day of the week before a date says nothing more about it
WEEKDAY = r"^(?i:mon|tues?|wed|thu|thurs?|fri|sat|sun|monday|tuesday|wednesday|thursday|friday|saturday|sunday),? +"
# what every one of them begins like; most other text is told apart by this alone
MAYBE_DATE = r"^(\d{1,4}[-/. ]|\d{8}$|[A-Za-z]{3,},? [A-Za-z]{0,9} ?\d)"
ISO_GATE = r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{2}.*)?$"


def parse_dates(column: Column) -> Column:
    """Date text in mixed formats to timestamp, null where nothing fits.

    A bare year is left alone on purpose: it is a year axis, not a date.
    """
    return parse_trimmed_dates(strip(column))


def parse_trimmed_dates(text: Column) -> Column:
    # the steps behind the gate share a value, so the plan stays small
    return F.when(text.rlike(MAYBE_DATE), once(F.regexp_replace(text, WEEKDAY, ""), _dated))


def _dated(text: Column) -> Column:
    iso = F.when(text.rlike(ISO_GATE), text.try_cast("timestamp"))  # the cast takes all ISO 8601 forms
    day = F.regexp_replace(F.regexp_replace(text, CLOCK, ""), r"(?<=[A-Za-z])(, | |/)|( |/)(?=[A-Za-z])|(?<=[A-Za-z] \d{1,2}|[A-Za-z]-\d{1,2}),? ", "-")
    seconds = once(
        F.struct(*[F.regexp_extract(text, CLOCK, k).alias(n) for k, n in enumerate(("h", "m", "s", "half"), 1)]), _seconds
    )
    return F.coalesce(iso, once(day, lambda d: _shaped(d, DAY_SHAPES)) + F.make_dt_interval(secs=seconds),
                      once(day, lambda d: F.when(~text.rlike(CLOCK), _shaped(d, DATE_ONLY))))


def _shaped(day: Column, shapes) -> Column:
    parsed = None
    for gate, patterns in shapes:
        attempts = [F.try_to_timestamp(day, F.lit(p)) for p in patterns]
        found = attempts[0] if len(attempts) == 1 else F.coalesce(*attempts)
        if "yyyy" not in patterns[0]:
            # two digits from 69 on are of the last century
            found = once(found, lambda t: F.when(F.year(t) >= 2069, t - F.make_ym_interval(F.lit(100))).otherwise(t))
        parsed = F.when(day.rlike(gate), found) if parsed is None else parsed.when(day.rlike(gate), found)
    return parsed


def _seconds(clock: Column) -> Column:
    """Seconds since midnight; 0 without a clock time, null for one that no clock shows."""
    hour, minute, second = (F.coalesce(clock[n].try_cast("int"), F.lit(0)) for n in ("h", "m", "s"))
    half = F.lower(clock["half"])
    fits = (minute < 60) & (second < 60) & F.when(half == "", hour < 24).otherwise(hour.between(1, 12))
    hour = F.when(half == "", hour).otherwise(hour % 12 + F.when(half == "pm", 12).otherwise(0))
    return F.when(clock["h"] == "", 0).when(fits, 3600 * hour + 60 * minute + second).cast("decimal(18, 6)")


MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
# unit: format of the label, seconds of units shorter than a day
UNITS = {
    "Y": ("yyyy", 0),
    "Q": ("yyyy'Q'q", 0),
    "M": ("yyyy-MM", 0),
    "W": ("yyyy-MM-dd", 0),
    "D": ("yyyy-MM-dd", 0),
    "H": ("yyyy-MM-dd HH:00", 3600),
    "MIN": ("yyyy-MM-dd HH:mm", 60),
    "S": ("yyyy-MM-dd HH:mm:ss", 1),
}
PARSE = {"H": "%Y-%m-%d %H:00", "MIN": "%Y-%m-%d %H:%M", "S": "%Y-%m-%d %H:%M:%S"}
ALIASES = {"A": "Y", "YE": "Y", "QE": "Q", "ME": "M", "T": "MIN"}


@dataclass(frozen=True)
class Frequency:
    """A unit of time, how many of them make a period, and where the calendar is anchored.

    `last` is the month that ends the year (`Y`, `Q`), from 1, or the weekday that ends the
    week (`W`), from 0 for Monday. Periods of hours and less count from the Unix epoch, so
    those that divide a day begin at midnight.
    """

    unit: str
    count: int = 1
    last: int = 12

    @property
    def ahead(self) -> int:
        """Months from a date to the one whose calendar year is its fiscal year."""
        return 12 - self.last

    @property
    def shift(self) -> int:
        """How much later than the calendar's a period begins: months, or days of a week."""
        return {"Y": self.last % 12, "Q": self.last % 3, "W": (self.last + 1) % 7}.get(self.unit, 0)

    @property
    def seconds(self) -> int:
        return UNITS[self.unit][1] * self.count

    def __str__(self) -> str:
        anchor = ""
        if self.unit in "YQ" and self.last != 12:
            anchor = "-" + MONTHS[self.last - 1]
        elif self.unit == "W" and self.last != 6:
            anchor = "-" + WEEKDAYS[self.last]
        return f"{self.count if self.count > 1 else ''}{self.unit}{anchor}"


@lru_cache(maxsize=64)
def parse_frequency(freq: str) -> Frequency:
    """`M`, `W-SAT` (weeks that end on Saturday), `Y-JUN` and `Q-JUN` (years that end in June),
    `15min`, `2H` and the like."""
    found = re.fullmatch(r"(\d*)([A-Z]+)(?:-([A-Z]{3}))?", freq.upper())
    count, unit, anchor = (found[1] or "1", ALIASES.get(found[2], found[2]), found[3]) if found else ("1", "", None)
    anchors = MONTHS if unit in ("Y", "Q") else WEEKDAYS if unit == "W" else ()
    if unit not in UNITS or int(count) < 1 or (int(count) > 1 and not UNITS[unit][1]) or (anchor and anchor not in anchors):
        raise ValueError(
            f"Unknown frequency {freq!r}; use one of {', '.join(UNITS)}, a year or quarter with its last month (Y-JUN),"
            " a week with its last day (W-SAT), or a number of hours, minutes or seconds (15MIN)."
        )
    last = (anchors.index(anchor) if anchor else len(anchors) - 1) + (anchors is MONTHS) if anchors else 12
    return Frequency(unit, int(count), last)


def frequency(freq: str) -> str:
    """The one spelling of a frequency."""
    return str(parse_frequency(freq))


def period_start(column: Column, freq: str) -> Column:
    """First day (or instant) of the period. A plain date is a four-byte grouping key, so
    aggregates group on this and labels are formatted once per period, not once per row."""
    f = parse_frequency(freq)
    if f.seconds:
        if f.count == 1 and f.unit == "H":
            return F.date_trunc("HOUR", column)
        return F.timestamp_seconds(F.floor(F.unix_seconds(column.cast("timestamp")) / f.seconds) * f.seconds)
    day = column.cast("date")
    if f.unit == "D":
        return day
    if f.unit == "W":
        return F.date_add(F.trunc(F.date_sub(day, f.shift), "WEEK"), f.shift) if f.shift else F.trunc(day, "WEEK")
    name = {"Y": "YEAR", "Q": "QUARTER", "M": "MONTH"}[f.unit]
    return F.add_months(F.trunc(F.add_months(day, -f.shift), name), f.shift) if f.shift else F.trunc(day, name)


def period_label(start: Column, freq: str) -> Column:
    """A fiscal year is named by the calendar year it ends in."""
    f = parse_frequency(freq)
    named = F.add_months(start, f.ahead) if f.unit in ("Y", "Q") and f.ahead else start
    label = F.date_format(named, UNITS[f.unit][0])
    if f.unit == "W":
        return F.concat_ws("/", label, F.date_format(F.date_add(start, 6), "yyyy-MM-dd"))
    return label


def period_of(column: Column, freq: str = "M") -> Column:
    """Period label of a date or timestamp column."""
    return period_label(period_start(column, freq), freq)


def year_label(column: Column) -> Column:
    """Period label of a whole-number column, stored as a number or as text."""
    return column.cast("bigint").cast("string")


def period_bounds(label: str, freq: str) -> tuple[dt.datetime, dt.datetime] | None:
    """First instant of a labelled period and of the one after; None for a malformed label.

    Comparing a raw column with these two values is what lets a period filter reach the
    file scan; a comparison on the label itself would not.
    """
    f = parse_frequency(freq)
    try:
        if f.unit == "Y":
            return _months(int(label), 1 - f.ahead, 12) if re.fullmatch(r"\d{4}", label) else None
        if f.unit == "Q":
            match = re.fullmatch(r"(\d{4})Q([1-4])", label)
            return match and _months(int(match[1]), 3 * int(match[2]) - 2 - f.ahead, 3)
        if f.unit == "M":
            match = re.fullmatch(r"(\d{4})-(\d{2})", label)
            return match and 1 <= int(match[2]) <= 12 and _months(int(match[1]), int(match[2]), 1) or None
        if f.unit == "W":
            match = re.fullmatch(r"(\d{4}-\d{2}-\d{2})/\d{4}-\d{2}-\d{2}", label)
            if match is None:
                return None
            first = dt.datetime.fromisoformat(match[1])
            return (first, first + dt.timedelta(days=7)) if first.weekday() == f.shift else None
        if f.unit == "D":
            day = dt.datetime.strptime(label, "%Y-%m-%d")
            return day, day + dt.timedelta(days=1)
        instant = dt.datetime.strptime(label, PARSE[f.unit])
        if (instant - dt.datetime(1970, 1, 1)) % dt.timedelta(seconds=f.seconds):
            return None
        return instant, instant + dt.timedelta(seconds=f.seconds)
    except ValueError:
        return None


def _months(year: int, month: int, count: int) -> tuple[dt.datetime, dt.datetime]:
    """From the first of a month, counted on from January of a year, for so many months."""
    ends = [year * 12 + month - 1 + k for k in (0, count)]
    first, after = (dt.datetime(n // 12, n % 12 + 1, 1) for n in ends)
    return first, after
