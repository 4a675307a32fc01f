"""Scalar expressions: business numbers, missing markers, dates, periods, rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers that stand for a missing cell (compared trimmed, in lower case, under ten characters).
MISSING_MARKERS = ["na", "n/a", "nan", "null", "none", "nil", "#n/a", "#na", "#div/0!", "#value!", "#valeur!", "#ref!", "#num!", "#nombre!", "-", "--", "?", "missing", "inf", "-inf", "+inf", "infinity", "-infinity", "+infinity"]

#: The grammar of plain numbers.
NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"

#: Month and weekday labels.
MONTHS = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]
WEEKDAYS = ["lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche"]

SPACES = "[ \\u00A0\\u202F\\u2009\\t]"


def is_missing(c: Column) -> Column:
    """True for null, blank and the missing markers."""
    plain = F.lower(F.trim(c))
    return c.isNull() | (plain == "") | ((F.length(c) < 10) & plain.isin(MISSING_MARKERS))


def parse_num(c: Column) -> Column:
    """A text as number, or null: currency signs, thousands' blanks, a decimal comma and a closing percent sign are read
    over; the value is finite."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, SPACES, ""), "^[€$£]", ""), "[€$£%]$", "")
    dotted = F.when(F.locate(",", bare) > 0, F.concat(F.substring_index(bare, ",", 1), F.lit("."), F.substring(bare, F.locate(",", bare) + 1, F.lit(1 << 20)))).otherwise(bare)
    value = F.when(dotted.rlike(NUMBER), dotted.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def finite(c: Column) -> Column:
    """The value, or null where it is null, NaN or infinite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def _stamp(c: Column, pattern: str, y: int, m: int, d: int | None) -> Column:
    part = lambda k: F.regexp_extract(c, pattern, k).try_cast("int")
    year = part(y)
    day = F.lit(1) if d is None else part(d)
    hour, minute, second = (F.coalesce(part(k), F.lit(0)) for k in (4, 5, 6))
    made = F.try_make_timestamp_ntz(year, part(m), day, hour, minute, second.cast("decimal(16,6)"))
    return F.when(c.rlike(pattern) & year.between(1000, 2999), made)


#: Date patterns; the first is a prefix match.
ISO = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2}))?)?"
DMY = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2}))?)?$"
YMD = r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})()()()$"
YM = r"^(\d{4})-(\d{1,2})()()()()$"


def parse_date(c: Column) -> Column:
    """A text as timestamp without zone, or null: ISO, day/month/year, year/month/day, year-month; impossible dates are null."""
    t = F.trim(c)
    return F.coalesce(_stamp(t, ISO, 1, 2, 3), _stamp(t, DMY, 3, 2, 1), _stamp(t, YMD, 1, 2, 3), _stamp(t, YM, 1, 2, None))


def period_key(ts: Column, grain: str) -> Column:
    """Month, quarter or year of a timestamp as a running number."""
    if grain == "month":
        return F.year(ts).cast("long") * 12 + F.month(ts) - 1
    if grain == "quarter":
        return F.year(ts).cast("long") * 4 + F.quarter(ts) - 1
    if grain == "year":
        return F.year(ts).cast("long")
    raise ValueError(f"unknown grain {grain}")


def period_label(key: Column, grain: str) -> Column:
    if grain == "month":
        names = F.array(*(F.lit(m[:4] + ".") for m in MONTHS))
        return F.concat(F.element_at(names, (key % 12 + 1).cast("int")), F.lit(" "), F.floor(key / 12).cast("string"))
    if grain == "quarter":
        return F.concat(F.lit("T"), (key % 4 + 1).cast("string"), F.lit(" "), F.floor(key / 4).cast("string"))
    return key.cast("string")


def significant(c: Column, digits: int = 7) -> Column:
    """Rounded to significant digits."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c * scale) / scale)


def nice_step(x: float) -> float:
    """The next of 1, 2, 5, 10 times a power of ten."""
    if not x > 0:
        return 1.0
    p = 10.0 ** math.floor(math.log10(x))
    return next((k * p for k in (1, 2, 5) if x <= k * p), 10 * p)


def clamp(x: float, low: float, high: float) -> float:
    return max(low, min(high, x))
