"""Scalar expressions, all built-in Spark functions (JVM side, codegen'd).

Every function returns a ``Column``.  Date and time arithmetic works on
TIMESTAMP_NTZ through dates and microsecond counts, so results do not depend
on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tally.config import FILE_TAG_FORMAT, MDY_HMS, MISSING_MARKERS, USUAL_MDY_HMS

__all__ = [
    "concat_strict", "not_in_keep_null", "in_set", "clean_text", "to_double",
    "nan_to_null", "parse_mdy_hms", "saturday_floor", "monday_floor", "yymmdd",
    "week_number", "epoch_micros", "gap_hours", "day_bucket", "ratio_r",
    "inf_to_null",
]


def _epoch() -> Column:
    return F.lit("1970-01-01").cast("date")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def concat_strict(*cols, sep: str = "") -> Column:
    """Join with a separator; any null part makes the result null."""
    parts = []
    for i, c in enumerate(cols):
        if i and sep:
            parts.append(F.lit(sep))
        parts.append(_c(c))
    return F.concat(*parts)


def in_set(c, values) -> Column:
    """Set membership that is never null (a null value is not a member)."""
    return F.coalesce(_c(c).isin(list(values)), F.lit(False))


def not_in_keep_null(c, values) -> Column:
    """``!(x %in% s)``; a null ``x`` is kept, unlike SQL ``NOT IN``."""
    return ~in_set(c, values)


def clean_text(c, na_values=MISSING_MARKERS) -> Column:
    """Trim a text cell and turn the missing markers into null."""
    t = F.trim(_c(c))
    return F.when(~t.isin(list(na_values)), t)


def nan_to_null(c) -> Column:
    """NaN compares as unknown in the reference; make it null."""
    c = _c(c)
    return F.when(~F.isnan(c), c)


def to_double(c) -> Column:
    """Text to double: malformed text is null, ``0007`` is 7.0, NaN is null."""
    return nan_to_null(clean_text(c).try_cast("double"))


def parse_mdy_hms(c) -> Column:
    """E5: month, day, four-digit year, h, m, s to TIMESTAMP_NTZ, whatever stands between them; bad text gives null.

    Separators are any characters but letters and digits, parts have one or two
    digits, seconds may have a fraction.  One expression writes the parts in ISO
    order, one cast parses them: text of another form keeps its mark and is null.
    Text of the usual form is put in that order by position, which costs far less than the
    rewriting by groups that all other text goes through.
    """
    text = _c(c)
    usual = F.concat(F.substr(text, F.lit(7), F.lit(4)), F.lit("-"), F.substr(text, F.lit(1), F.lit(2)), F.lit("-"),
                     F.substr(text, F.lit(4), F.lit(2)), F.substr(text, F.lit(11), F.lit(9)))
    other = F.regexp_replace(F.concat(F.lit("!"), text), F.lit(MDY_HMS), F.lit("$3-$1-$2 $4:$5:$6"))
    return F.when(text.rlike(USUAL_MDY_HMS), usual).otherwise(other).try_cast("timestamp_ntz")


def saturday_floor(d) -> Column:
    """Latest Saturday on or before a date (``floor_date(d, "week", 6)``)."""
    return F.date_sub(F.next_day(F.to_date(_c(d)), "SAT"), 7)


def monday_floor(ts) -> Column:
    """Monday 00:00 of the week of ``ts``, as TIMESTAMP_NTZ."""
    return F.date_sub(F.next_day(F.to_date(_c(ts)), "MON"), 7).cast("timestamp_ntz")


def yymmdd(d) -> Column:
    """``%y%m%d`` label of a date."""
    return F.date_format(_c(d), FILE_TAG_FORMAT)


def week_number(ts) -> Column:
    """Complete seven-day blocks since 1 January, plus one (not ISO, T11)."""
    return (F.floor((F.dayofyear(_c(ts)) - 1) / 7) + 1).cast("int")


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ, without time zones."""
    return F.timestamp_diff("MICROSECOND", _epoch().cast("timestamp_ntz"), _c(ts))


def gap_hours(ts, prev_ts, rounding: str = "trunc") -> Column:
    """Whole hours of the interval from ``ts`` back to ``prev_ts`` (<= 0).

    ``rounding`` picks truncation toward zero (default) or floor for the
    negative interval (T12).
    """
    us = epoch_micros(prev_ts) - epoch_micros(ts)
    h = us / F.lit(3_600_000_000)
    if rounding == "floor":
        return F.floor(h).cast("long")
    if rounding != "trunc":
        raise ValueError(f"gap_rounding must be 'trunc' or 'floor', not {rounding!r}")
    return F.when(h < 0, F.ceil(h)).otherwise(F.floor(h)).cast("long")


def day_bucket(ts, weekend_days=(1, 7)) -> Column:
    """Weekend / weekday_am / weekday_pm from the reading's own time."""
    ts = _c(ts)
    return (F.when(in_set(F.dayofweek(ts), weekend_days), F.lit("weekend"))
            .when(F.hour(ts) <= 11, F.lit("weekday_am"))
            .when(F.hour(ts) > 11, F.lit("weekday_pm")))


def ratio_r(num, den) -> Column:
    """E16 with R's IEEE results: x/0 is +-Inf, 0/0 and NaN/0 are NaN.

    Plain ``/`` raises under ANSI, so zero divisors are handled before the
    division runs.
    """
    num, den = _c(num), _c(den)
    inf = F.lit(float("inf"))
    by_zero = (F.when(F.isnan(num) | (num == 0), F.lit(float("nan")))
               .when(num > 0, inf).when(num < 0, -inf))
    return F.when(den == 0, by_zero).otherwise(F.try_divide(num, den))


def inf_to_null(c) -> Column:
    """``na_if(Inf)``: +Inf becomes null; -Inf and NaN stay."""
    c = _c(c)
    return F.when(c != F.lit(float("inf")), c)
