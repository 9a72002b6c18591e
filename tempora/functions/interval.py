"""Half-open intervals in decimal years, as column expressions.

An interval is struct<lo double, hi double>; empty or undefined ones are null.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora.functions.strings import let

MIN_YEAR = 1000
#: The last year that evidence may name; a parameter wherever results depend on it.
THIS_YEAR = datetime.date.today().year

INTERVAL = "struct<lo:double,hi:double>"


def decimal_year(day: Column) -> Column:
    """Year plus the part of it that has passed before the day."""
    y = F.year(day)
    return y + (F.dayofyear(day) - 1) / F.dayofyear(F.make_date(y, F.lit(12), F.lit(31)))


def interval(lo: Column, hi: Column) -> Column:
    """[lo, hi); null unless lo < hi."""
    ends = F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    return let(ends, lambda e: F.when(e["lo"] < e["hi"], e))


def from_years(first: Column, last: Column) -> Column:
    """Whole years, both inclusive."""
    return interval(first, last + 1)


def _date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null; nothing is thrown and caught, which would cost far more."""
    return F.when(
        year.between(1, 9999) & month.between(1, 12) & (day >= 1),
        let(
            F.make_date(year, month, F.lit(1)),
            lambda first: F.when(day <= F.dayofmonth(F.last_day(first)), F.date_add(first, day - 1)),
        ),
    )


def from_day(year: Column, month: Column, day: Column) -> Column:
    """One day; null where there is no such date."""
    return let(
        _date(year, month, day), lambda d: interval(decimal_year(d), let(F.date_add(d, 1), decimal_year))
    )


def from_month(year: Column, month: Column) -> Column:
    """One month; null where there is no such month."""
    return let(
        _date(year, month, F.lit(1)), lambda d: interval(decimal_year(d), let(F.add_months(d, 1), decimal_year))
    )


def mid(i: Column) -> Column:
    return (i["lo"] + i["hi"]) / 2


def width(i: Column) -> Column:
    return i["hi"] - i["lo"]


def overlaps(a: Column, b: Column) -> Column:
    return (a["lo"] < b["hi"]) & (b["lo"] < a["hi"])


def agree(a: Column, b: Column, slack: float = 0.1) -> Column:
    """Do they overlap once each is widened by slack on both sides?"""
    return (a["lo"] - slack < b["hi"] + slack) & (b["lo"] - slack < a["hi"] + slack)


def intersect(a: Column, b: Column) -> Column:
    return interval(F.greatest(a["lo"], b["lo"]), F.least(a["hi"], b["hi"]))


def clip(i: Column, lo: Column, hi: Column) -> Column:
    """Restrict to [lo, hi); a null bound does not restrict."""
    return interval(F.greatest(i["lo"], lo), F.least(i["hi"], hi))


def label(i: Column) -> Column:
    """'1900', or '1920-1929' for more than a year; null for no interval."""
    years = F.struct(F.floor(i["lo"]).alias("a"), F.floor(i["hi"] - 1e-9).alias("b"))
    return let(
        years,
        lambda y: F.when(y["a"] == y["b"], y["a"].cast("string")).otherwise(F.concat(y["a"], F.lit("-"), y["b"])),
    )
