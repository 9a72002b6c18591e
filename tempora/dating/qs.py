"""The machine-readable date of a description page: pairs of property and value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora.dating.candidate import HIGH, LOW, MEDIUM, first_reading, number, reading, strings
from tempora.functions.interval import MIN_YEAR, THIS_YEAR, from_day, from_month, from_years, interval
from tempora.functions.strings import let

CIRCA_YEARS = 5
# The time format and the property and item numbers.
TIME = "^([+-])(\\d{1,4})-(\\d{2})-(\\d{2})T[^/]*/(\\d+)$"
EARLIEST = ("P1319", "P580")
LATEST = ("P1326", "P582")
SOURCING = "P1480"
CIRCA = "Q5727902"
UNCERTAIN = ("Q18122778", "Q56644435", "Q30230067")


def parse_time(value: Column, max_year: int = THIS_YEAR) -> Column:
    """struct(i interval, precision) of a time value; null where unusable."""
    def read(v: Column) -> Column:
        part = lambda n: number(v, TIME, n)
        return F.struct(
            F.regexp_extract(v, TIME, 1).alias("sign"), part(2).alias("y"), part(3).alias("m"),
            part(4).alias("d"), part(5).alias("code"),
        )

    def rules(x: Column) -> Column:
        y, m, d, code = (x[k] for k in ("y", "m", "d", "code"))
        dated = (code >= 11) & (m > 0) & (d > 0)
        decade, century = F.floor(y / 10) * 10, F.ceil(y / 100)
        found = lambda i, p: let(i, lambda v: F.when(v.isNotNull(), F.struct(v.alias("i"), F.lit(p).alias("precision"))))
        return F.when(
            (x["sign"] == "+") & y.between(MIN_YEAR, max_year),
            F.coalesce(
                F.when(dated, found(from_day(y, m, d), "day")),
                F.when(~dated & (code >= 10) & (m > 0), found(from_month(y, m), "month")),
                F.when(code >= 9, found(from_years(y, y), "year")),
                F.when(code == 8, found(from_years(decade, decade + 9), "decade")),
                F.when(code == 7, found(from_years(100 * (century - 1) + 1, 100 * century), "century")),
            ),
        )

    return let(let(F.trim(value), read), rules)


def parse_qs(qs: Column, max_year: int = THIS_YEAR) -> Column:
    """The candidate of a whole string; null where there is none."""
    tokens = F.filter(F.transform(F.split(qs, ","), lambda t: F.trim(t)), lambda t: t != "")

    def from_tokens(t: Column) -> Column:
        count = F.floor(F.size(t) / 2).cast("int")
        pairs = F.transform(
            F.sequence(F.lit(1), count),
            lambda i: F.struct(F.get(t, 2 * i - 2).alias("p"), F.get(t, 2 * i - 1).alias("v")),
        )
        return F.when(count > 0, let(pairs, from_pairs))

    def from_pairs(pairs: Column) -> Column:
        rest = F.slice(pairs, 2, 1000)
        # The last qualifier of a kind counts, even where its value is unusable.
        last = lambda names: parse_time(
            F.get(F.reverse(F.filter(rest, lambda x: x["p"].isin(*names))), F.lit(0))["v"], max_year
        )
        flags = F.transform(
            F.filter(rest, lambda x: x["p"] == SOURCING),
            lambda x: F.when(x["v"] == CIRCA, "circa").when(x["v"].isin(*UNCERTAIN), "uncertain").otherwise("sourcing"),
        )
        facts = F.struct(
            parse_time(F.get(pairs, F.lit(0))["v"], max_year).alias("main"),
            last(EARLIEST).alias("early"),
            last(LATEST).alias("late"),
            flags.alias("flags"),
        )
        return let(facts, decide)

    def decide(x: Column) -> Column:
        early, late, main, flags = x["early"]["i"], x["late"]["i"], x["main"]["i"], x["flags"]
        sure = F.when(F.array_contains(flags, "uncertain"), MEDIUM).otherwise(HIGH)
        spread = F.when(F.array_contains(flags, "circa"), CIRCA_YEARS).otherwise(0)
        with_flags = lambda *extra: F.concat(flags, strings(*extra))
        none = early.isNull() & late.isNull()
        return first_reading(
            "qs",
            qs,
            reading(
                F.when(late.isNotNull(), interval(early["lo"], F.greatest(late["hi"], early["lo"] + 1))),
                "range", sure, flags,
            ),
            reading(F.when(early.isNull(), interval(F.lit(MIN_YEAR), late["hi"])), "bound", LOW, with_flags("open_start")),
            reading(F.when(late.isNull(), interval(early["lo"], F.lit(max_year + 1))), "bound", LOW, with_flags("open_end")),
            reading(F.when(none, interval(main["lo"] - spread, main["hi"] + spread)), x["main"]["precision"], sure, flags),
        )

    return F.when(qs.isNotNull() & (qs != ""), let(tokens, from_tokens))
