"""Free-text dates: rules in order of precedence, the first that applies decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora.dating.candidate import HIGH, LOW, first_reading, flag, number, plausible, reading, strings
from tempora.dating.qs import CIRCA_YEARS
from tempora.functions.interval import MIN_YEAR, THIS_YEAR, from_day, from_month, from_years, interval
from tempora.functions.strings import let

# Month names in English, German, French, Spanish, Italian, Dutch.
MONTHS = {
    1: "january jan januar janvier enero gennaio januari",
    2: "february feb februar février fevrier febrero febbraio februari",
    3: "march mar märz maerz mars marzo maart",
    4: "april apr avril abril aprile",
    5: "may mai mayo maggio mei",
    6: "june jun juni juin junio giugno",
    7: "july jul juli juillet julio luglio",
    8: "august aug août aout agosto augustus",
    9: "september sep sept septembre septiembre settembre",
    10: "october oct oktober octobre octubre ottobre",
    11: "november nov novembre noviembre",
    12: "december dec dezember décembre decembre diciembre dicembre",
}
MONTH_NAME = "|".join(sorted((n for names in MONTHS.values() for n in names.split()), key=len, reverse=True))

# The patterns, over lower-cased text with single spaces.
RANGE = "(?U)(?:between|from|zwischen|entre)?\\s*\\b(\\d{4})\\s*(?:-|–|—|/|and|to|until|till|bis|und|et|à)\\s*(\\d{4})\\b"
BEFORE = "(?U)\\b(?:before|prior to|vor|avant|antes de|not after)\\s+(?:[\\w.]+\\s+){0,2}(\\d{4})\\b"
AFTER = "(?U)\\b(?:after|nach|après|apres|después de|not before|since)\\s+(?:[\\w.]+\\s+){0,2}(\\d{4})\\b"
ISO_DAY = "(?U)\\b(\\d{4})[-:.](\\d{1,2})[-:.](\\d{1,2})\\b"
DAY_FIRST = f"(?U)\\b(\\d{{1,2}})\\.?\\s+({MONTH_NAME})\\.?,?\\s+(\\d{{4}})\\b"
MONTH_FIRST = f"(?U)\\b({MONTH_NAME})\\.?\\s+(\\d{{1,2}}),?\\s+(\\d{{4}})\\b"
MONTH_YEAR = f"(?U)\\b({MONTH_NAME})\\.?,?\\s+(\\d{{4}})\\b"
ISO_MONTH = "(?U)\\b(\\d{4})-(\\d{1,2})\\b(?![-:.]\\d)"
CIRCA = "(?U)(?:\\b(?:circa|ca|c|around|about|approx|approximately|um|vers|env|hacia)\\b\\.?|~)\\s*(\\d{4})\\b(?!s)"
DECADE = "(?U)\\b(\\d{3}0)(?:s|'s|er|er jahre)\\b"
CENTURY = "(?U)\\b(\\d{1,2})(?:st|nd|rd|th|\\.)\\s+(?:century|jahrhundert)\\b"
YEAR = "(?<!\\d)(\\d{4})(?!\\d)"
CIRCA_SHORT = "(?U)\\b(?:ca|c)\\."


def month_number(name: Column) -> Column:
    """1 to 12 of a lower-case month name; null for any other word."""
    pairs = ", ".join(f"'{word}', {n}" for n, names in MONTHS.items() for word in names.split())
    return F.element_at(F.expr(f"map({pairs})"), name)


def parse_date_text(
    text: Column, source: str = "date_text", confidence: float = HIGH, max_year: int = THIS_YEAR
) -> Column:
    """The candidate of a visible date; null where nothing is usable."""

    groups = {
        "first": (RANGE, 1), "last": (RANGE, 2), "before": (BEFORE, 1), "after": (AFTER, 1),
        "iso_y": (ISO_DAY, 1), "iso_m": (ISO_DAY, 2), "iso_d": (ISO_DAY, 3),
        "dmy_d": (DAY_FIRST, 1), "dmy_y": (DAY_FIRST, 3), "mdy_d": (MONTH_FIRST, 2), "mdy_y": (MONTH_FIRST, 3),
        "my_y": (MONTH_YEAR, 2), "ym_y": (ISO_MONTH, 1), "ym_m": (ISO_MONTH, 2),
        "circa": (CIRCA, 1), "decade": (DECADE, 1), "century": (CENTURY, 1),
    }
    months = {"dmy_m": (DAY_FIRST, 2), "mdy_m": (MONTH_FIRST, 1), "my_m": (MONTH_YEAR, 1)}

    def read(low: Column) -> Column:
        """Every group once, then the rules over them."""
        years = F.array_distinct(
            F.filter(
                F.transform(F.regexp_extract_all(low, F.lit(YEAR)), lambda y: y.try_cast("int")),
                lambda y: plausible(y, max_year),
            )
        )
        flags = F.concat(
            flag(low.contains("upload"), "upload_date"),
            flag(low.contains("circa") | low.rlike(CIRCA_SHORT), "circa"),
        )
        found = F.struct(
            *[number(low, p, n).alias(k) for k, (p, n) in groups.items()],
            *[month_number(F.regexp_extract(low, p, n)).alias(k) for k, (p, n) in months.items()],
            F.array_sort(years).alias("years"),
            flags.alias("flags"),
        )
        return let(found, rules)

    def rules(x: Column) -> Column:
        ok = lambda *names: reduce(lambda a, b: a & b, [plausible(x[n], max_year) for n in names])
        flags, years = x["flags"], x["years"]
        day = lambda k: F.when(ok(f"{k}_y"), from_day(x[f"{k}_y"], x[f"{k}_m"], x[f"{k}_d"]))
        month = lambda k: F.when(
            ok(f"{k}_y") & x[f"{k}_m"].between(1, 12), from_month(x[f"{k}_y"], x[f"{k}_m"])
        )
        one = F.size(years) == 1
        return first_reading(
            source,
            text,
            reading(
                F.when(ok("first", "last") & (x["first"] <= x["last"]), from_years(x["first"], x["last"])),
                "range", confidence, flags,
            ),
            reading(
                F.when(ok("before"), interval(F.lit(MIN_YEAR), x["before"] + 1)),
                "bound", LOW, F.concat(flags, strings("open_start")),
            ),
            reading(
                F.when(ok("after"), interval(x["after"], F.lit(max_year + 1))),
                "bound", LOW, F.concat(flags, strings("open_end")),
            ),
            reading(F.coalesce(day("iso"), day("dmy"), day("mdy")), "day", confidence, flags),
            reading(F.coalesce(month("my"), month("ym")), "month", confidence, flags),
            reading(
                F.when(ok("circa"), from_years(x["circa"] - CIRCA_YEARS, x["circa"] + CIRCA_YEARS)),
                "year", confidence, F.array_union(flags, strings("circa")),
            ),
            reading(F.when(ok("decade"), from_years(x["decade"], x["decade"] + 9)), "decade", confidence, flags),
            reading(
                F.when(
                    plausible(100 * x["century"], max_year),
                    from_years(100 * (x["century"] - 1) + 1, 100 * x["century"]),
                ),
                "century", confidence, flags,
            ),
            reading(
                F.when(F.size(years) > 0, from_years(F.get(years, F.lit(0)), F.element_at(years, -1))),
                F.when(one, "year").otherwise("range"),
                F.when(one, confidence).otherwise(min(confidence, LOW)),
                F.when(one, flags).otherwise(F.concat(flags, strings("multiple_years"))),
            ),
        )

    def dated(low: Column) -> Column:
        return F.when(low.rlike(YEAR) | low.rlike(CENTURY), read(low))

    return let(F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), "(?U)\\s+", " ")), " +", " "), dated)
