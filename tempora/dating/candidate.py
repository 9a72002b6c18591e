"""A piece of date evidence, and helpers to read groups out of patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora.functions.interval import MIN_YEAR
from tempora.functions.strings import let

CANDIDATE = (
    "struct<lo:double,hi:double,source:string,precision:string,"
    "confidence:double,evidence:string,flags:array<string>>"
)

# Confidence levels.
VERY_HIGH, HIGH, MEDIUM, LOW, VERY_LOW = 0.95, 0.85, 0.6, 0.35, 0.2


def strings(*values: str) -> Column:
    """A literal array of plain names, in one call to the driver's JVM."""
    listed = ", ".join(f"'{v}'" for v in values)
    return F.expr(f"CAST(array({listed}) AS ARRAY<STRING>)")


def flag(condition: Column, name: str) -> Column:
    """[name] where the condition holds, else []."""
    return F.when(condition, strings(name)).otherwise(strings())


def candidate(
    i: Column, source: Column | str, precision: Column | str, confidence: Column | float, evidence: Column, flags: Column
) -> Column:
    """The candidate struct; null where the interval is."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return let(
        i,
        lambda x: F.when(
            x.isNotNull(),
            F.struct(
                x["lo"].alias("lo"),
                x["hi"].alias("hi"),
                lit(source).alias("source"),
                lit(precision).alias("precision"),
                lit(confidence).cast("double").alias("confidence"),
                evidence.alias("evidence"),
                flags.alias("flags"),
            ),
        ),
    )


def reading(i: Column, precision: Column | str, confidence: Column | float, flags: Column) -> Column:
    """What a rule reads out of a text: struct(i, precision, confidence, flags); null with i."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return let(
        i,
        lambda x: F.when(
            x.isNotNull(),
            F.struct(
                x.alias("i"), lit(precision).alias("precision"),
                lit(confidence).cast("double").alias("confidence"), flags.alias("flags"),
            ),
        ),
    )


def first_reading(source: str, evidence: Column, *readings: Column) -> Column:
    """The candidate of the first rule that reads anything."""
    return let(
        F.coalesce(*readings),
        lambda r: candidate(r["i"], source, r["precision"], r["confidence"], evidence, r["flags"]),
    )


def group(text: Column, pattern: str, n: int = 1) -> Column:
    """Group n of the first match; null where nothing matches."""
    return let(F.regexp_extract(text, pattern, n), lambda g: F.when(g != "", g))


def number(text: Column, pattern: str, n: int = 1) -> Column:
    """Group n as an integer; null where nothing matches."""
    return integer(F.regexp_extract(text, pattern, n))


def integer(digits: Column) -> Column:
    """An integer; null for an empty string, which no cast sees: each failed one costs an exception."""
    return F.call_function("transform", F.array(digits), F.expr("d -> try_cast(nullif(d, '') AS INT)"))[0]


def plausible(year: Column, max_year: int) -> Column:
    return year.between(MIN_YEAR, max_year)
