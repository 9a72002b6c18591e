"""String columns shared by several operators."""

from __future__ import annotations

import hashlib
import html
import string
import urllib.parse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A word: a run without space, tab, line feed, vertical tab, form feed, return.
WORD = "[^\\x20\\x09-\\x0D]+"
BLANKS = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, even where body uses it often."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. lower() is the same, and faster, on pure ASCII."""
    plain = F.lower(text)
    return F.when(
        text.rlike("[^\\x00-\\x7F]"),
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase),
    ).otherwise(plain)


def words(text: Column) -> Column:
    """The words of a text as an array, without empty strings."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words; null counts as an empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def file_key(name: Column) -> Column:
    """Base name without 'File:', Unicode NFC, blanks as underscores.

    Only names with non-ASCII characters go through Python, in Arrow batches:
    composition has no built-in.
    """
    base = F.regexp_replace(F.substring_index(name, "/", -1), "^File:", "")
    composed = F.when(base.rlike("[^\\x00-\\x7F]"), compose(base)).otherwise(base)
    return F.replace(composed, F.lit(" "), F.lit("_"))


@F.pandas_udf(StringType())
def compose(s: pd.Series) -> pd.Series:
    """Unicode normalisation form C."""
    return s.str.normalize("NFC")


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """HTML entities to characters."""
    return s.map(html.unescape, na_action="ignore")


def strip_html(value: Column, hidden: bool = True, blanks: str = "(?U)\\s+") -> Column:
    """Text of an HTML fragment; hidden blocks go first if asked, runs of blanks (a regex) collapse."""
    text = F.coalesce(value, F.lit(""))
    if hidden:
        text = F.regexp_replace(text, "(?is)<div[^>]*display:\\s*none[^>]*>.*?</div>", " ")
    text = F.regexp_replace(text, "<[^>]+>", " ")
    text = F.when(text.contains("&"), unescape(text)).otherwise(text)
    return F.trim(F.regexp_replace(text, blanks, " "))


#: The characters that stay as they are in a stored name, and its length.
SAFE = " ()_,.'-&!+=@~[]"
LONGEST_NAME = 180


@F.pandas_udf(StringType())
def safe_filename(s: pd.Series) -> pd.Series:
    """Percent-encoded name; a long one is cut and ends in a digest of the whole."""

    def one(name: str) -> str:
        quoted = urllib.parse.quote(name, safe=SAFE)
        if len(quoted) <= LONGEST_NAME:
            return quoted
        return f"{quoted[: LONGEST_NAME - 13]}_{hashlib.sha1(name.encode()).hexdigest()[:12]}"

    return s.map(one, na_action="ignore")


def scene_prefix(scene_id: Column) -> Column:
    """'110/925' for 110925."""
    return F.format_string("%03d/%03d", F.floor(scene_id / 1000), F.pmod(scene_id, F.lit(1000)))


def title_of(name: Column) -> Column:
    """Page title of a stored image name."""
    return F.concat(F.lit("File:"), F.replace(F.substring_index(name, "/", -1), F.lit("_"), F.lit(" ")))


def stable_hash(text: Column) -> Column:
    """The first 12 hexadecimal digits of SHA-1 as a number."""
    return F.conv(F.substring(F.sha1(text), 1, 12), 16, 10).cast("long")
