"""Awkward documents shared by the operators' tests."""

import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, digest string, kept boolean, shard int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 977} stone{i}" for i in range(30_000))
    rows = [
        (1, "The same text here, twice over.", "en", "src1", 5, "x", True, 1),
        (2, "the SAME text here, twice over.", "en", "src1", 5, "x", True, 1),
        (2, "the SAME text here, twice over.", "en", "src1", 5, "x", True, 1),
        (3, None, None, None, None, None, None, None),
        (4, "", "en", "src2", 0, "", False, 0),
        (5, long, "de", "src3", len(long), "y", True, 2),
        (6, " \t\n ", "fr", None, 4, None, None, 9),
        (None, "no number but words enough to be told from other texts", None, "src1", 3, None, None, None),
        (None, "The same text here, twice over.", "en", "src1", 3, None, None, None),
        (7, "ÄÖ straße É", "de", "src3", 9, None, None, None),
    ]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


#: Names that helper columns have, or once had: a document's own columns may be called so.
HELPERS = (
    "__id __p __n __e __sha __kept __same __text_sha __cut __full __domain __lang __source __digest __bucket __bit __bits "
    "__possible row key same kept_1 digest bucket bit bits maybe fp root first rank total p epochs domain_ cutoff shard task"
).split()


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with a column of every helper name, each holding its own name."""
    from pyspark.sql import functions as F

    return odd.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(n).alias(n) for n in HELPERS])


@pytest.fixture(scope="session")
def unchanged():
    def check(out, docs):
        """out has docs' columns, with each helper column as it was."""
        rows = out.collect()
        assert out.columns == docs.columns and rows
        assert all(r[n] == n for r in rows for n in HELPERS if n in docs.columns)
        return rows

    return check
