"""Audit of how sources diverge in their words, by joint count histograms.

Terms are runs of ASCII letters, lower-cased, and of characters beyond ASCII. A
lang keeps the V terms that are in at least MIN_DOCS of its documents. A group
(a source of a lang, or the lang as a whole) with N kept occurrences gives a
term that occurs c times there p(c) = 1 + floor(SCALE * (c + 1) / (N + V)), and
two groups differ in it by f(p, q) = floor((p - q)^2 / q).

A pair of sources is not compared term by term. What decides f is the pair of
counts alone, so the distinct (count, count) combinations of the pair are
tallied, and f is evaluated once for each, times its multiplicity. Terms that
only one of the two has, or neither, are cells with a zero: they are not
visited but implied by the sources' own histograms of counts.

Each task counts the terms of its texts before anything is shuffled; then a term
of a lang is one row with its counts by source, at most as many as the lang has
sources, whose pairs are the result. The tally runs over these rows, wherever
they lie, in slabs of bounded size, and what leaves a task is a histogram.

All arithmetic is exact: decimals of 38 digits, and integral division.

Defined cases: null text, lang and source are ''; every occurring (lang, source)
is a group, also without terms; where a lang keeps no term, its pairs have value
0 and it has no part `term`; a repeated row is one more document; ties of value
are ranked by item; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.arrow_text import encoded, grouped, split_words, summed, translated
from tempora.plans.materialize import broadcast_if_small, materialize
from tempora.session import bound_arrow_batches

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
#: Cells of a tally that are held at once.
SLAB = 1 << 20

#: ASCII letters lower-cased, other ASCII to blanks, bytes of other characters as they are.
_TERM_BYTES = bytes(
    ord(chr(b).lower()) if chr(b) in string.ascii_letters else b if b >= 128 else 32 for b in range(256)
)
COUNTS = "lang string, source string, term string, n long, d long"
CELLS = "lang string, a string, b string, ca long, cb long, mult long"


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of COUNTS, one for each group and term of a run of texts: occurrences, and documents that have it."""
    for rows in grouped(batches, "text"):
        terms, owner = split_words(translated(rows["text"], _TERM_BYTES))
        term, names = encoded(terms)
        lang, langs = encoded(rows["lang"])
        source, sources = encoded(rows["source"])
        each = summed({"doc": owner, "term": term, "n": np.ones(len(owner), np.int64)}, ["doc", "term"], n="sum")
        doc, n = each["doc"], each["n_sum"]
        found = summed({"lang": lang[doc], "source": source[doc], "term": each["term"], "n": n}, ["lang", "source", "term"], n="sum", d="count")
        yield pa.RecordBatch.from_arrays(
            [
                langs.take(pa.array(found["lang"])), sources.take(pa.array(found["source"])),
                names.take(pa.array(found["term"])), pa.array(found["n_sum"]), pa.array(found["d_count"]),
            ],
            ["lang", "source", "term", "n", "d"],
        )


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of CELLS from rows (lang, at): how many terms have the counts ca in source a and cb in source b, a before b.

    Terms with as many sources are one matrix; a slab is one column of it against those after it.
    """
    for rows in grouped(batches, "at"):
        lang, langs = encoded(rows["lang"])
        at = rows["at"]
        code, sources = encoded(at.flatten().field("source"))
        count = at.flatten().field("n").to_numpy()
        begin = at.offsets.to_numpy().astype(np.int64)
        begin -= begin[0]
        size = np.diff(begin)
        parts: list[dict[str, np.ndarray]] = []
        held: list[dict[str, np.ndarray]] = []
        keys = ["lang", "a", "b", "ca", "cb"]

        def reduce(parts):
            return summed({c: np.concatenate([p[c] for p in parts]) for c in [*keys, "mult"]}, keys, mult="sum")

        def flush():
            if parts:
                out = reduce(parts)
                held.append({c: out[c] for c in keys} | {"mult": out["mult_sum"]})
                parts.clear()

        waiting = 0
        for m in np.unique(size[size > 1]).tolist():
            terms = np.flatnonzero(size == m)
            step = max(1, SLAB // m)
            for first in range(0, len(terms), step):
                some = terms[first : first + step]
                place = begin[some][:, None] + np.arange(m)
                s, c, l = code[place], count[place], lang[some]
                for i in range(m - 1):
                    rest = m - 1 - i
                    spread = lambda x: np.repeat(x, rest)  # noqa: B023, E731
                    parts.append(
                        {
                            "lang": spread(l), "a": spread(s[:, i]), "b": s[:, i + 1 :].ravel(),
                            "ca": spread(c[:, i]), "cb": c[:, i + 1 :].ravel(), "mult": np.ones(len(some) * rest, np.int64),
                        }
                    )
                    waiting += len(some) * rest
                    if waiting >= SLAB:
                        flush()
                        waiting = 0
        flush()
        if held:
            out = reduce(held)
            yield pa.RecordBatch.from_arrays(
                [
                    langs.take(pa.array(out["lang"])), sources.take(pa.array(out["a"])), sources.take(pa.array(out["b"])),
                    pa.array(out["ca"]), pa.array(out["cb"]), pa.array(out["mult_sum"]),
                ],
                [*keys, "mult"],
            )


def weight(count: Column, total: Column, kept: Column) -> Column:
    """p of a count in a group of so many occurrences, of so many kept terms."""
    return _div(F.lit(SCALE).cast("decimal(38,0)") * (count + 1), total + kept) + 1


def _div(a: Column, b: Column) -> Column:
    """Exact floor of a quotient of non-negative integers."""
    return F.call_function("div", a, b)


def differs(p: Column, q: Column) -> Column:
    """f(p, q); weights are at most SCALE + 1, so that the square is a long."""
    return _div((p - q) * (p - q), q)


def term_rows(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, n (in the lang), at (source, n; sorted): one row for each kept term of a lang."""
    bound_arrow_batches(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counted = docs.select(text("lang"), text("source"), text("text")).mapInArrow(count_terms, COUNTS)
    # Dealt by term once; the sums by source, and of the lang, need no other shuffle.
    by_source = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    return (
        by_source.groupBy("lang", "term")
        .agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("at"))
        .where(F.col("d") >= min_docs)
        .select("lang", "term", "n", "at")
    )


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank."""
    terms = materialize(term_rows(docs, min_docs), "divergence-terms")
    each = terms.select("lang", "term", F.col("n").alias("all_n"), F.inline("at"))
    histogram = materialize(each.groupBy("lang", "source", "n").agg(F.count("*").alias("mult")), "divergence-histograms")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    kept = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("all_total"))
    own = histogram.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("mult")).alias("total"), F.sum("mult").alias("own"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = docs.select(name("lang"), name("source")).distinct().join(own, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = materialize(groups.select("lang", "source", *map(zero, ("total", "own", "v", "all_total"))), "divergence-groups")
    few = broadcast_if_small(groups)

    # Every two sources of a lang are in the result.
    side = lambda s: groups.select("lang", F.col("source").alias(s), F.col("total").alias(f"total_{s}"), F.col("own").alias(f"own_{s}"), *(["v"] if s == "a" else []))
    pairs = materialize(side("a").join(side("b"), "lang").where("a < b"), "divergence-pairs")

    # The cells of a pair: counts in both, one or neither; what both have is taken from the cells with a zero.
    both = terms.where(F.size("at") > 1).select("lang", "at").mapInArrow(tally, CELLS)
    both = both.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("mult").alias("mult"))
    nil = F.lit(0).cast("long")
    one = lambda ca, cb, mult: F.struct(ca.alias("ca"), cb.alias("cb"), mult.alias("mult"))
    ca, cb, mult = F.col("ca"), F.col("cb"), F.col("mult")
    signed = both.select("lang", "a", "b", F.inline(F.array(one(ca, cb, mult), one(ca, nil, -mult), one(nil, cb, -mult), one(nil, nil, mult))))
    at = pairs.select("lang", "a", "b")
    of = lambda s: histogram.select("lang", F.col("source").alias(s), "n", "mult")
    cells = (
        signed.unionByName(at.join(of("a"), ["lang", "a"]).select("lang", "a", "b", F.col("n").alias("ca"), nil.alias("cb"), "mult"))
        .unionByName(at.join(of("b"), ["lang", "b"]).select("lang", "a", "b", nil.alias("ca"), F.col("n").alias("cb"), "mult"))
        .unionByName(pairs.select("lang", "a", "b", nil.alias("ca"), nil.alias("cb"), (F.col("v") - F.col("own_a") - F.col("own_b")).alias("mult")))
        .groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("mult").alias("mult")).where("mult > 0")
    )
    p, q = (weight(F.col(f"c{s}"), F.col(f"total_{s}"), F.col("v")) for s in "ab")
    times = lambda x, y: F.sum(differs(F.col(x), F.col(y)).cast("decimal(38,0)") * F.col("mult"))
    sums = cells.join(pairs, ["lang", "a", "b"]).select("lang", "a", "b", "mult", p.alias("p"), q.alias("q"))
    sums = sums.groupBy("lang", "a", "b").agg(times("p", "q").alias("ab"), times("q", "p").alias("ba"))
    value = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias("value")
    both_ways = F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item"), value("ab")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item"), value("ba")),
    )
    pair_rows = at.join(sums, ["lang", "a", "b"], "left").select("lang", F.inline(both_ways)).withColumn("part", F.lit("pair"))

    p, q = weight(F.col("n"), F.col("total"), F.col("v")), weight(F.col("all_n"), F.col("all_total"), F.col("v"))
    weighed = each.join(few, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    term_part = weighed.where("p > q").select("lang", "source", "item", differs(F.col("p"), F.col("q")).alias("value")).withColumn("part", F.lit("term"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    out = ranked(pair_rows).unionByName(ranked(term_part).where(F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", "value", "rank")
