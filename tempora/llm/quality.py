"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger row holds the
measurements and one long of failure bits; policies are versioned masks over
these bits, so a new policy, or the effect of removing a rule from one, needs
no second look at a text. Ablations group the ledger by its bits: at most
2^rules rows, whatever the number of documents.

All on DataFrame functions; no shuffle for the ledger. Repeated windows are
screened by 64-bit hashes (equal windows always have equal hashes) and counted
exactly, on the words themselves, only in texts where a hash repeats.

Defined cases: a null or blank text has no words and fails the base; ties and
repeated rows are independent; an empty table gives an empty ledger; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.strings import BLANKS, let, words
from tempora.plans.materialize import materialize

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Fixed rules: name -> failing condition over the measurements. Bit i is the i-th rule.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
}

#: Versioned policies: version -> the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "symbols"),
    "v3": tuple(RULES),
}
BASE = ("few_words", "repeated_windows")


def mask(rules) -> int:
    """The bits of the named rules."""
    return sum(1 << list(RULES).index(r) for r in rules)


def _covered(starts: Column) -> Column:
    """Words covered by windows that begin at the sorted positions."""
    gaps = F.transform(
        starts,
        lambda p, i: F.when(
            i + 1 < F.size(starts), F.least(F.lit(WINDOW), F.get(starts, i + 1) - p)
        ).otherwise(F.lit(WINDOW)),
    )
    return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)


def _repeat_words(w: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more in array w."""
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)

    def exact(w):
        keyed = F.sort_array(
            F.transform(
                starts,
                lambda i: F.struct(
                    F.concat_ws(" ", *[F.get(w, i + k) for k in range(WINDOW)]).alias("k"), i.alias("i")
                ),
            )
        )

        def repeated(s):
            twice = F.filter(
                s,
                lambda x, j: (x["k"] == F.get(s, j + 1)["k"]).eqNullSafe(True)
                | (x["k"] == F.get(s, j - 1)["k"]).eqNullSafe(True),
            )
            return let(F.sort_array(F.transform(twice, lambda x: x["i"])), _covered)

        return let(keyed, repeated)

    def screened(h):
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return let(hashes, lambda x: F.size(F.array_distinct(x)) < F.size(x))

    suspect = let(F.transform(w, lambda x: F.xxhash64(x)), screened)
    return F.when(F.size(w) <= WINDOW, F.lit(0)).when(suspect, let(w, exact)).otherwise(F.lit(0))


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, measurements, rule_bits."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    measured = docs.select(
        F.col("doc_id"),
        words(text).alias("w"),
        lines.alias("lines"),
        F.length(F.regexp_replace(text, BLANKS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
    ).select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
    )
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("rule_bits", bits)


def apply_policy(led: DataFrame, version: str) -> DataFrame:
    """Add base_failed and kept by a versioned policy; the base always rejects."""
    fails = lambda rules: F.col("rule_bits").bitwiseAND(F.lit(mask(rules)).cast("long")) != 0
    return led.withColumn("base_failed", fails(BASE)).withColumn(
        "kept", ~fails(BASE) & ~fails(POLICIES[version])
    )


def ablations(led: DataFrame) -> DataFrame:
    """For each policy and rule of it: documents rejected, and rejected by that rule alone.

    led is a stored ledger: texts are not read again. An empty one has no rows here.
    """
    counts = led.groupBy("rule_bits").agg(F.count("*").alias("n"))
    cases = [(v, r, mask(rules), mask([r])) for v, rules in POLICIES.items() for r in rules]
    each = F.explode(
        F.array(
            *[
                F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(m).alias("mask"), F.lit(b).alias("bit"))
                for v, r, m, b in cases
            ]
        )
    )
    failed = F.col("rule_bits").bitwiseAND(F.col("c.mask").cast("long"))
    return (
        counts.select("rule_bits", "n", each.alias("c"))
        .groupBy("c.policy", "c.rule")
        .agg(
            F.sum(F.when(failed != 0, F.col("n")).otherwise(0)).alias("rejected"),
            F.sum(F.when(failed == F.col("c.bit"), F.col("n")).otherwise(0)).alias("only_by_rule"),
        )
    )


def ablation_report(docs: DataFrame) -> DataFrame:
    """Store the ledger of the documents, then the effect of every rule of every policy."""
    return ablations(materialize(ledger(docs).select("rule_bits"), "quality-ledger"))
