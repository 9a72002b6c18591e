"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain, language, source. A budget of tokens starts at the root and
is shared among the children of each node in proportion to their weights. A
child gets no more than its subtree can give (its tokens times the epochs
allowed); what it cannot take goes to its siblings, in proportion, and leaves a
subtree only once the whole subtree is full. So shortages are redistributed
among siblings before ancestors. Shares are whole numbers, by exact arithmetic.

A leaf of T tokens with budget b gives b div T whole epochs and a prefix of the
next: each epoch orders the leaf's documents by md5(seed:epoch:doc_id), and the
prefix is the documents that begin before the rest of the budget is used up.
The prefix becomes one cut-off key per leaf, found without sorting a leaf: token
sums by the first two hex digits of the key, by the first four inside the bucket
where the budget ends, and by key inside that one. Applying it is a filter on the document itself.

DataFrame functions only. A leaf may hold any share of the rows. The children of
one node, a row each, are shared out in one task; a corpus whose documents bring
a domain of their own may have millions of these under the root, not billions.

Defined cases: a null text has 0 tokens; a null language or source is a leaf of
its own, "(none)"; a null doc_id hashes as the empty string; rows that share a
doc_id stand or fall together; weights absent from the targets are 1; a weight
of 0 or less gives nothing; an empty table gives an empty result; other columns
are ignored, and mix_documents returns them as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.strings import word_count
from tempora.plans.materialize import broadcast_if_small, materialize

LEVELS = ("domain", "lang", "source")
#: Hex digits of the key that narrow down where a budget ends; 256 sums a leaf each time.
PREFIXES = (2, 4)
NONE = "(none)"


@dataclass(frozen=True)
class MixTargets:
    """Integer weights by level and name, the budget as a fraction, epochs and seed."""

    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    budget_num: int = 4
    budget_den: int = 5
    max_epochs: int = 2
    seed: int = 42


#: Targets of the registered query: twice as much of domain d0, English first.
PRODUCTION = MixTargets(
    weights={
        "domain": {"d0": 4, "d1": 3, "d2": 3, "d3": 2},
        "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
    }
)
#: The pipeline repeats nothing that deduplication has just removed.
PIPELINE = MixTargets(weights=PRODUCTION.weights, budget_num=9, budget_den=10, max_epochs=1)


def domain_of(source: Column) -> Column:
    """The domain of a source without one of its own: its trailing number modulo 4."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    part = F.when(number != "", F.pmod(number.cast("long"), F.lit(4))).otherwise(0)
    return F.concat(F.lit("d"), part.cast("string"))


def leaf_columns(docs: DataFrame) -> dict[str, Column]:
    source = F.coalesce(F.col("source"), F.lit(NONE))
    return {
        "domain": F.coalesce(F.col("domain"), F.lit(NONE)) if "domain" in docs.columns else domain_of(source),
        "lang": F.coalesce(F.col("lang"), F.lit(NONE)),
        "source": source,
    }


def epoch_key(seed: int, epoch: Column) -> Column:
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc).cast("binary"))


def _weight(level: str, weights: dict[str, int]) -> Column:
    w = F.lit(1)
    for name, value in weights.items():
        w = F.when(F.col(level) == name, F.lit(int(value))).otherwise(w)
    return w.cast("long")


def _share(children: DataFrame, parent: list[str], level: str, weights: dict[str, int]) -> DataFrame:
    """Split each parent's budget among its children; columns budget, cap -> budget."""
    part = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    c = children.withColumn("w", _weight(level, weights)).where("w > 0 and cap > 0")
    order = part.orderBy((F.col("cap") / F.col("w")), level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    wide = "decimal(38,0)"
    c = (
        c.withColumn("left_b", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_w", F.sum("w").over(part) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn(
            "full",
            F.col("cap").cast(wide) * F.col("left_w").cast("decimal(18,0)")
            <= F.col("left_b").cast(wide) * F.col("w").cast("decimal(18,0)"),
        )
    )
    open_w = F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0)).over(part)
    open_b = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(part)
    c = c.withColumn("open_w", open_w).withColumn("open_b", open_b)
    c = c.withColumn(
        "floor", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("bigint(open_b * w div open_w)"))
    )
    spare = F.col("budget") - F.sum("floor").over(part)
    nth = F.row_number().over(part.orderBy("full", level))
    c = c.withColumn("spare", spare).withColumn("nth", nth)
    more = F.when(~F.col("full") & (F.col("nth") <= F.col("spare")), 1).otherwise(0)
    return c.withColumn("budget", (F.col("floor") + more).cast("long")).select(*parent, level, "cap", "budget")


def leaf_budgets(units: DataFrame, targets: MixTargets) -> DataFrame:
    """domain, lang, source, tokens, budget: the shares after redistribution."""
    leaves = materialize(
        units.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves"
    )
    caps = leaves.withColumn("cap", F.col("tokens") * targets.max_epochs)
    domains = caps.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    everything = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    domains = domains.withColumn("total", everything).withColumn(
        "budget", F.expr(f"total * {int(targets.budget_num)} div {int(targets.budget_den)}")
    )
    shared = _share(domains, [], "domain", targets.weights.get("domain", {}))
    langs = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    langs = langs.join(shared.select("domain", "budget"), "domain")
    shared = _share(langs, ["domain"], "lang", targets.weights.get("lang", {}))
    sources = caps.join(shared.select("domain", "lang", "budget"), ["domain", "lang"])
    shared = _share(sources, ["domain", "lang"], "source", targets.weights.get("source", {}))
    return leaves.join(shared.select(*LEVELS, "budget"), list(LEVELS), "left").select(
        *LEVELS, "tokens", F.coalesce("budget", F.lit(0)).cast("long").alias("budget")
    )


def plan_leaves(units: DataFrame, targets: MixTargets) -> DataFrame:
    """domain, lang, source, tokens, budget, full_epochs, cutoff (of the next epoch's key)."""
    leaves = materialize(
        leaf_budgets(units, targets)
        .withColumn("full_epochs", F.expr("if(tokens > 0, budget div tokens, 0)"))
        .withColumn("rest", F.expr("if(tokens > 0, budget % tokens, 0)")),
        "mix-budgets",
    )
    ends = leaves.where("rest > 0").select(*LEVELS, "full_epochs", "rest")
    keyed = units.join(broadcast_if_small(ends), list(LEVELS)).select(
        *LEVELS, "rest", "n_tokens", epoch_key(targets.seed, F.col("full_epochs")).alias("key")
    )
    keyed = materialize(keyed, "mix-keys")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    where = ends.select(*LEVELS, "rest", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("begin"))
    for digits in PREFIXES:
        # Token sums by a longer prefix of the key, inside the one where the budget ends.
        known = broadcast_if_small(where.select(*LEVELS, "prefix", "begin"))
        sums = (
            keyed.withColumn("prefix", F.substring("key", 1, digits - PREFIXES[0]))
            .join(known, [*LEVELS, "prefix"])
            .groupBy(*LEVELS, F.substring("key", 1, digits).alias("next"))
            .agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"), F.first("begin").alias("begin"))
        )
        order = before.partitionBy(*LEVELS).orderBy("next")
        sums = sums.withColumn("begin", F.col("begin") + F.coalesce(F.sum("n").over(order), F.lit(0)))
        where = materialize(
            sums.where("begin < rest and begin + n >= rest").select(*LEVELS, "rest", F.col("next").alias("prefix"), "begin"),
            "mix-buckets",
        )
    inside = (
        keyed.withColumn("prefix", F.substring("key", 1, PREFIXES[-1]))
        .join(broadcast_if_small(where.select(*LEVELS, "prefix", "begin")), [*LEVELS, "prefix"])
        .groupBy(*LEVELS, "key")
        .agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"), F.first("begin").alias("begin"))
    )
    inside = inside.withColumn(
        "at",
        F.col("begin") + F.coalesce(F.sum("n").over(before.partitionBy(*LEVELS).orderBy("key")), F.lit(0)),
    )
    cuts = inside.where("at < rest").groupBy(*LEVELS).agg(F.max("key").alias("cutoff"))
    plan = leaves.join(cuts, list(LEVELS), "left").select(
        *LEVELS, "tokens", "budget", "full_epochs", F.coalesce("cutoff", F.lit("")).alias("cutoff")
    )
    return materialize(plan, "mix-plan")


def _epochs(units: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Add epochs: how many times each row is taken."""
    taken = F.col("full_epochs") + F.when(
        epoch_key(seed, F.col("full_epochs")) <= F.col("cutoff"), 1
    ).otherwise(0)
    return units.join(broadcast_if_small(plan), list(LEVELS)).withColumn("epochs", taken.cast("int"))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the leaf and the tokens (words) of each document, written once."""
    leaf = leaf_columns(docs)
    return materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            *[leaf[c].alias(c) for c in LEVELS],
            word_count(F.col("text")).alias("n_tokens"),
        ),
        "mix-units",
    )


def mix(docs: DataFrame, targets: MixTargets = PRODUCTION) -> DataFrame:
    """One row per document taken and epoch: doc_id, leaf, epoch, n_tokens, leaf_budget."""
    units = measure(docs)
    taken = _epochs(units, plan_leaves(units, targets), targets.seed).where("epochs > 0")
    return taken.select(
        "doc_id",
        *LEVELS,
        F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"),
        "n_tokens",
        F.col("budget").alias("leaf_budget"),
    )


def mix_documents(docs: DataFrame, targets: MixTargets = PIPELINE) -> DataFrame:
    """The documents taken, with their own columns, repeated by epoch."""
    units = measure(docs)
    plan = plan_leaves(units, targets)
    leaf = leaf_columns(docs)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), *[leaf[c].alias(c) for c in LEVELS])
    out = _epochs(rows, plan, targets.seed).where("epochs > 0")
    if targets.max_epochs > 1:
        out = out.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("epochs"))))
    return out.select("row.*")
