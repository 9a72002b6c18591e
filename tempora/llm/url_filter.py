"""URL filtering: rules first, then gradient-boosted trees on lexical features.

A rule names a host and the beginning of a path; it fits that host, all its
subdomains, and every path that begins so, and the longest rule that fits gives
the verdict. Where no rule fits, trees decide that were grown, in numpy, on
labelled URLs: those that rules decide are labelled, or any table of url and
block. What a tree sees of a URL are lengths, depth, digit ratio, entropy,
numbers of parameters and separators, and for its suffixes (the last label and
the last two labels of the host, the ending of the file) and its first directory
how often they were labelled, and how often blocked.

These counts are made over all labelled URLs and reduced in every task. The
MAX_SUFFIXES most frequent names go to every task; the counts of all others stay
a table, with which the pages that hold such a name are joined. The trees see a bounded sample, the
MAX_TRAIN labelled URLs with the smallest hash, each URL once. Each of FOLDS
parts of them is described by the counts of the others, so that no row's label
tells itself. Trees are added as long as the loss of the first part, which they
do not see, falls. Scoring is one pass over the URLs, without a shuffle unless
there are more names than go to every task.

Defined cases: a null url, or one without "://", has an empty host and path and
is judged by the trees; a repeated url is judged alike each time and teaches
once, blocked only if all its labels say so; without labels every verdict is
allow; rules of equal length go to the longer host; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.plans.materialize import materialize
from tempora.session import bound_arrow_batches

#: Bounds of the training sample and of the names whose counts go to every task.
MAX_TRAIN = 20_000
MAX_SUFFIXES = 50_000
#: A name's share of blocked URLs is drawn towards that of all as if by so many more.
PRIOR = 4.0
ROUNDS = 150
PATIENCE = 15
DEPTH = 4
RATE = 0.2
BINS = 64
L2 = 1.0
LEAST_HESSIAN = 1.0
FOLDS = 5
THRESHOLD = 0.5

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_HOST = re.compile(r"://([^/?#]*)([^?#]*)")
_KINDS = ("label", "domain", "ending", "directory")
LEXICAL = (
    "url_length", "host_length", "path_length", "query_length", "labels", "depth", "digit_ratio", "host_digit_ratio",
    "entropy", "host_entropy", "parameters", "hyphens", "symbols", "secure", "fragment",
)
FEATURES = LEXICAL + tuple(f"{kind}_{what}" for kind in _KINDS for what in ("seen", "blocked"))


def place(url: str | None) -> tuple[str, str]:
    """(host, path) of a url."""
    found = _HOST.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


@dataclass(frozen=True)
class RuleBook:
    """Rules by host: (rule, path, block), the longest first."""

    by_host: dict[str, list[tuple[str, str, bool]]]

    @classmethod
    def of(cls, rules: dict[str, str]) -> RuleBook:
        """rules: host and path, like `example.org/es/`, to allow or block."""
        by_host: dict[str, list[tuple[str, str, bool]]] = {}
        for rule, verdict in rules.items():
            if verdict not in ("allow", "block") or "/" not in rule:
                raise ValueError(f"no rule: {rule} {verdict}")
            host, path = rule.split("/", 1)
            by_host.setdefault(host.translate(_LOWER), []).append((rule, "/" + path, verdict == "block"))
        return cls({h: sorted(r, key=lambda x: (-len(x[0]), x[0])) for h, r in by_host.items()})

    def decide(self, host: str, path: str) -> tuple[str, bool] | None:
        """(rule, block) of the longest rule that fits."""
        best: tuple[str, bool] | None = None
        at = 0
        while host and at >= 0:
            for rule, begin, block in self.by_host.get(host[at:], ()):
                if path.startswith(begin):
                    if best is None or len(rule) > len(best[0]):
                        best = rule, block
                    break
            at = host.find(".", at) + 1 or -1
        return best


def entropy(text: str) -> float:
    """Bits a character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def lexical(url: str | None, host: str, path: str) -> list[float]:
    url = url or ""
    rest, _, fragment = url.partition("#")
    query = rest.partition("?")[2]
    digits = sum(map(url.count, string.digits))
    host_digits = sum(map(host.count, string.digits))
    return [
        len(url), len(host), len(path), len(query), host.count(".") + (host != ""), path.count("/"),
        digits / max(1, len(url)), host_digits / max(1, len(host)), entropy(url), entropy(host),
        query.count("&") + (query != ""), url.count("-") + url.count("_"), sum(map(url.count, "%=~@;,+$!")),
        float(url[:8].lower() == "https://"), float(fragment != ""),
    ]


def suffixes(host: str, path: str) -> list[str]:
    """For each of _KINDS the name that is counted: at most 100 characters of it."""
    labels = host.rsplit(".", 2)
    last = path.rsplit("/", 1)[-1]
    ending = last.rsplit(".", 1)[1] if "." in last else ""
    first = path.split("/", 2)
    return [
        labels[-1][:100], ".".join(labels[-2:])[:100], ending[:100].lower(), (first[1] if len(first) > 2 else "")[:100],
    ]


@dataclass
class Trees:
    """Boosted trees: per tree the features, bins and leaf values of a complete binary tree."""

    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def leaf(self, bins: np.ndarray, t: int) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (bins[rows, self.features[t][node]] > self.cuts[t][node])
        return node - (2**DEPTH - 1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        if self.leaves and len(x):
            bins = self.binned(x)
            for t, values in enumerate(self.leaves):
                z += values[self.leaf(bins, t)]
        return 1 / (1 + np.exp(-z))


def grow(trees: Trees, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
    """One more tree, level by level: each node takes the cut of most gain, by sums of gradients in bins."""
    inner = 2**DEPTH - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS)
    node = np.zeros(len(bins), np.int64)
    score = lambda g, h: g * g / (h + L2)
    for depth in range(DEPTH):
        first, n = 2**depth - 1, 2**depth
        best = np.full(n, 1e-6)
        for j in range(bins.shape[1]):
            key = (node - first) * (BINS + 1) + bins[:, j]
            gs = np.bincount(key, g, n * (BINS + 1)).reshape(n, -1).cumsum(axis=1)
            hs = np.bincount(key, h, n * (BINS + 1)).reshape(n, -1).cumsum(axis=1)
            total_g, total_h = gs[:, -1:], hs[:, -1:]
            gain = score(gs, hs) + score(total_g - gs, total_h - hs) - score(total_g, total_h)
            gain[(hs < LEAST_HESSIAN) | (total_h - hs < LEAST_HESSIAN)] = 0
            at = gain.argmax(axis=1)
            most = gain[np.arange(n), at]
            better = most > best
            best[better] = most[better]
            feature[first : first + n][better] = j
            cut[first : first + n][better] = at[better]
        node = 2 * node + 1 + (bins[np.arange(len(bins)), feature[node]] > cut[node])
    leaf = node - inner
    sums = lambda v: np.bincount(leaf, v, 2**DEPTH)
    trees.features.append(feature)
    trees.cuts.append(cut)
    trees.leaves.append(-RATE * sums(g) / (sums(h) + L2))


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Trees:
    """Trees of least loss on the held rows, grown on the others; deterministic."""
    train = ~held if (~held).any() else np.ones(len(y), bool)
    rate = float(np.clip(y[train].mean(), 1e-3, 1 - 1e-3))
    trees = Trees(base=math.log(rate / (1 - rate)))
    trees.edges = [np.unique(np.quantile(x[train, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    if y[train].min() == y[train].max():
        return trees
    bins = trees.binned(x)
    z = np.full(len(y), trees.base)
    best, kept = np.inf, 0
    judged = held if held.any() else train
    for t in range(ROUNDS):
        p = 1 / (1 + np.exp(-z))
        grow(trees, bins[train], (p - y)[train], np.maximum(p * (1 - p), 1e-6)[train])
        z += trees.leaves[t][trees.leaf(bins, t)]
        loss = np.logaddexp(0, np.where(y > 0, -z, z))[judged].mean()
        if loss < best - 1e-5:
            best, kept = loss, t + 1
        elif t - kept >= PATIENCE:
            break
    for part in (trees.features, trees.cuts, trees.leaves):
        del part[kept:]
    return trees


@dataclass
class UrlModel:
    """Labels counted by kind and name, the share of all that is blocked, and the trees."""

    #: Of each kind, name -> (labelled, blocked) in each fold.
    names: list[dict[str, np.ndarray]] = field(default_factory=lambda: [{} for _ in _KINDS])
    total: np.ndarray = field(default_factory=lambda: np.zeros((FOLDS, 2)))
    trees: Trees = field(default_factory=lambda: Trees(base=-20.0))
    #: kind, name, by_fold of all names, where they are more than `names` holds.
    table: DataFrame | None = None

    def counted(self, names: list[str], without: int | None = None, found: Sequence[np.ndarray | None] = (None,) * len(_KINDS)) -> list[float]:
        """Of each kind the name's share of what is labelled, and the share of it that is blocked; without one fold's.

        found: of each kind the name's row of the table, if that was asked.
        """
        use = [f for f in range(FOLDS) if f != without]
        total, all_blocked = self.total[use].sum(axis=0)
        out = []
        for known, name, other in zip(self.names, names, found, strict=True):
            folds = known.get(name, other)
            n, blocked = (0, 0) if folds is None else folds[use].sum(axis=0)
            out += [math.log1p(10_000 * n / max(1, total)), (blocked + PRIOR * all_blocked / max(1, total)) / (n + PRIOR)]
        return out

    def probability(self, places: list[tuple[str | None, str, str]], found: list[Sequence[np.ndarray | None]] | None = None) -> np.ndarray:
        found = found or [(None,) * len(_KINDS)] * len(places)
        x = np.array([lexical(*p) + self.counted(suffixes(*p[1:]), found=f) for p, f in zip(places, found, strict=True)], float)
        return self.trees.probability(x.reshape(len(places), len(FEATURES)))


def _folds(by_fold: Sequence[int]) -> np.ndarray:
    return np.array(by_fold, float).reshape(FOLDS, 2)


def learn(labelled: DataFrame, max_train: int = MAX_TRAIN) -> UrlModel:
    """Fit on url, block of any number of rows."""
    bound_arrow_batches(labelled.sparkSession)
    urls = labelled.where("url is not null and block is not null")
    # A URL of any length is a hash and its features from here on.
    described = urls.select(F.col("url").cast("string").alias("url"), F.xxhash64("url").alias("h"), F.col("block").cast("int").alias("block"))
    described = described.groupBy("h", "url").agg(F.min("block").alias("block")).mapInArrow(
        describe, "h long, block int, x array<double>, names array<string>"
    )
    described = materialize(described, "url-features")
    fold = F.pmod(F.shiftright("h", 20), F.lit(FOLDS))
    each = [F.sum(F.when(fold == f, v).otherwise(0)) for f in range(FOLDS) for v in (F.lit(1), F.col("block"))]
    by_fold = F.array(*each).alias("by_fold")
    total = described.agg(F.count("*").alias("n"), by_fold).first()
    model = UrlModel()
    if not total["n"]:
        return model
    model.total = _folds(total["by_fold"])
    named = described.select("h", "block", F.posexplode("names").alias("kind", "name"))
    counts = materialize(named.groupBy("kind", "name").agg(F.count("*").alias("n"), by_fold), "url-names")
    for row in counts.orderBy(F.desc("n"), "kind", "name").limit(MAX_SUFFIXES).toLocalIterator():
        model.names[row["kind"]][row["name"]] = _folds(row["by_fold"])
    if counts.count() > MAX_SUFFIXES:
        model.table = counts.select("kind", "name", "by_fold")
    # The hash alone leaves few more than wanted; then the first of them, fixed numbers of bounded width.
    share = 1.3 * max_train / total["n"]
    some = described.where(F.col("h") < int(-(2**63) + share * 2**64)) if share < 1 else described
    some = some.orderBy("h", "names").limit(max_train)
    rows = some.toPandas()
    # All names of the sample count, at most four of each of its rows.
    whole = replace(model, names=[dict(known) for known in model.names], table=None)
    if model.table is not None:
        asked = some.select(F.posexplode("names").alias("kind", "name")).distinct()
        for row in model.table.join(asked, ["kind", "name"], "left_semi").toLocalIterator():
            whole.names[row["kind"]][row["name"]] = _folds(row["by_fold"])
    y = rows["block"].to_numpy(float)
    part = (rows["h"].to_numpy(np.int64) >> 20) % FOLDS
    x = np.array([[*a, *whole.counted(list(b), int(f))] for a, b, f in zip(rows["x"], rows["names"], part, strict=True)], float)
    model.trees = fit(x.reshape(len(y), len(FEATURES)), y, part == 0)
    return model


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, block, and of each url its lexical features and counted names."""
    for batch in batches:
        places = [(u, *place(u)) for u in batch.column("url").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("h"), batch.column("block"),
                pa.array([[float(v) for v in lexical(*p)] for p in places], pa.list_(pa.float64())),
                pa.array([suffixes(*p[1:]) for p in places], pa.list_(pa.string())),
            ],
            ["h", "block", "x", "names"],
        )


def by_rules(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """url, block of the pages that a rule decides: labelled URLs."""
    book = RuleBook.of(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column("url").to_pylist()
            found = [(u, d[1]) for u, d in ((u, book.decide(*place(u))) for u in urls) if d]
            yield pa.RecordBatch.from_arrays(
                [pa.array([u for u, _ in found], pa.string()), pa.array([b for _, b in found], pa.bool_())], ["url", "block"]
            )

    bound_arrow_batches(pages.sparkSession)
    return pages.select(F.col("url").cast("string").alias("url")).mapInArrow(run, "url string, block boolean")


VERDICTS = "page_id long, host string, path string, rule string, verdict string, p_block double"


def _look_up(pages: DataFrame, model: UrlModel, shared: Broadcast) -> DataFrame:
    """page_id, url, and of each kind the table's row of the url's name (found0..), null where every task has it or none is."""
    asked = [f"name{i}" for i in range(len(_KINDS))]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.names
        for batch in batches:
            names = [suffixes(*place(u)) for u in batch.column("url").to_pylist()]
            columns = [pa.array([None if n[i] in known[i] else n[i] for n in names], pa.string()) for i in range(len(_KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *columns], ["page_id", "url", *asked])

    out = pages.mapInArrow(ask, "page_id long, url string, " + ", ".join(f"{c} string" for c in asked))
    for i, c in enumerate(asked):
        # Rows that ask for nothing are spread by a salt, which the table does not have.
        salt = F.when(F.col(c).isNotNull(), 0).otherwise(1 + F.pmod(F.xxhash64("page_id", "url"), F.lit(4096)))
        rows = model.table.where(F.col("kind") == i).select(F.col("name").alias(c), F.lit(0).cast("long").alias("salt"), F.col("by_fold").alias(f"found{i}"))
        out = out.withColumn("salt", salt.cast("long")).join(rows, [c, "salt"], "left").drop(c, "salt")
    return out


def judge(pages: DataFrame, rules: dict[str, str], model: UrlModel) -> DataFrame:
    """page_id, host, path, rule, verdict and p_block (the trees' view, also where a rule decides) of every page."""
    book = RuleBook.of(rules)
    bound_arrow_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(replace(model, table=None))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    if model.table is not None:
        pages = _look_up(pages, model, shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [(u, *place(u)) for u in batch.column("url").to_pylist()]
            ruled = [book.decide(*p[1:]) for p in places]
            found = [[None if v is None else _folds(v) for v in batch.column(c).to_pylist()] for c in batch.schema.names if c.startswith("found")]
            p = shared.value.probability(places, list(zip(*found, strict=True)))
            block = [d[1] if d else bool(q >= THRESHOLD) for d, q in zip(ruled, p, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"), pa.array([h for _, h, _ in places], pa.string()), pa.array([x for _, _, x in places], pa.string()),
                    pa.array([d[0] if d else None for d in ruled], pa.string()),
                    pa.array(["block" if b else "allow" for b in block], pa.string()), pa.array(p, pa.float64()),
                ],
                [c.split()[0] for c in VERDICTS.split(", ")],
            )

    return pages.mapInArrow(run, VERDICTS)


#: The production rules.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def filter_urls(pages: DataFrame, rules: dict[str, str] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """Judge every page; without a table of labelled URLs those that rules decide teach."""
    return judge(pages, rules, learn(by_rules(pages, rules) if labelled is None else labelled))
