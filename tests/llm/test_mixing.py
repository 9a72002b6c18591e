import hashlib
from collections import defaultdict

from tempora.llm import mixing
from tempora.session import table


def fill(budget, children):
    """Water-filling by rounds: name -> share of {name: (weight, capacity)}, whole numbers."""
    share, left = {c: 0 for c in children}, budget
    live = {c: v for c, v in children.items() if v[0] > 0 and v[1] > 0}
    while live:
        total = sum(w for w, _ in live.values())
        full = [c for c, (w, cap) in live.items() if cap * total <= left * w]
        if not full:
            for c, (w, _) in live.items():
                share[c] = left * w // total
            rest = left - sum(share[c] for c in live)
            for c in sorted(live)[:rest]:
                share[c] += 1
            return share
        for c in full:
            share[c] = live[c][1]
        left -= sum(live.pop(c)[1] for c in full)
    return share


def brute(docs, t):
    leaves = defaultdict(list)
    for r in docs:
        source = r.source if r.source is not None else "(none)"
        digits = ""
        while source and source[-1 - len(digits) : len(source) - len(digits)].isdigit():
            digits = source[-1 - len(digits) :]
        domain = f"d{int(digits) % 4}" if digits else "d0"
        leaf = (domain, r.lang if r.lang is not None else "(none)", source)
        leaves[leaf].append((r.doc_id, len((r.text or "").split(None)) if r.text else 0))
    tokens = {leaf: sum(n for _, n in v) for leaf, v in leaves.items()}
    weight = lambda level, name: t.weights.get(level, {}).get(name, 1)
    budgets = {(): sum(tokens.values()) * t.budget_num // t.budget_den}
    for depth, level in enumerate(mixing.LEVELS):
        for parent in [p for p in budgets if len(p) == depth]:
            caps = defaultdict(int)
            for leaf, n in tokens.items():
                if leaf[:depth] == parent:
                    caps[leaf[depth]] += n * t.max_epochs
            for c, v in fill(budgets[parent], {c: (weight(level, c), cap) for c, cap in caps.items()}).items():
                budgets[(*parent, c)] = v
    out = []
    for leaf, rows in leaves.items():
        b, n = budgets[leaf], tokens[leaf]
        if not n:
            continue
        for epoch in range(b // n):
            out += [(d, leaf, epoch) for d, _ in rows]
        epoch, rest, at = b // n, b % n, 0
        key = lambda d: hashlib.md5(f"{t.seed}:{epoch}:{'' if d is None else d}".encode()).hexdigest()  # noqa: E731,B023
        groups = defaultdict(list)
        for d, k in rows:
            groups[key(d)].append((d, k))
        for h in sorted(groups):
            if at >= rest:
                break
            out += [(d, leaf, epoch) for d, _ in groups[h]]
            at += sum(k for _, k in groups[h])
    return sorted(out, key=repr)


def check(docs, targets):
    got = mixing.mix(docs, targets).collect()
    a = sorted(((r.doc_id, (r.domain, r.lang, r.source), r.epoch) for r in got), key=repr)
    assert a == brute(docs.select("doc_id", "text", "lang", "source").collect(), targets)


def test_awkward_rows(odd):
    check(odd, mixing.PRODUCTION)
    check(odd, mixing.MixTargets(budget_num=1, budget_den=3, max_epochs=1, seed=5))


def test_documents(spark, small):
    docs = table(spark, small, "documents")
    check(docs, mixing.PRODUCTION)
    check(docs, mixing.MixTargets({"source": {"src1": 9, "src2": 0}}, 1, 2, 3, 1))


def test_empty(none):
    assert mixing.mix(none).count() == 0
    assert mixing.mix_documents(none).columns == none.columns


def test_siblings_take_a_shortage_before_other_domains(spark):
    rows = [(i, "w " * 10, "en", "a0") for i in range(1)] + [(100 + i, "w " * 10, "en", "b0") for i in range(20)]
    rows += [(200 + i, "w " * 10, "en", "c1") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = mixing.MixTargets(budget_num=1, budget_den=2, max_epochs=1)
    units = mixing.measure(docs)
    got = {r.source: r.budget for r in mixing.leaf_budgets(units, targets).collect()}
    # 205 tokens: d0 gets 103 (10 of a0, the rest from its sibling b0), d1 102.
    assert got == {"a0": 10, "b0": 93, "c1": 102}


def test_stage_returns_documents(odd):
    out = mixing.mix_documents(odd)
    assert out.columns == odd.columns and out.count() <= odd.count()


def test_stage_keeps_columns_of_any_name(clashing, unchanged):
    targets = mixing.MixTargets(budget_num=2, budget_den=1, max_epochs=2)
    rows = unchanged(mixing.mix_documents(clashing, targets), clashing)
    assert len(rows) > clashing.count()
