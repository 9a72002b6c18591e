import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tempora.llm import collocations
from tempora.session import table

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, least, top=2000):
    """Every phrase of every piece, as the contract says it."""
    f, n = defaultdict(Counter), Counter()
    for r in docs:
        lang = "und" if r.lang is None else r.lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (r.text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in cands.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longest[p[i : i + k]] = max(longest[p[i : i + k]], a)
        rows = []
        for p, a in cands.items():
            if 100 * longest[p] >= 80 * a and longest[p]:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, i, p.decode(), -a, l, r, n[lang], -score))
    return out


def rows(df):
    got = [tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(set(got)) == len(got)
    return set(got)


def test_equals_brute_force(spark, small):
    docs = table(spark, small, "documents")
    want = brute(docs.collect(), 30)
    assert want and rows(collocations.mine(docs)) == want


def test_small_counts_ties_and_overlaps(spark):
    texts = [("x", "a a a a a. A a\tb  c, b c"), ("x", "b c! b c d e f: b c d e f"), (None, "a\rb\x0bc"), ("x", None), ("x", " \t "), ("und", "a b. a b"), ("y", "é É ß é É ß é É ß")]
    docs = spark.createDataFrame(texts * 3, "lang string, text string")
    for least in (2, 3, 7):
        assert rows(collocations.mine(docs, least)) == brute(docs.collect(), least)
    assert rows(collocations.mine(docs, 2, 3)) == brute(docs.collect(), 2, 3)


def test_awkward_rows(odd, none, clashing):
    assert rows(collocations.mine(odd, 2)) == brute(odd.collect(), 2)
    assert collocations.mine(none).count() == 0
    assert rows(collocations.mine(clashing, 3)) == brute(clashing.collect(), 3)


def test_requests_are_answered_alike_beyond_the_broadcast(spark, small, monkeypatch):
    docs = table(spark, small, "documents")
    want = rows(collocations.mine(docs, 10))
    monkeypatch.setattr(collocations, "is_small", lambda df: False)
    assert rows(collocations.mine(docs, 10)) == want


def test_a_bucket_is_counted_beyond_its_memory(monkeypatch):
    """Spilled to the scratch folder or not, a bucket's sums are the same, and nothing stays behind."""
    import glob
    import tempfile

    monkeypatch.setattr(collocations, "MEMORY", "40MB")
    words = [f"word number {i} of a bucket that is far larger than its memory" for i in range(400_000)]
    one = pa.RecordBatch.from_arrays([pa.array(["l"] * len(words)), pa.array(words), pa.array(np.arange(len(words)), pa.int64())], schema=collocations._COUNTS)
    before = set(glob.glob(f"{tempfile.gettempdir()}/phrases-*"))
    got = Counter()
    for batch in collocations.bucket_counts(iter([one, one]), 100, collocations._COUNTS):
        for r in batch.to_pylist():
            got[r["phrase"]] += r["w"]
    assert len(got) == len(words) - 50 and got[words[70]] == 140
    assert set(glob.glob(f"{tempfile.gettempdir()}/phrases-*")) == before


def test_the_bitmap_holds_every_frequent_phrase(spark):
    rows = {"lang": pa.array(["l"] * 15_000), "piece": pa.array([f"w{i} v{i % 7}" for i in range(15_000)])}
    words = collocations.Words(rows, "piece")
    h = words.hashes(words.starts(2), 2)
    assert len(set(h.tolist())) == 15_000
    known = collocations.frequent(spark.createDataFrame([(int(x),) for x in h[:5000].view(np.int64)], "h long"))
    assert known.has(h[:5000]).all() and known.has(h[5000:]).mean() < 0.1


def test_bitmaps_that_let_all_through_change_nothing(spark, small, monkeypatch):
    docs = table(spark, small, "documents")
    want = rows(collocations.mine(docs))
    monkeypatch.setattr(collocations, "frequent", lambda hashes: collocations.Frequent(np.full(1 << 12, 255, np.uint8), 15))
    assert rows(collocations.mine(docs)) == want
