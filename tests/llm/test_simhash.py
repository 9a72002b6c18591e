import random

import numpy as np
import xxhash

from tempora.llm import simhash
from tempora.session import table


def brute_fp(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, radius=4):
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def check(docs, **args):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_groups(docs, **args).collect()), key=repr)
    assert got == brute_groups([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], args.get("radius", 4))


def test_awkward_rows(odd):
    check(odd)


def test_documents(spark, small):
    check(table(spark, small, "documents"))


def test_small_blocks_lose_nothing(spark, small):
    check(table(spark, small, "documents"), block=16)
    check(table(spark, small, "documents"), radius=20, block=40)


def test_chain_of_near_copies(spark):
    r = random.Random(3)
    words = [r.choice("stone river cloud lamp tower field".split()) + str(r.randint(0, 99)) for _ in range(400)]
    rows = []
    for i in range(40):
        words[r.randrange(400)] = f"new{i}"
        rows.append((100 - i, " ".join(words)))
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_tiles_skip_nothing_within_the_radius():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**63, 900, dtype=np.uint64)
    for i in range(0, 600, 2):
        flips = rng.choice(64, rng.integers(0, 6), replace=False)
        fp[i + 1] = fp[i] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64), initial=np.uint64(0))
    forest = simhash.Forest(len(fp))
    tiles = simhash.Tiles(fp, np.arange(len(fp)))
    simhash.link_tiles(tiles, tiles, True, 4, forest)
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 4
    roots = forest.root(np.arange(len(fp)))
    i, j = np.nonzero(near)
    assert (roots[i] == roots[j]).all()
    u, v = forest.edges()
    assert len(u) < len(fp) and len(set(roots.tolist())) == len(fp) - len(u)


def test_empty(none):
    assert simhash.near_groups(none).count() == 0
    assert simhash.drop_near(none).columns == none.columns


def test_stage(odd):
    out = simhash.drop_near(odd)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == odd.columns
    assert 1 in ids and 2 not in ids and 3 in ids and 4 not in ids
    # Of the null ids one is a near copy of row 1 and goes, the other is alone and stays.
    assert ids.count(None) == 1


def brute_stage(rows, radius=4):
    """One row of each component: the smallest doc_id, null last; which of equal ones is left open."""
    fps = [brute_fp(t) for _, t in rows]
    left, components = set(range(len(rows))), []
    while left:
        todo, found = [left.pop()], []
        while todo:
            i = todo.pop()
            found.append(i)
            near = {j for j in left if (fps[i] ^ fps[j]).bit_count() <= radius}
            left -= near
            todo += near
        components.append(found)
    return sorted((min((rows[i][0] is None, rows[i][0]) for i in c), min(fps[i] for i in c)) for c in components)


def check_stage(docs):
    """Exactly one row of every component, and the one with the smallest doc_id."""
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_stage(rows)
    kept = [(r.doc_id, r.text) for r in simhash.drop_near(docs).collect()]
    assert sorted(repr((d is None, d)) for d, _ in kept) == sorted(repr(w[0]) for w in want)
    # No two rows that stay are near, and every row that stays is one of the input.
    fps = [brute_fp(t) for _, t in kept]
    assert all((fps[i] ^ fps[j]).bit_count() > 4 for i in range(len(fps)) for j in range(i))
    assert all(k in rows for k in kept)


def shared_ids(spark):
    """Documents that share their number with unrelated texts, copies and repeated rows."""
    a = " ".join(f"stone{i} river{i * 7}" for i in range(60))
    b, c = (" ".join(f"{w}{i * 3}" for i in range(80)) for w in ("lamp", "cloud"))
    rows = [
        (3, a), (5, a + " "), (5, b), (7, c), (9, c), (9, c), (7, "quite another text of some words"),
        (None, b + "  "), (None, "a text of its own without a number"), (None, "a text of its own without a number"),
        (2, c + " "), (2, c + " "), (2, "the third text of number two, of no component but its own"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_stage_never_drops_another_row_of_the_same_number(spark, odd):
    docs = shared_ids(spark)
    check_stage(docs)
    kept = [(r.doc_id, r.text.split()[0]) for r in simhash.drop_near(docs).collect()]
    assert (5, "lamp0") in kept and (7, "quite") in kept and (2, "the") in kept and len(kept) == 6
    check_stage(odd)


def test_stage_beyond_the_broadcast_bound(spark, odd, monkeypatch):
    import functools

    from tempora.llm import rows

    monkeypatch.setattr(rows, "split", functools.partial(rows.split, bound=0))
    monkeypatch.setattr(rows, "broadcast_if_small", lambda df: df)
    check_stage(shared_ids(spark))
    check_stage(odd)


def test_stage_on_documents(spark, small):
    check_stage(table(spark, small, "documents"))


def test_stage_keeps_columns_of_any_name(clashing, unchanged):
    unchanged(simhash.drop_near(clashing), clashing)
