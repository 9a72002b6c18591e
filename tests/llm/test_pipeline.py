import string

from test_mixing import brute as brute_mix
from test_simhash import brute_groups

import corpus_pipeline
from tempora.llm import langid, mixing
from tempora.llm.queries import QUERIES
from tempora.session import table

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}


def brute(docs, model):
    """doc_ids that reach the packing: each stage by its own brute force, over lists of rows."""
    rows = [r for r in docs.collect() if not model.predict([r.text])[2][0]]
    best = {}
    for r in rows:
        text = r.text.translate(LOWER)
        if text not in best or best[text].doc_id < r.doc_id:
            best[text] = r
    rows = sorted(best.values(), key=lambda r: r.doc_id)
    groups = brute_groups([(r.doc_id, r.text) for r in rows])
    first = {d for d, _, component in groups if d == component}
    rows = [r for r in rows if r.doc_id in first]
    return {d for d, _, _ in brute_mix(rows, mixing.PIPELINE)}


def test_run_equals_brute_force(spark, small):
    """run() packs just the documents that brute force keeps, each of their tokens once."""
    docs = table(spark, small, "documents")
    want = brute(docs, langid.learn(docs))
    pieces = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in pieces} == want and 0 < len(want) < docs.count()
    covered, filled = {}, {}
    for r in pieces:
        covered.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(covered) == len(want)
    for spans, total in [(v, k[1]) for k, v in covered.items()] + [(v, None) for v in filled.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == total if total is not None else at <= 4096


def test_run_equals_the_stages(spark, small):
    """run() and the stages called one by one keep the same documents."""
    docs = table(spark, small, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
    out = corpus_pipeline.run(spark, small)
    assert out.columns[0] == "doc_id"
    total = lambda df: {r.doc_id: r.doc_tokens for r in df.select("doc_id", "doc_tokens").collect()}
    assert total(out) == total(corpus_pipeline.STAGES[-1][1](spark, docs, small))


def test_run_leaves_only_what_its_result_reads(spark, small, monkeypatch, tmp_path):
    import os

    from tempora.plans import materialize

    monkeypatch.setattr(materialize, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert corpus_pipeline.run(spark, small).count() > 0
    assert [n.rsplit("-", 1)[0] for n in os.listdir(tmp_path)] == ["pipeline-mixing"]


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
