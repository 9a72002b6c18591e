import numpy as np

from tempora.llm import toxicity
from tempora.session import table

SF = "/root/testdata/sf0.1"


def test_agrees_with_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = toxicity.score_toxicity(docs, labels).withColumnRenamed("toxic", "pred").join(labels, "doc_id").collect()
    hits = [r for r in rows if r.pred]
    assert sum(r.toxic for r in hits) / len(hits) >= 0.97
    assert sum(r.pred for r in rows if r.toxic) / sum(r.toxic for r in rows) >= 0.85


def test_held_out_rows(spark):
    """Fitted on the rows of four residues of doc_id, measured on the fifth."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    chain = toxicity.learn(docs, labels.where("doc_id % 5 <> 0"))
    rows = toxicity.predict(docs, chain).withColumnRenamed("toxic", "pred").join(labels.where("doc_id % 5 = 0"), "doc_id").collect()
    hits = [r for r in rows if r.pred]
    assert sum(r.toxic for r in hits) / len(hits) >= 0.95
    assert sum(r.pred for r in rows if r.toxic) / sum(r.toxic for r in rows) >= 0.75


def test_awkward_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (99, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(odd, labels).count() == odd.count()
    rows = toxicity.score_toxicity(odd, labels.limit(0)).collect()
    assert {r.p_toxic for r in rows} == {0.0} and not any(r.toxic for r in rows)
    assert toxicity.score_toxicity(none, labels).count() == 0


def test_later_models_see_out_of_fold_scores():
    rng = np.random.default_rng(0)
    n = 600
    first = rng.integers(0, 2, n)
    lists = [np.array([0] if f else [1]) for f in first]
    x = toxicity.Rows.build(lists, np.zeros((n, 3)), 2)
    labels = np.stack([first, first], axis=1).astype(float)
    chain = toxicity.fit_chain([b"a", b"b"], x, labels, np.arange(n) % toxicity.FOLDS)
    assert len(chain.models) == 2 and len(chain.models[1].v) == 4
    p = chain.probabilities(x)
    assert ((p[1] > 0.5) == (first == 1)).mean() > 0.95


def test_rows_dot_and_back_match_dense():
    rng = np.random.default_rng(1)
    lists = [rng.choice(7, rng.integers(0, 5), replace=False) for _ in range(9)]
    x = toxicity.Rows.build(lists, rng.normal(size=(9, 2)), 7)
    dense = np.zeros((9, 7))
    for i, r in enumerate(lists):
        dense[i, r] = 1
    w, v, g = rng.normal(size=7), rng.normal(size=2), rng.normal(size=9)
    assert np.allclose(x.dot(w, v), dense @ w + x.dense @ v)
    assert np.allclose(x.back(g)[0], dense.T @ g)


def dense_fit(x, extra, y, steps=toxicity.STEPS, l2=toxicity.L2):
    """The same regression on plain matrices: words whose shares differ enough, Adam over all rows."""
    n1, n0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    share1, share0 = x[y == 1].sum(axis=0) / n1, x[y == 0].sum(axis=0) / n0
    p = x.sum(axis=0) / (n1 + n0)
    error = np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    chosen = np.abs(share1 - share0) >= toxicity.MIN_Z * error
    full = np.hstack([x * chosen, extra])
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w, b = np.zeros(full.shape[1]), np.log(rate / (1 - rate))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        g = 1 / (1 + np.exp(-np.clip(full @ w + b, -30, 30))) - y
        grad = np.append(full.T @ g + l2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return lambda rows, more: np.hstack([rows * chosen, more]) @ w + b


def test_chain_equals_plain_matrices():
    """Every model of the chain, its out-of-fold inputs and its probabilities, against dense algebra."""
    rng = np.random.default_rng(4)
    n, width = 500, 40
    labels = np.stack([rng.integers(0, 2, n), rng.integers(0, 2, n)], axis=1).astype(float)
    labels[:, 1] = np.where(rng.random(n) < 0.8, labels[:, 0], labels[:, 1])
    x = (rng.random((n, width)) < 0.1 + 0.4 * labels[:, :1] * (np.arange(width) < 8)).astype(float)
    dense, fold = rng.random((n, 3)), rng.integers(0, toxicity.FOLDS, n)
    rows = toxicity.Rows.build([np.flatnonzero(r) for r in x], dense, width)
    chain = toxicity.fit_chain([b"%d" % i for i in range(width)], rows, labels, fold)
    earlier_fit, earlier_new = np.zeros((n, 0)), np.zeros((n, 0))
    for k in range(2):
        more = np.hstack([dense, earlier_fit])
        outside = np.zeros(n)
        for f in range(toxicity.FOLDS):
            model = dense_fit(x[fold != f], more[fold != f], labels[fold != f, k])
            outside[fold == f] = model(x[fold == f], more[fold == f]).clip(-8, 8)
        z = dense_fit(x, more, labels[:, k])(x, np.hstack([dense, earlier_new])).clip(-8, 8)
        assert np.allclose(chain.probabilities(rows)[k], 1 / (1 + np.exp(-z)), atol=1e-6)
        earlier_fit, earlier_new = np.column_stack([earlier_fit, outside]), np.column_stack([earlier_new, z])


def test_every_row_is_scored_by_the_chain(spark, small):
    """The query's rows against the chain applied text by text, word by word."""
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    chain = toxicity.learn(docs, labels)
    assert chain.models
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in toxicity.score_toxicity(docs, labels).collect():
        found = toxicity.tokens(texts[r.doc_id])
        extra = toxicity.measures(texts[r.doc_id], found)
        p = []
        for model in chain.models:
            z = model.bias + sum(model.w[chain.words[w]] for w in found if w in chain.words) + float(np.dot(extra, model.v))
            z = min(8.0, max(-8.0, z))
            extra = [*extra, z]
            p.append(1 / (1 + np.exp(-z)))
        assert np.allclose([r.p_low_quality, r.p_toxic], p, atol=1e-9)
        assert [r.low_quality, r.toxic] == [a >= t for a, t in zip(p, chain.thresholds)]


def test_labels_that_differ_teach_the_same_every_time(spark, small):
    docs = table(spark, small, "documents")
    labels = table(spark, small, "labels")
    twice = labels.unionByName(labels.selectExpr("doc_id", "quality", "1 - toxic AS toxic"))
    least = labels.selectExpr("doc_id", "quality", "0 AS toxic")
    a, b = toxicity.learn(docs, twice.repartition(7)), toxicity.learn(docs, least)
    assert a.words == b.words and all(np.allclose(x.w, y.w) for x, y in zip(a.models, b.models))


def test_a_repeated_doc_id_teaches_once(spark, monkeypatch):
    """10,000 rows of one doc_id, of the same text or of different ones, send one row to the driver."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"some words of text number {i} here") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    hot = spark.range(10_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("other words "), F.col("id") % 2 * F.col("id")).alias("text"))
    got = []
    monkeypatch.setattr(type(docs), "toPandas", lambda self, f=type(docs).toPandas: got.append(f(self)) or got[-1])
    toxicity.learn(docs.unionByName(hot).repartition(8), labels)
    assert len(got) == 1 and len(got[0]) <= 30 and got[0]["doc_id"].is_unique
