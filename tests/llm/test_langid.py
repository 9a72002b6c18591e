import numpy as np

from tempora.llm import langid
from tempora.session import table


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 100
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.98
    assert sum(r.rejected for r in rows) <= 0.005 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_awkward_rows(odd):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    for i in (3, 4, 6):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[5].lang_pred in {"en", "de"}


def test_empty_and_unlabelled(none, odd):
    from pyspark.sql import functions as F

    assert langid.identify(none).count() == 0
    out = langid.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in out.collect()} == {"und"}


def test_lang_and_source_are_no_inputs(spark, small):
    from pyspark.sql import functions as F

    docs = table(spark, small, "documents")
    model = langid.learn(docs)
    predict = langid.predictor(spark, model)
    a = docs.select("doc_id", predict("text").alias("p"))
    b = docs.withColumn("lang", F.lit("xx")).select("doc_id", predict("text").alias("p"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_subwords_do_not_cross_words():
    whole = set(langid.buckets("ab cd").tolist())
    parts = set(langid.buckets("ab").tolist()) | set(langid.buckets("cd").tolist())
    assert whole == parts


def test_stage(spark, odd, small):
    docs = table(spark, small, "documents")
    out = langid.drop_rejected(docs)
    assert out.columns == docs.columns and out.count() >= 0.99 * docs.count()


def test_calibration_on_labels_that_cannot_be_learned():
    """Labels without any relation to the texts: scores near an even chance, and a bar among them, not above."""
    rng = np.random.default_rng(0)
    samples = [(np.array([i % 5]), np.array([1.0], np.float32)) for i in range(40)]
    y = np.array([i % 2 for i in range(40)])
    table_ = np.zeros((langid.BUCKETS, 2), np.float32)
    table_[:5] = rng.normal(size=(5, 2))
    model = langid.calibrate(langid.LanguageModel(["a", "b"], table_, np.zeros(2)), samples, y)
    p = model.softmax(table_[:5].astype(float)).max(axis=1)
    assert model.temperature > 10 and 0 <= model.reject_below <= p.min() + 1e-9


def plain_scores(model, text):
    """One text at a time, subword by subword, in plain Python."""
    letters = set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    found = []
    for word in bytes(b if b >= 128 or b in letters else 32 for b in text.lower().encode()).split():
        word = b" " + word + b" "
        for n in (2, 3, 4):
            for i in range(len(word) - n + 1):
                gram = word[i : i + n]
                if b" " in gram[1:-1]:
                    continue
                code = 0
                for byte in gram:
                    code = (code * 257 + byte) % 2**32
                found.append(((code + n) * 2654435761 % 2**32 >> 17) % langid.BUCKETS)
    mean = sum(model.table[k].astype(float) for k in found) / max(1, len(found))
    z = (mean + model.bias) / model.temperature
    e = np.exp(z - z.max())
    return e / e.sum()


def test_scores_equal_the_plain_form_alone_and_in_batches(monkeypatch):
    rng = np.random.default_rng(5)
    model = langid.LanguageModel(["a", "b"], rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32), rng.normal(size=3), 1.7)
    texts = ["One two three", "é ñandú", "x", "a b c", "12 34", "", " ".join(f"wörd{i}and" for i in range(900)), "y" * 4000]
    want = np.array([plain_scores(model, t) for t in texts])
    assert np.allclose(model.scores(texts), want, atol=1e-5)
    alone = np.vstack([model.scores([t]) for t in texts])
    assert (alone == model.scores(texts)).all()
    monkeypatch.setattr(langid, "GROUP_BYTES", 64)
    assert np.allclose(model.scores(texts), want, atol=1e-5)


def test_calibrated_at_every_size_and_rejects_what_is_no_language(spark):
    """Small and large tables alike: a fitted temperature, and noise and other languages are rejected."""
    foreign = [
        "привет мир как дела сегодня", "これは日本語の文章です", "zzkx qwpt vrrk xkcd lmnp", "To jest zdanie po polsku i nic wicej",
        "Tämä on suomenkielinen lause eikä mitään muuta", "Ez egy magyar mondat, semmi egyéb",
    ]
    for sf in ("0.001", "0.01"):
        docs = table(spark, f"/root/testdata/sf{sf}", "documents")
        model = langid.learn(docs)
        assert 0.2 < model.temperature < 20 and model.temperature != 1.0
        assert 0.5 < model.reject_below < 0.9
        assert model.predict(foreign)[2].all()
        texts = [r.text for r in docs.limit(200).collect() if langid.has_letter(r.text)]
        rng = np.random.default_rng(9)
        shuffled = ["".join(np.array(list(t[:2000]))[rng.permutation(len(t[:2000]))]) for t in texts]
        shuffled = [t for t in shuffled if len(t) > 200]
        assert model.predict(shuffled)[2].mean() > 0.95
        assert model.predict(texts)[2].mean() <= 0.01


def test_rejecting_score_follows_the_tail():
    rng = np.random.default_rng(3)
    score = 1 / (1 + np.exp(-(6 - rng.exponential(1.0, 200_000))))
    got = langid.tail_score(score[:2000], 0.001)
    assert 0.0002 < (score < got).mean() < 0.004
    assert langid.tail_score(np.zeros(0), 0.001) == 0.0
    assert 0 < langid.tail_score(np.array([0.9]), 0.001) <= 0.9


def test_rows_are_bounded_and_every_language_has_some(spark, monkeypatch):
    rows = [(i, f"words of language {i % 25} number {i}", f"l{i % 25:02}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "MAX_ROWS", 60)
    seen = []
    monkeypatch.setattr(langid, "train", lambda samples, y, langs, fit=langid.train: seen.append(len(samples)) or fit(samples, y, langs))
    model = langid.learn(docs)
    # More classes than DIM: the model keeps embeddings and weights.
    assert len(model.langs) == 25 and model.weights is not None and model.table.shape == (langid.BUCKETS, langid.DIM)
    assert seen[0] <= 2 * 60
    got = model.predict(["words of language 3 number 8", None])
    assert got[0][0] in model.langs and got[0][1] == "und"


def test_a_repeated_doc_id_teaches_once(spark, monkeypatch):
    """10,000 rows of one doc_id, of the same text or of different ones, send one row to the driver."""
    from pyspark.sql import functions as F

    few = [(2 * i + 1, f"a plain sentence number {i} in words", "en" if i % 2 else "de") for i in range(40)]
    docs = spark.createDataFrame(few, "doc_id long, text string, lang string")
    hot = spark.range(10_000).select(F.lit(4).cast("long").alias("doc_id"), F.concat(F.lit("sentence "), F.col("id") % 2 * F.col("id")).alias("text"), F.lit("en").alias("lang"))
    got = []
    monkeypatch.setattr(type(docs), "toPandas", lambda self, f=type(docs).toPandas: got.append(f(self)) or got[-1])
    langid.learn(docs.unionByName(hot).repartition(8))
    assert len(got) == 1 and len(got[0]) <= 41 and got[0]["doc_id"].is_unique and 4 in set(got[0]["doc_id"])


def test_features_of_a_text_are_bounded():
    bucket, n = langid.counted(np.array([5, 5, 5, 9, 9, 2, 1]), 2)
    assert (bucket.tolist(), n.tolist()) == ([5, 9], [3, 2])


def test_stage_keeps_columns_of_any_name(clashing, unchanged):
    unchanged(langid.drop_rejected(clashing), clashing)
