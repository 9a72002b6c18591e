import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as hs
from tokenizers import Tokenizer

from tempora.llm import packing
from tempora.llm.queries import tokenizer_file
from tempora.session import table

PATH = tokenizer_file("word_bpe_49k.json")


def check(docs, capacity=4096, most_padding=1.0):
    rows = packing.pack(docs, PATH, capacity).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, ids))
    # Documents with the same doc_id are told apart by their length and pieces.
    byid = {}
    for r in rows:
        byid.setdefault(r.doc_id, []).append(r)
    for doc_id in {d for d, _ in want}:
        texts = sorted(len(i) for d, i in want if d == doc_id)
        pieces = byid.pop(doc_id)
        assert sum(p.length for p in pieces) == sum(texts)
        assert sorted(p.doc_tokens for p in pieces if p.start == 0) == texts
        known = {(len(i), s): i for d, i in want if d == doc_id for s in [0]}
        for p in pieces:
            if texts.count(p.doc_tokens) == 1:
                ids = known[(p.doc_tokens, 0)][p.start : p.start + p.length]
                assert p.ids_crc32 == zlib.crc32(ids.tobytes()) and len(ids) == p.length
    assert not byid
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    used = sum(r.length for r in rows)
    assert 1 - used / (capacity * max(1, len(sequences))) <= most_padding


def test_awkward_rows(odd):
    check(odd)


def test_documents(spark, small):
    check(table(spark, small, "documents").coalesce(1), most_padding=0.03)


def test_empty(none):
    assert packing.pack(none, PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(hs.integers(1, 20_000), hs.sampled_from([16, 100, 4096]))
def test_cuts_cover_and_fit(n, capacity):
    pieces = packing.cuts(n, capacity)
    assert sum(length for length, _ in pieces) == n
    assert all(0 < length * k <= capacity for length, k in pieces)


def test_words_equal_the_tokenizer_on_awkward_text():
    tokenizer, words = Tokenizer.from_file(PATH), packing.WordTokens(PATH)
    r = random.Random(1)
    pool = [chr(c) for c in range(0x20, 0x7F)] + list("'''stréÉÜßÿŁǅ²½ªº–’“…€\n\t\r     ́İ中😀Σ\x1c\x0b") + ["<|endoftext|>"]
    texts = ["".join(r.choices(pool, k=r.randint(0, 50))) for _ in range(1500)]
    for text, ids in zip(texts, words.ids(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_store_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    words = packing.WordTokens(PATH)
    for i in range(5):
        list(words.ids([f"alpha{i} beta{i} gamma{i} delta{i}"]))
    assert len(words.known) <= 16


def test_every_simple_character_beside_others():
    """Capitals whose lower case lies in another block, such as the schwa, are tokenized whole."""
    tokenizer = Tokenizer.from_file(PATH)
    words = packing.WordTokens(PATH)
    around = [chr(c) for span in packing._SPANS for c in span]
    texts = [f"{c}a {a}{c} {c}1{c}.{c} x{c}" for c in around for a in ("z", "<", "'", "É")]
    texts += ["Əliyev Ɔkɔ Ɛfa ȺȾ", "a\u0301 b\x85c\xa0d\x1ce", "<|endoftext|> it's"]
    for text, ids in zip(texts, words.ids(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
