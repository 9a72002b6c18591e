import itertools
import random
import sys

from tempora.llm import token_counts
from tempora.llm.queries import tokenizer_file
from tempora.session import table

sys.setrecursionlimit(10_000)
PATH = tokenizer_file("piece_bpe_32k.model")


def best(model, word):
    """Every segmentation, by recursion over suffixes: least (cost, tokens)."""
    text, seen = token_counts.MARK + word, {}

    def at(i):
        if i == len(text):
            return (0.0, 0)
        if i not in seen:
            n = len(text[i].encode())
            options = [(at(i + 1)[0] + n * model.byte, at(i + 1)[1] + n)]
            for j in range(i + 1, len(text) + 1):
                if text[i:j] in model.cost:
                    options.append((at(j)[0] + model.cost[text[i:j]], at(j)[1] + 1))
            seen[i] = min(options)
        return seen[i]

    return at(0)


def test_walk_finds_the_least_cost():
    model = token_counts.Unigram.from_file(PATH)
    r = random.Random(2)
    words = {"".join(r.choices("thereadingé中😀_-.1", k=r.randint(1, 14))) for _ in range(400)}
    words |= {"a", "the", "thereafter", "therefore", "x" * 300}
    for word, tokens in model.walk(sorted(words)):
        assert tokens == best(model, word)[1], word


def test_walk_breaks_ties_by_fewer_tokens():
    """Costs that add up exactly alike: the count is the least over all cheapest segmentations."""
    model = token_counts.Unigram(["a", "b", "ab", "abab", "▁", "▁a"])
    model.cost = {p: float(c) for p, c in {"a": 1, "b": 1, "ab": 2, "abab": 4, "▁": 1, "▁a": 2}.items()}
    for piece, cost in model.cost.items():
        node = model.trie
        for c in piece:
            node = node[0][c]
        node[1] = cost
    model.byte = 50.0
    words = sorted({"".join(w) for n in range(1, 8) for w in itertools.product("ab", repeat=n)})
    for word, tokens in model.walk(words):
        assert tokens == best(model, word)[1], word


def test_documents(spark, small):
    model = token_counts.Unigram.from_file(PATH)
    docs = table(spark, small, "documents")
    got = {r.doc_id: (r.n_pretokens, r.n_distinct, r.n_tokens) for r in token_counts.count_tokens(docs, PATH).collect()}
    counts = {}
    for r in docs.collect():
        words = r.text.split()
        for w in words:
            if w not in counts:
                counts[w] = best(model, w)[1]
        assert got.pop(r.doc_id) == (len(words), len(set(words)), sum(counts[w] for w in words))
    assert not got


def test_awkward_rows(odd):
    rows = token_counts.count_tokens(odd, PATH).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[3].n_tokens == by[4].n_tokens == by[6].n_tokens == 0
    assert by[5].n_pretokens == 60_000 and by[5].n_tokens > 60_000


def test_empty(none):
    assert token_counts.count_tokens(none, PATH).count() == 0


def test_store_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    model = token_counts.Unigram.from_file(PATH)
    first = model.count(["alpha beta gamma delta", "alpha"])
    model.count(["one two three four five"])
    assert model.count(["alpha beta gamma delta", "alpha"]) == first
