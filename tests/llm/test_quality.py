import re
from collections import Counter

from tempora.llm import quality
from tempora.session import table


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text)
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), symbols, dup, len(covered), failed, not (failed or 10 * symbols > 3 * n)


def check(docs):
    got = quality.apply_policy(quality.ledger(docs), "v2").collect()
    a = sorted(
        ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got),
        key=repr,
    )
    b = sorted(((r.doc_id, *brute(r.text)) for r in docs.select("doc_id", "text").collect()), key=repr)
    assert a == b


def test_awkward_rows(odd):
    check(odd)


def test_documents(spark, small):
    check(table(spark, small, "documents"))


def test_windows(spark):
    eight = " ".join("abcdefgh")
    rows = [(1, eight), (2, f"{eight} {eight}"), (3, f"x {eight} y {eight} z"), (4, "a " * 40), (5, "a\n\na\n \n a\na")]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_empty(none):
    assert quality.ledger(none).count() == 0


def test_ablations_equal_a_second_pass(odd):
    led = quality.ledger(odd)
    rows = led.collect()
    for r in quality.ablations(led).collect():
        rules, bit = quality.mask(quality.POLICIES[r.policy]), quality.mask([r.rule])
        assert r.rejected == sum(1 for x in rows if x.rule_bits & rules)
        assert r.only_by_rule == sum(1 for x in rows if x.rule_bits & rules == bit)


def test_ablation_query_equals_sql(spark, small):
    import duckdb

    from tempora.llm.oracles import REPORT_ORACLES
    from tempora.llm.queries import REPORTS

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    columns = ["policy", "rule", "rejected", "only_by_rule"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({REPORT_ORACLES['quality_ablations']})").fetchall()
    got = REPORTS["quality_ablations"](spark, small).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 11
    assert any(r[2] > r[3] > 0 for r in want)


def test_no_ablations_of_nothing(none):
    assert quality.ablation_report(none).count() == 0
