"""DuckDB SQL for the queries of this subpackage that SQL can express.

Written from the contracts, without the operators' own detours: no digests to
shorten work, no buckets, no screens.
"""

from __future__ import annotations

import string

from tempora.llm import mixing, quality

BLANKS = r"[\x20\x09-\x0D]+"

EXACT_DEDUP = f"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS norm
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""


def _bits() -> str:
    return " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(quality.RULES.values()))


QUALITY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '{BLANKS}'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '{BLANKS}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id)
SELECT *, CAST({_bits()} AS BIGINT) AS rule_bits,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 3 * n_words) AS kept
FROM m
"""


def _weight(level: str, weights: dict[str, int]) -> str:
    return "CASE " + level + "".join(f" WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _share(name: str, children: str, parent: tuple[str, ...], level: str, weights: dict[str, int]) -> str:
    """CTEs that split each parent's budget among children(parent.., level, cap, budget)."""
    part = f"PARTITION BY {', '.join(parent)}" if parent else ""
    cols = ", ".join((*parent, level))
    w = _weight(level, weights) if weights else "1"
    return f"""
{name}_a AS (SELECT *, {w} AS w FROM ({children}) WHERE cap > 0 AND {w} > 0),
{name}_b AS (
  SELECT *,
    CAST(cap AS HUGEINT) * (sum(w) OVER ({part})
        - coalesce(sum(w) OVER ({part} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      <= (budget - coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {level}
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * CAST(w AS HUGEINT) AS is_full
  FROM {name}_a),
{name}_c AS (
  SELECT *,
    CASE WHEN is_full THEN CAST(cap AS HUGEINT) ELSE
      (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part})) * w
      // sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part}) END AS flo
  FROM {name}_b),
{name} AS (
  SELECT {cols}, CAST(flo + CASE WHEN NOT is_full
      AND row_number() OVER ({part} ORDER BY is_full, {level}) <= budget - sum(flo) OVER ({part})
      THEN 1 ELSE 0 END AS BIGINT) AS budget
  FROM {name}_c)"""


def _mixing(t: mixing.MixTargets) -> str:
    e = t.max_epochs
    return rf"""
WITH u AS (
  SELECT doc_id,
    'd' || coalesce(try_cast(nullif(regexp_extract(coalesce(source, '(none)'), '([0-9]{{1,9}})$', 1), '') AS BIGINT) % 4, 0)
      AS domain,
    coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n) AS tokens FROM u GROUP BY ALL),
{_share("s1", f"SELECT domain, sum(tokens) * {e} AS cap, (SELECT sum(tokens) * {t.budget_num} // {t.budget_den} FROM leaves) AS budget FROM leaves GROUP BY domain", (), "domain", t.weights.get("domain", {}))},
{_share("s2", f"SELECT domain, lang, sum(tokens) * {e} AS cap, any_value(budget) AS budget FROM leaves JOIN s1 USING (domain) GROUP BY domain, lang", ("domain",), "lang", t.weights.get("lang", {}))},
{_share("s3", f"SELECT domain, lang, source, tokens * {e} AS cap, budget FROM leaves JOIN s2 USING (domain, lang)", ("domain", "lang"), "source", t.weights.get("source", {}))},
plan AS (
  SELECT l.domain, l.lang, l.source, CAST(coalesce(budget, 0) AS BIGINT) AS budget,
    CASE WHEN tokens > 0 THEN CAST(coalesce(budget, 0) // tokens AS BIGINT) ELSE 0 END AS whole,
    CASE WHEN tokens > 0 THEN coalesce(budget, 0) % tokens ELSE 0 END AS rest
  FROM leaves l LEFT JOIN s3 USING (domain, lang, source)),
keyed AS (
  SELECT u.*, budget, whole, rest,
    md5('{t.seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM u JOIN plan USING (domain, lang, source)),
placed AS (
  SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
          - sum(n) OVER (PARTITION BY domain, lang, source, k) AS before
  FROM keyed)
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, n AS n_tokens, budget AS leaf_budget
FROM (
  SELECT *, unnest(range(0, whole + CASE WHEN rest > 0 AND before < rest THEN 1 ELSE 0 END)) AS epoch
  FROM placed)
"""


DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
occ AS (SELECT row_id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT row_id) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM occ JOIN kept USING (lang, term) GROUP BY ALL),
full_c AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
  FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT lang, source, term, n,
         1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p
  FROM full_c JOIN v USING (lang)),
lp AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang) + v) AS p
  FROM (SELECT lang, term, sum(n) AS n FROM full_c GROUP BY ALL) JOIN v USING (lang)),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - lp.p) * (p.p - lp.p) // lp.p AS value
  FROM p JOIN lp USING (lang, term) WHERE p.n > 0 AND p.p > lp.p),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""


COLLOCATIONS = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang HAVING sum(len(w)) > 0),
f AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, w[i : i + k - 1] AS ws, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 5) AS r(k))
  GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT * FROM f WHERE k > 1),
cut AS (SELECT lang, phrase, ws, k, f AS a, unnest(range(1, k)) AS s FROM c),
scored AS (
  SELECT cut.lang, cut.phrase, cut.k, cut.a, x.f AS l, y.f AS r, 2000000::HUGEINT * a // (x.f + y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.ws = cut.ws[1:s] JOIN f y ON y.lang = cut.lang AND y.ws = cut.ws[s+1:cut.k]
  QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY 2000000::HUGEINT * a // (x.f + y.f), s) = 1),
kept AS (
  SELECT * FROM scored WHERE NOT EXISTS (
    SELECT 1 FROM c WHERE c.lang = scored.lang AND c.k > scored.k AND 100 * c.f >= 80 * scored.a
      AND contains(' ' || c.phrase || ' ', ' ' || scored.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
       phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""


ORACLES: dict[str, str] = {
    "op13_collocations": COLLOCATIONS,
    "op11_divergence": DIVERGENCE,
    "op2_mixing": _mixing(mixing.PRODUCTION),
    "op6_quality": QUALITY,
    "op7_exact_dedup": EXACT_DEDUP,
}


def _ablations() -> str:
    cases = [
        f"('{version}', '{rule}', {quality.mask(rules)}, {quality.mask([rule])})"
        for version, rules in quality.POLICIES.items()
        for rule in rules
    ]
    return f"""
WITH q AS ({QUALITY})
SELECT policy, rule,
       CAST(count(*) FILTER (rule_bits & mask <> 0) AS BIGINT) AS rejected,
       CAST(count(*) FILTER (rule_bits & mask = bit) AS BIGINT) AS only_by_rule
FROM q, (VALUES {", ".join(cases)}) AS c(policy, rule, mask, bit)
GROUP BY policy, rule
"""


REPORT_ORACLES = {"quality_ablations": _ablations()}
