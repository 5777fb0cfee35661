"""DuckDB SQL of the queries that SQL can express, over the whole tables."""

from __future__ import annotations

import math

from objectlens.llm import rules, suffixes

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _windows(source: str, key: str, n: str | int) -> str:
    """(key, i, win): every window of n words from word i on; a shorter list is one window."""
    return f"SELECT {key}, i, array_to_string(list_slice(w, i, i + least(len(w), {n}) - 1), ' ') AS win FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - {n} + 1, 1) + 1)) AS i FROM {source} WHERE len(w) > 0)"


def decontamination(n: int = suffixes.WINDOW) -> str:
    return f"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, {_ALNUM}) AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, regexp_extract_all({_LOWER.format("text")}, {_ALNUM}) AS w, len(w) AS n_words FROM benchmark),
wins AS (SELECT DISTINCT item_id, win, least(n_words, {n}) AS n FROM ({_windows("items", "item_id, n_words", n)})),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs JOIN sizes ON len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM places JOIN wins USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
  coalesce(m.items_sha256, sha256('')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id"""


def near_duplicates(k: int = 4, percent: int = 80) -> str:
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, {_SPACED}) AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, win FROM ({_windows("docs", "doc_id", k)})),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(win, chr(10) ORDER BY win)) AS print FROM sets GROUP BY doc_id),
reps AS (SELECT print, min(doc_id) AS rep, any_value(n) AS n FROM sizes GROUP BY print),
few AS (SELECT rep, r.n, win FROM reps r JOIN sets s ON s.doc_id = r.rep),
links AS (SELECT a.rep AS u, b.rep AS v FROM few a JOIN few b ON a.win = b.win AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(node, seen) AS (SELECT rep, rep FROM reps UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON b.u = r.seen),
labels AS (SELECT node, min(seen) AS label FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.label, d.doc_id) AS component_id, coalesce(l.label, d.doc_id) = d.doc_id AS kept
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reps r ON r.print = s.print LEFT JOIN labels l ON l.node = r.rep"""


def quality_rules(alpha: float = rules.ALPHA, delta: float = rules.DELTA) -> str:
    """The binomial tails are sums of exp(lgamma ...) and testing stops at a stratum's first failure."""
    count = lambda chars: f"CAST(length(t) - length(regexp_replace(t, '[{chars}]', '', 'g')) AS BIGINT)"
    strata = " ".join(f"WHEN n_words >= {low} THEN {k}" for k, low in reversed(list(enumerate(rules.STRATA))))
    paths = ", ".join(f"len(list_filter([{', '.join(f'{c!r}e0' for c in rules.cutoffs(r))}], lambda c: c >= CAST({a} AS DOUBLE) / greatest({b}, 1)))" for r, (a, b) in rules.RATIOS.items())
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, {_SPACED}) GROUP BY r),
wins AS ({_windows("(SELECT r, w FROM docs WHERE len(w) >= " + str(rules.REPEAT_WINDOW) + ")", "r", rules.REPEAT_WINDOW)}),
repeated AS (SELECT r, i FROM wins QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + {rules.REPEAT_WINDOW})) AS p FROM repeated) GROUP BY r),
counted AS (SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, {count("#*$%&|<>")} AS n_symbols,
  {count("A-Z")} AS n_upper, {count("!?")} AS n_marks, {count("0-9")} AS n_digits, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs d LEFT JOIN lines l ON l.r = d.r LEFT JOIN repeats p ON p.r = d.r),
based AS (SELECT *, CASE {strata} END AS s, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted),
firsts AS (SELECT r, doc_id, s, base_failed, least({paths}) AS first FROM based),
held AS (SELECT s, first, quality FROM firsts JOIN labels USING (doc_id) WHERE quality IN (0, 1) AND NOT base_failed),
levels AS (SELECT s, k, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND first <= k) AS x, count(*) FILTER (quality = 0) AS m, count(*) FILTER (quality = 0 AND first <= k) AS y
  FROM held, (SELECT unnest(range({rules.LEVELS})) AS k) GROUP BY s, k),
tails AS (SELECT *, list_sum(list_transform(range(0, x + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * {math.log(alpha)!r}e0 + (n - i) * {math.log1p(-alpha)!r}e0))) > {delta / len(rules.STRATA)!r}e0 AS failed FROM levels),
safe AS (SELECT s, k, CAST(y AS DOUBLE) / greatest(m, 1) - CAST(x AS DOUBLE) / greatest(n, 1) AS gain FROM (SELECT *, bool_or(failed) OVER (PARTITION BY s ORDER BY k) AS stopped FROM tails) WHERE NOT stopped),
chosen AS (SELECT s, k FROM safe WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY s ORDER BY gain DESC, k) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f.base_failed AS base_failed, NOT f.base_failed AND (c.k IS NULL OR f.first > c.k) AS kept
FROM (SELECT * EXCLUDE (base_failed, s) FROM based) b JOIN (SELECT * EXCLUDE (doc_id) FROM firsts) f USING (r) LEFT JOIN chosen c ON c.s = f.s"""


def oracle_sql() -> dict[str, str]:
    return {"op8_suffix_decontamination": decontamination(), "op9_minmax_dedup": near_duplicates(), "op10_quality_rules": quality_rules()}
