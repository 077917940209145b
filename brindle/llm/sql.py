"""Operators in SQL (DuckDB), for those whose results SQL can express on whole tables.

op1 tells every 400-byte string apart by a digest of 128 bits; op5 takes the
element at rank ceil(p * n) for a quartile, which a summary returns exactly
while its group has no more rows than its accuracy.
"""

from __future__ import annotations

from brindle.llm.quality import FENCES
from brindle.llm.spans import LEAST_WORDS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a string that must not occur twice, and rows judged by their own group.
LENGTH, MIN_GROUP = 400, 100

SUFFIX_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
strings AS (
  SELECT r, i, md5(b[i:i + {LENGTH - 1}]) AS h
  FROM (SELECT r, b, unnest(range(1, octet_length(b) - {LENGTH - 2})) AS i FROM d WHERE octet_length(b) >= {LENGTH})),
repeated AS (SELECT h FROM strings GROUP BY h HAVING count(*) > 1),
starts AS (SELECT r, i FROM strings SEMI JOIN repeated USING (h)),
firsts AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS first FROM starts),
numbered AS (SELECT r, i, sum(first) OVER (PARTITION BY r ORDER BY i) AS k FROM firsts),
spans AS (SELECT r, k, min(i) AS a, max(i) + {LENGTH} AS e FROM numbered GROUP BY r, k),
pieces AS (
  SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 1) AS lo, a - 1 AS hi, e - a AS gone, 1 AS span FROM spans
  UNION ALL SELECT r, max(e), NULL, 0, 0 FROM spans GROUP BY r
  UNION ALL SELECT r, 1, NULL, 0, 0 FROM d WHERE r NOT IN (SELECT r FROM spans)),
kept AS (SELECT d.r, doc_id, octet_length(b) AS n, lo, gone, span, hex(b[lo:coalesce(hi, octet_length(b))]) AS part FROM pieces JOIN d USING (r))
SELECT any_value(doc_id) AS doc_id, any_value(n)::BIGINT AS n_bytes, sum(gone)::BIGINT AS n_removed, sum(span)::BIGINT AS n_spans,
  sha256(unhex(string_agg(part, '' ORDER BY lo, span DESC))) AS kept_sha256
FROM kept GROUP BY r
"""

DECONTAMINATION = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 8) AS n, array_to_string(w[i:i + 7], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
met AS (SELECT r, p.n, i, item FROM places p JOIN windows v ON p.n = v.n AND p.s = v.s),
hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, n, i FROM met)) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN found USING (r)
"""


def _outside() -> str:
    """The metrics' tests against the fences of a row's group."""
    tests = []
    for f in FENCES:
        low, high = f"q.{f.metric}[1]", f"q.{f.metric}[2]"
        margin = f"greatest(({high} - {low}) * {f.spreads}, {f.floor}::DOUBLE)"
        tests.append(f"{f.metric} < {low} - {margin}" if f.low else f"{f.metric} > {high} + {margin}")
    return " OR ".join(f"coalesce({t}, false)" for t in tests)


def _fences() -> str:
    metrics = sorted({f.metric for f in FENCES})
    ranks = ", ".join(f"'{m}': list_transform([0.25, 0.75], lambda p: list_sort(list({m}))[ceil(p * count(*))::BIGINT])" for m in metrics)
    return f"count(*) AS n, {{{ranks}}} AS q"


QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
places AS (SELECT r, i, words[i:i + 2] AS s FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM places) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM twice) GROUP BY r),
counts AS (
  SELECT r, doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered c USING (r)),
ratios AS (
  SELECT *, coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
    coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_ratio, coalesce(word_chars / nullif(n_words, 0), 0) AS word_length,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM counts),
fine AS (SELECT lang AS l, source AS s, {_fences()} FROM ratios WHERE NOT base_failed GROUP BY lang, source),
coarse AS (SELECT lang AS l, {_fences()} FROM ratios WHERE NOT base_failed GROUP BY lang),
judged AS (
  SELECT ratios.*, CASE WHEN fine.n >= {MIN_GROUP} THEN fine.q ELSE coarse.q END AS q
  FROM ratios LEFT JOIN fine ON lang IS NOT DISTINCT FROM fine.l AND source IS NOT DISTINCT FROM fine.s LEFT JOIN coarse ON lang IS NOT DISTINCT FROM coarse.l)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_outside()}) AS kept
FROM judged
"""

#: White space and the end of a sentence as in brindle.llm.spans; one private code point parts the sentences.
_WS, _CUT = r"[\t\n\x0b\f\r ]", "chr(57344)"

SENTENCE_SPANS = rf"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM documents),
parts AS (
  SELECT r, doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?]+["'')\]]*{_WS}+|{_WS}*\n{_WS}*)', '\1' || {_CUT}, 'g'), {_CUT}), lambda x: x <> '') AS s
  FROM d),
bare AS (SELECT r, doc_id, list_transform(s, lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')) AS b FROM parts),
counted AS (SELECT r, doc_id, b, list_transform(b, lambda x: len(regexp_extract_all(x, '[^\t\n\x0b\f\r ]+'))) AS w FROM bare),
sums AS (SELECT *, list_transform(w, lambda x, i: list_sum(w[1:i])::BIGINT) AS c FROM counted WHERE len(w) > 0),
starts AS (SELECT r, doc_id, b, c, w, unnest(range(1, len(b) + 1)) AS i FROM sums),
ends AS (SELECT r, doc_id, b, i, len(list_filter(c, lambda x: x - c[i] + w[i] < {LEAST_WORDS})) + 1 AS e FROM starts),
spans AS (
  SELECT r, doc_id, i, e, md5(array_to_string(b[i:e], chr(10))) AS h FROM ends WHERE e <= len(b)
  UNION ALL SELECT r, doc_id, 1, len(b), md5(array_to_string(b, chr(10))) FROM sums WHERE c[-1] BETWEEN 1 AND {LEAST_WORDS} - 1),
ranked AS (SELECT r, i, e, row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS LAST, r, i) AS k FROM spans),
gone AS (SELECT r, list(DISTINCT j) AS js FROM (SELECT r, unnest(range(i, e + 1)) AS j FROM ranked WHERE k > 1) GROUP BY r)
SELECT d.* EXCLUDE (r) REPLACE (CASE WHEN js IS NULL THEN text ELSE array_to_string(list_filter(s, lambda x, j: NOT list_contains(js, j)), '') END AS text),
  len(s)::BIGINT AS n_sentences, coalesce(len(js), 0)::BIGINT AS n_removed
FROM d JOIN parts USING (r) LEFT JOIN gone USING (r)
"""
