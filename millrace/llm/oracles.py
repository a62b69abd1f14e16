"""DuckDB SQL for the operators whose whole result SQL can express on whole tables.

The others need what SQL lacks: retrieval (1), a tokenizer (3), XXH64 (4), fitted models (5, 8), rounding in hashed buckets (7),
nested encodings (9); tests compare them with brute force."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
lines AS (SELECT r, count(*) AS n_lines, count(DISTINCT line) AS n_distinct FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
wins AS (SELECT r, i, list_slice(w, i, i + 7) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM t)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM wins) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT i + j) AS n FROM again, range(8) x(j) GROUP BY r),
m AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines - n_distinct, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
    (length(text) - length(replace(text, '!!', ''))) // 2 + (length(text) - length(replace(text, '??', ''))) // 2
      + (length(text) - length(replace(text, '...', ''))) // 3 + length(text) - length(replace(text, '…', '')) AS n_marks
  FROM t LEFT JOIN repeated USING (r) LEFT JOIN lines USING (r)),
f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
      + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars > 25 * n_words OR word_chars < 2 * n_words THEN 16 ELSE 0 END
      + CASE WHEN n_words >= 20 AND 100 * n_upper > 40 * n_letters THEN 32 ELSE 0 END + CASE WHEN n_words >= 20 AND 10 * n_marks > 3 * n_words THEN 64 ELSE 0 END AS fail_bits
  FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, fail_bits = 0 AS kept, 'v1' AS policy, CAST(fail_bits AS BIGINT) AS fail_bits, CAST(n_lines AS BIGINT) AS n_lines,
  CAST(n_upper AS BIGINT) AS n_upper, CAST(n_letters AS BIGINT) AS n_letters, CAST(n_marks AS BIGINT) AS n_marks
FROM f
"""

OP6 = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
wins AS (SELECT r, doc_id, i, md5_number(b[i + 1 : i + 50]) AS k FROM (SELECT r, doc_id, b, unnest(range(0, n - 49)) AS i FROM t)),
hits AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY k) AS low FROM wins) WHERE low < doc_id),
runs AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM hits)),
spans AS (SELECT r, min(i) AS a, max(i) + 50 AS e FROM runs GROUP BY r, run),
cuts AS (SELECT r, e AS a, lead(a) OVER (PARTITION BY r ORDER BY a) AS e FROM (SELECT r, a, e FROM spans UNION ALL SELECT r, -1, 0 FROM t)),
kept AS (SELECT r, string_agg(hex(b[cuts.a + 1 : coalesce(cuts.e, n)]), '' ORDER BY cuts.a) AS h FROM cuts JOIN t USING (r) WHERE coalesce(cuts.e, n) > cuts.a GROUP BY r),
sums AS (SELECT r, sum(e - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM t LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""

OP10 = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
wins AS (SELECT r, doc_id, i, list_slice(w, i, i + 12) AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t)),
hits AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY k) AS low FROM wins) WHERE low < doc_id),
gone AS (SELECT DISTINCT r, i + j AS p FROM hits, range(13) x(j)),
starts AS (SELECT r, count(*) AS n_removed, sum(CASE WHEN p - before = 1 THEN 0 ELSE 1 END) AS n_spans FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM gone) GROUP BY r),
left_over AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS kept FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM t) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans
FROM t LEFT JOIN starts USING (r) LEFT JOIN left_over USING (r)
"""
