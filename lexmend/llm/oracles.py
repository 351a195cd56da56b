"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from lexmend.llm.quality_rules import EDGES, STOP_WORDS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AND row_number() OVER (PARTITION BY coalesce(text, ''), doc_id) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

_stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS.split())))
_edges = EDGES.replace("'", "''")

QUALITY_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
           FROM documents),
windows AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM again) GROUP BY r),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
             len(list_filter(w, lambda x: trim(lower(x), '{_edges}') IN ({_stop}))) AS n_stop_words
      FROM d LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(word_chars / n_words BETWEEN 1.5 AND 20 AND n_symbols / n_words <= 0.3 AND n_stop_words / n_words >= 0.01, true)
       AND coalesce(n_dup_lines / nullif(n_lines, 0) <= 0.4, true) AS kept
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
"""

SOURCE_MIXING = f"""
WITH RECURSIVE b AS (
  SELECT row_number() OVER () AS n, doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, CAST(524288 // (512 + strlen(coalesce(text, ''))) AS BIGINT) AS x,
         (CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, '')) || '/7')[1:13] AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * x)::BIGINT AS pull FROM b GROUP BY source),
c AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
                 / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, pull, least(cap, weight * (SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, level LIMIT 1)) AS target FROM l),
r AS (SELECT *, least(target / greatest(source_size, 1)::DOUBLE, 3.0::DOUBLE) AS ratio FROM t),
f AS (SELECT *, floor(ratio) AS whole, ratio - floor(ratio) AS f, target - floor(ratio) * source_size AS left_over FROM r),
p AS (SELECT n, doc_id, b.source, size, source_size, target, whole, left_over, u, f,
             greatest(1e-9::DOUBLE, least(1 - 1e-9::DOUBLE, f + (x - pull::DOUBLE / greatest(source_size, 1)::DOUBLE) / 1024::DOUBLE * least(f, 1 - f))) AS p
      FROM b JOIN f ON b.source IS NOT DISTINCT FROM f.source),
q AS (SELECT n, source, size, left_over, row_number() OVER (PARTITION BY source ORDER BY (u / (1 - u)) / (p / (1 - p)), doc_id NULLS FIRST, n) AS i FROM p WHERE f > 0 AND size > 0),
-- One step takes documents in the order of their ranks, without those too long for what is left, up to the first that doesn't fit any more.
g AS (
  SELECT DISTINCT source, left_over, 0::BIGINT AS done, 0::BIGINT AS i, 0 AS k FROM q
  UNION ALL
  SELECT source, left_over, max(upto)::BIGINT, max(i)::BIGINT, k + 1 FROM (
    SELECT g.source, g.left_over, g.k, q.i, g.done + sum(q.size) OVER (PARTITION BY g.source ORDER BY q.i) AS upto
    FROM g JOIN q ON g.source IS NOT DISTINCT FROM q.source AND q.i > g.i AND g.done + q.size <= g.left_over)
  WHERE upto <= left_over GROUP BY source, left_over, k),
d AS (SELECT q.n FROM q JOIN g a ON q.source IS NOT DISTINCT FROM a.source AND q.i > a.i AND a.done + q.size <= a.left_over
      JOIN g z ON z.source IS NOT DISTINCT FROM a.source AND z.k = a.k + 1 AND q.i <= z.i)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN d.n IS NULL THEN 0 ELSE 1 END) * size AS BIGINT) AS taken FROM p LEFT JOIN d ON p.n = d.n
"""

ORACLES = {
    "op4_source_mixing": SOURCE_MIXING,
    "op7_exact_dedup": EXACT_DEDUP,
    "op8_quality_rules": QUALITY_RULES,
}
