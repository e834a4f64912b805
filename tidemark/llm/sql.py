"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tidemark.llm.host_rules import Limits

_L = Limits()
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

# Measures of documents: the measures and the verdicts of host_rules, over a table or view `documents`.
JUDGED = rf"""
docs AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS body FROM documents),
words AS (SELECT rid, regexp_extract_all(body, '{WORD}') AS w FROM docs),
windows AS (
  SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)),
repeated AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM repeated) GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS n, count(DISTINCT line) AS d
  FROM (SELECT rid, unnest(string_split(body, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '{WORD}') GROUP BY rid),
measured AS (
  SELECT d.*, len(w.w) AS n_words, length(regexp_replace(d.body, '{SPACE}', '', 'g')) AS word_chars,
    length(regexp_replace(d.body, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(l.n - l.d, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines
  FROM docs d JOIN words w USING (rid) LEFT JOIN lines l USING (rid) LEFT JOIN covered c USING (rid)),
failing AS (
  SELECT *, n_words < {_L.min_words} OR 100 * n_repeat_words > {_L.repeat_percent} * n_words AS base_failed,
    (100 * n_symbols > {_L.symbol_percent} * n_words)::INT + (100 * n_symbols > {_L.severe_symbol_percent} * n_words)::INT
    + (100 * n_dup_lines > {_L.dup_line_percent} * n_lines)::INT
    + (word_chars > {_L.longest_mean_word} * n_words)::INT AS soft
  FROM measured),
hosts AS (
  SELECT source AS host, count(*) AS n, sum((base_failed OR soft > 0)::INT)::DOUBLE AS f FROM failing GROUP BY source),
totals AS (SELECT sum(n)::DOUBLE AS n, sum(f) / sum(n) AS p, count(*) AS k, sum(f * f / n) AS q FROM hosts),
spread AS (SELECT *, (q - n * p * p) / n - p * (1 - p) * k / n AS v FROM totals),
strength AS (
  SELECT greatest(least(p, 1 - 1e-6), 1e-6) AS p,
    CASE WHEN v > 0 THEN least(greatest(p * (1 - p) / v - 1, 1.0), 1e6) ELSE 1e6 END AS m FROM spread),
verdicts AS (
  SELECT host, CASE WHEN (f + p * m) / (n + m) >= {_L.closed_rate} THEN -1
    WHEN (f + p * m) / (n + m) >= {_L.strict_rate} THEN 0 ELSE 1 END AS tolerance FROM hosts, strength),
judged AS (
  SELECT f.*, NOT base_failed AND soft <= tolerance AS kept
  FROM failing f JOIN verdicts v ON f.source IS NOT DISTINCT FROM v.host)
"""

MIXED = rf"""
sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT AS place
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS w
  FROM sized GROUP BY source),
filled AS (
  SELECT *, (1.5 * sum(source_size) OVER ()
      - 2 * coalesce(sum(source_size) OVER (ORDER BY 2 * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 2 * source_size / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    2 * source_size / w AS full_at
  FROM sources),
level AS (SELECT min_by(level, full_at) AS level FROM filled WHERE level <= full_at),
targets AS (
  SELECT source, source_size, least(2.0 * source_size, coalesce(w * (SELECT level FROM level), 2.0 * source_size))::DOUBLE AS target
  FROM filled),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
    target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest FROM targets),
places AS (
  SELECT source, place, sum(size) AS size,
    sum(sum(size)) OVER (PARTITION BY source ORDER BY place) AS upto FROM sized GROUP BY source, place),
ends AS (
  SELECT p.source, min_by(struct_pack(place := place, rest := rest - upto + size, size := size), place) AS at
  FROM places p JOIN budgets b ON p.source IS NOT DISTINCT FROM b.source WHERE upto > rest GROUP BY p.source),
mix AS (
  SELECT s.doc_id, s.size, b.source_size, b.target,
    (b.whole + CASE WHEN s.place < e.at.place + (2 * e.at.rest >= e.at.size)::BIGINT THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
  LEFT JOIN ends e ON s.source IS NOT DISTINCT FROM e.source)
"""

# Every order of five filters, played on counts of documents by part and failed filters.
AUDITED = rf"""
docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), min(d.doc_id) OVER (PARTITION BY t) IS NOT NULL) AS e,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM docs d LEFT JOIN marks m ON d.doc_id = m.doc_id),
masks AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(good) AS good,
    sum(toxic) AS toxic FROM failing GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (
  SELECT filter_order, i::INT AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before
  FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS i FROM orders)),
played AS (
  SELECT part, filter_order, step, bit,
    sum(n * (mask & (before | bit) = 0)::INT) AS kept,
    sum(n * (mask & bit != 0 AND mask & before = 0)::INT) AS removed,
    sum(n * (mask & bit != 0 AND mask & before != 0)::INT) AS redundant,
    sum(n * (mask = bit)::INT) AS unique_fails,
    sum(good * (mask & bit != 0 AND mask & before = 0)::INT) AS good_lost,
    sum(toxic * (mask & bit != 0 AND mask & before = 0)::INT) AS toxic_lost
  FROM masks, steps GROUP BY ALL)
"""

# Units of a text as a list, cut at two places.
FILLED = r"""
units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
    ('0x' || h[17:24])::BIGINT % 100 AS p, ('0x' || h[25:32])::BIGINT % 100 AS s FROM units),
parts AS (
  SELECT *, array_to_string(u[1:least(x, y)], '') AS pre, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS mid,
    array_to_string(u[greatest(x, y) + 1:], '') AS post,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR p >= 90 THEN 'plain'
      WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
filled AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || post || '<M>' || mid
    ELSE '<S>' || post || '<P>' || pre || '<M>' || mid END AS o FROM parts)
"""

TWINS = {
    "op4_quality_rules": f"""WITH {JUDGED}
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
          n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, kept FROM judged""",
    "op6_mixing": f"""WITH {MIXED}
        SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size)::BIGINT AS taken FROM mix""",
    "op11_filter_audit": f"""WITH {AUDITED}
        SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
          unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
          (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM played""",
    "op13_fill_in_middle": f"""WITH {FILLED}
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form != 'plain' THEN length(pre) END AS prefix_chars,
          CASE WHEN form != 'plain' THEN length(mid) END AS middle_chars, sha256(o) AS output_sha256,
          sha256(t) AS restored_sha256 FROM filled""",
}
