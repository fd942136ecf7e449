"""DuckDB statements of the queries that SQL can express, over whole tables.

Without one: encoded tokens (1, 4, 7), fitted scores (8, 11), approximate neighbours (6), quantised curves (9) and the pipeline; tests/llm
compares those with plain versions.
"""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

EXACT_SEARCH = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY rank <= 5"""


def secret_scan() -> str:
    from linklens.llm.secrets import RULES

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    parts = []
    for order, rule in enumerate(RULES):
        pattern = quoted(rule.java)
        parts.append(f"""
  SELECT doc_id, text_no, {order} AS rule, '{rule.kind}' AS kind, regexp_extract_all(text, {pattern}, 0) AS m,
         regexp_extract_all(text, {pattern}, {rule.group}) AS v, string_split_regex(text, {pattern}) AS g, {rule.least} AS least FROM t""")
    counts = ", ".join(f"coalesce(count(*) FILTER (WHERE kind = '{r.kind}'), 0) AS n_{r.kind}" for r in RULES)
    return f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS text_no, coalesce(text, '') AS text FROM documents),
hits AS ({" UNION ALL ".join(parts)}),
placed AS (
  SELECT doc_id, text_no, rule, kind, least, unnest(range(1, len(m) + 1)) AS i, m, v, g FROM hits WHERE len(m) > 0),
spans AS (
  SELECT text_no, rule, kind,
         CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS first,
         length(m[i]) AS size
  FROM placed WHERE length(v[i]) >= least),
lists AS (
  SELECT text_no, {counts}, string_agg(kind || ':' || first || ':' || (first + size), ',' ORDER BY first, rule) AS spans
  FROM spans GROUP BY text_no)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES)},
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN lists USING (text_no)"""


NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS s
  FROM w),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT a, b FROM both_ways
  UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.other, s.doc_id)) AS component_id,
       s.doc_id = least(s.doc_id, coalesce(l.other, s.doc_id)) AS kept
FROM sets s LEFT JOIN least l USING (doc_id)"""

MIXTURE = rf"""
WITH r AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         md5('13:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, 'null'))) AS draw
  FROM documents),
src AS (
  SELECT source, sum(size) AS source_size, avg(size) AS mean,
         CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight
  FROM r GROUP BY source),
capped AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio FROM src),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped),
shared AS (SELECT (SELECT level FROM levels WHERE ratio >= level ORDER BY ratio, level DESC LIMIT 1) AS level),
plan AS (
  SELECT l.source, l.source_size, l.mean, least(l.cap, l.weight * coalesce(s.level, 0)) AS target FROM levels l, shared s),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS f, floor(f + 1e-9) AS whole, greatest(0, f - whole) AS part FROM plan),
marked AS (
  SELECT r.*, p.source_size, p.target, p.whole, p.part, r.size > p.mean AS large
  FROM r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source),
running AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, large ORDER BY draw, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
         sum(size) OVER (PARTITION BY source, large) AS words
  FROM marked),
first AS (
  SELECT source, max(done + size) AS reached FROM running
  WHERE large AND done + size / 2 <= part * words GROUP BY source)
SELECT m.doc_id, m.size, CAST(m.source_size AS BIGINT) AS source_size, round(m.target, 6) AS target,
       CAST(m.size * least(m.whole + CASE WHEN m.done + m.size / 2 <= CASE WHEN m.large THEN m.part * m.words ELSE m.part * m.source_size - coalesce(f.reached, 0) END
                                      THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM running m LEFT JOIN first f ON m.source IS NOT DISTINCT FROM f.source"""

# DuckDB has no crc32: the table of one byte, then word for word over distinct words.
IMPORTANCE = r"""
WITH RECURSIVE steps(b, c, k) AS (
  SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
texts AS (
  SELECT 'd' AS side, row_number() OVER () AS no, doc_id, text FROM documents
  UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT side, no, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
found AS (SELECT side, no, word, count(*) AS n FROM words GROUP BY ALL),
spelled AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM found)),
bytes AS (
  SELECT word, list_transform(range(0, length(h) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1) AS b
  FROM spelled),
buckets AS (
  SELECT word, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
  FROM bytes, crc_table),
placed AS (SELECT side, no, bucket, sum(n) AS n FROM found JOIN buckets USING (word) GROUP BY ALL),
counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 't'), 0) AS t FROM placed GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM counts),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST(ss + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(tt + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM counts, sums),
weights AS (
  SELECT no, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight
  FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY no),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:8] AS BIGINT) AS h
  FROM texts LEFT JOIN weights USING (no) WHERE side = 'd'),
noisy AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
placed_rows AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place,
         count(*) FILTER (WHERE n_features >= 20) OVER () AS able FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM placed_rows"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
widths AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS k FROM lists),
runs AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM widths WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM runs GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 30),
inner_runs AS (
  SELECT lang, a, w, k, unnest(range(2, k)) AS width FROM candidates WHERE k > 2),
inner_phrases AS (
  SELECT lang, a, unnest(list_transform(range(1, k - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) AS phrase FROM inner_runs),
most AS (SELECT lang, phrase, max(a) AS most FROM inner_phrases GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN most m USING (lang, phrase) WHERE m.most IS NULL OR 100 * m.most < 80 * c.a),
cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS lp, array_to_string(w[cut + 1:], ' ') AS rp
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.a AS l, r.a AS r, CAST((2000000::HUGEINT * c.a) // (l.a + r.a) AS BIGINT) AS score
  FROM cuts c JOIN f l ON c.lang = l.lang AND c.lp = l.phrase JOIN f r ON c.lang = r.lang AND c.rp = r.phrase),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM weakest JOIN totals USING (lang) QUALIFY rank <= 2000"""

STATEMENTS: dict[str, str] = {
    "op2_exact_search": EXACT_SEARCH.strip(), "op3_secret_scan": secret_scan().strip(),
    "op5_near_duplicates": NEAR_DUPLICATES.strip(), "op10_mixture": MIXTURE.strip(),
    "op12_importance_resampling": IMPORTANCE.strip(), "op13_collocations": COLLOCATIONS.strip(),
}
