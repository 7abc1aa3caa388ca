"""SQL with the same results, for the queries of this folder that SQL can express."""

from gainsieve.llm.quality import BOILERPLATE, MARKED_END, ODD

_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"
_SOLID = r"length(regexp_replace({t}, '[\x20\x09-\x0D]', '', 'g'))"
_PHRASE = " OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_WORDS.format(t="t")} AS w FROM d),
spread AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM w),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM spread WHERE i <= len(w) - 2),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, nr, line FROM (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS nr FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
told AS (SELECT *, len({_WORDS.format(t="line")}) AS words,
  len(regexp_extract_all(line || ' ', '{MARKED_END}')) AS marked,
  len(regexp_extract_all(line, '[|»«›‹·•→>]')) AS signs,
  {_SOLID.format(t="line")} AS solid FROM lines),
judged AS (SELECT doc_id, line, solid,
  (length(line) <= 300 AND ({_PHRASE}))
  OR (regexp_matches(line, '{ODD}') AND (signs >= 3 OR (marked > 0 AND marked >= 0.3 * words)
    OR (signs >= 1 AND words <= 12 AND NOT regexp_matches(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[.!?…:;。！？]["''”’»)\]]*$')))) AS bad
  FROM told),
per AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (bad) AS n_bad, coalesce(sum(solid) FILTER (NOT bad), 0) AS clean FROM judged GROUP BY doc_id),
base AS (SELECT w.doc_id, len(w) AS n_words, {_SOLID.format(t="t")} AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_bad, 0) AS n_bad_lines, coalesce(clean, 0) AS clean_chars
  FROM w LEFT JOIN per USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND clean_chars >= 0.5 * word_chars AS kept,
  CAST(n_lines AS BIGINT) AS n_lines, CAST(n_bad_lines AS BIGINT) AS n_bad_lines, CAST(clean_chars AS BIGINT) AS clean_chars
FROM base
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

COLLOCATIONS = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
runs AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
    FROM w, (SELECT unnest(range(1, 6)) AS m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 100),
found AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS s FROM f WHERE m > 1),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM found),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS score
    FROM cuts c JOIN total USING (lang)
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(s[1 : k], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(s[k + 1 :], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
starts AS (SELECT lang, a, s, m, unnest(range(1, m)) AS i FROM found WHERE m > 2),
inner_runs AS (SELECT lang, a, array_to_string(s[i : j], ' ') AS phrase
    FROM (SELECT *, unnest(range(i + 1, m + 1)) AS j FROM starts) WHERE j - i + 1 < m),
covered AS (SELECT DISTINCT lowest.lang, lowest.phrase FROM lowest JOIN inner_runs b ON b.lang = lowest.lang AND b.phrase = lowest.phrase WHERE 100 * b.a >= 100 * lowest.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest ANTI JOIN covered USING (lang, phrase))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""

VECTOR_LINKS = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
able AS (SELECT * FROM v WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reached AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM reached r JOIN pairs p ON p.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON least.a = vec_id LEFT JOIN links ON links.a = vec_id
"""
