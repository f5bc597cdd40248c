"""DuckDB SQL of the text operators that SQL can express."""

SQL: dict[str, str] = {}

SQL["op3_poisson_mix"] = """
WITH RECURSIVE per AS (
  SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS chars FROM documents GROUP BY source),
rates AS (
  SELECT source, CASE WHEN chars > 0 THEN round(pow(chars, 0.7) / (SELECT sum(pow(chars, 0.7)) FROM per)
    * (SELECT sum(chars) FROM per) / chars, 9) ELSE 0 END AS rate FROM per),
steps AS (
  SELECT source, rate, greatest(ceil(rate / 16.0), 1)::INT AS parts, 0 AS k,
    exp(-rate / greatest(ceil(rate / 16.0), 1)) AS term, exp(-rate / greatest(ceil(rate / 16.0), 1)) AS total FROM rates
  UNION ALL
  SELECT source, rate, parts, k + 1, term * (rate / parts) / (k + 1), total + term * (rate / parts) / (k + 1)
  FROM steps WHERE k < 99),
draws AS (
  SELECT d.*, r.parts, j, ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':' || j), 1, 13))::BIGINT::DOUBLE
    / 4503599627370496.0 AS u
  FROM documents d JOIN (SELECT DISTINCT source, parts FROM steps) r ON d.source IS NOT DISTINCT FROM r.source,
    LATERAL (SELECT unnest(range(1, r.parts + 1)) AS j)),
counted AS (
  SELECT doc_id, text, lang, source, n_chars, sum(n) AS n FROM (
    SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.j, count(s.k) AS n
    FROM draws d LEFT JOIN steps s ON s.source IS NOT DISTINCT FROM d.source AND s.total <= d.u
    GROUP BY ALL) GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy,
  ('0x' || substr(md5('7s:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':' || copy), 1, 13))::BIGINT::DOUBLE
    / 4503599627370496.0 AS shuffle_key
FROM counted, LATERAL (SELECT unnest(range(1, n::BIGINT + 1)) AS copy)
"""


SQL["op2_deep_shallow"] = """
WITH base AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM base, LATERAL (SELECT unnest(range(0, n - 49)) AS i) WHERE n >= 50),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (w) WHERE first < doc_id),
edges AS (
  SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hits),
runs AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY ALL),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, s.a AS b, run FROM spans s WINDOW w AS (PARTITION BY doc_id ORDER BY run)
  UNION ALL SELECT doc_id, max(b), 1000000000, max(run) + 1 FROM spans GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * a + 1, (2 * (b - a))::BIGINT), '' ORDER BY run) AS k FROM gaps JOIN base USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM base LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SQL["op4_debruijn_spans"] = r"""
WITH base AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i + 1:i + 13], ' ') AS k FROM base, LATERAL (SELECT unnest(range(0, len(w) - 12)) AS i)
  WHERE len(w) >= 13),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, i + j AS p FROM windows JOIN firsts USING (k), LATERAL (SELECT unnest(range(0, 13)) AS j)
  WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM base),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM base LEFT JOIN kept USING (doc_id)
"""

SQL["op6_blockmax_bm25"] = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?"''()[]',
    'abcdefghijklmnopqrstuvwxyz            '), '[^\x20\x09-\x0D]+')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM words GROUP BY ALL),
len AS (SELECT d.doc_id, coalesce(n, 0) AS n FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM words GROUP BY ALL) USING (doc_id)),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
post AS (
  SELECT doc_id, t, ln(1 + ((SELECT count(*) FROM len) - df + 0.5) / (df + 0.5)) * tf * 2.2
    / (tf + 1.2 * (0.25 + 0.75 * n / (SELECT avg(n) FROM len))) AS s FROM tf JOIN df USING (t) JOIN len USING (doc_id)),
scores AS (
  SELECT q.doc_id AS query_id, p.doc_id, round(sum(q.tf * p.s), 9) AS score FROM tf q JOIN post p USING (t)
  WHERE q.doc_id % 100 = 0 AND p.doc_id <> q.doc_id GROUP BY ALL),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores)
SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

SQL["op13_removal_ranks"] = r"""
WITH base AS (
  SELECT coalesce(doc_id, 9223372036854775807) AS id, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(id) AS first FROM base GROUP BY t),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT row_number() OVER () AS d, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN first < id THEN 'E' ELSE '' END) AS failed
  FROM base JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
ranks AS (
  SELECT part, good, toxic, failed, o, coalesce((SELECT min(strpos(o, x)) FROM (SELECT unnest(string_split(failed, '')) AS x) WHERE x <> ''), 6) AS fall, n
  FROM (SELECT part, good, toxic, failed, count(*) AS n FROM fails GROUP BY ALL), orders),
steps AS (
  SELECT part, o AS filter_order, s AS step, o[s] AS filter,
    sum(CASE WHEN fall > s THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fall = s THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN fall < s AND contains(failed, o[s]) THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN failed = o[s] THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN fall = s AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN fall = s AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM ranks, LATERAL (SELECT unnest(range(1, 6))::INT AS s) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley, filter FROM steps
"""

SQL["op12_multikey_phrases"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
base AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, w[i:i + m - 1] AS p FROM base, LATERAL (SELECT unnest(range(1, 5)) AS m),
    LATERAL (SELECT unnest(range(1, greatest(len(w) - m + 2, 1))) AS i)),
f AS (SELECT lang, p, count(*) AS f FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(p) = 1 GROUP BY lang),
candidates AS (SELECT lang, p, f AS a FROM f WHERE f >= 30 AND len(p) > 1),
cuts AS (SELECT lang, p, a, k, p[1:k] AS head, p[k + 1:] AS tail FROM candidates, LATERAL (SELECT unnest(range(1, len(p))) AS k)),
priced AS (
  SELECT c.lang, c.p, a, k, h.f AS l, t.f AS r, ((2000000::HUGEINT * a) // (h.f + t.f))::BIGINT AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.p = c.head JOIN f t ON t.lang = c.lang AND t.p = c.tail),
worst AS (SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
parts AS (
  SELECT lang, p[i:i + m - 1] AS p, max(a) AS longest FROM candidates, LATERAL (SELECT unnest(range(2, len(p))) AS m),
    LATERAL (SELECT unnest(range(1, len(p) - m + 2)) AS i) GROUP BY ALL),
kept AS (
  SELECT w.*, array_to_string(w.p, ' ') AS phrase FROM worst w LEFT JOIN parts x ON x.lang = w.lang AND x.p = w.p
  WHERE longest IS NULL OR 100::HUGEINT * longest < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score, k AS cut FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
