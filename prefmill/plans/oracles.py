"""The same results as plain SQL on the given tables, for checking."""

from __future__ import annotations

from ..sources.text import AGE_GROUPS, OCCUPATIONS

EV = """ev0 AS (
  SELECT event_id, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS item_id,
    CAST(1 + (CASE WHEN value >= 11 THEN 1 ELSE 0 END) + (CASE WHEN value >= 25 THEN 1 ELSE 0 END)
      + (CASE WHEN value >= 45 THEN 1 ELSE 0 END) + (CASE WHEN value >= 80 THEN 1 ELSE 0 END) AS DOUBLE) AS rating,
    CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type
  FROM events),
r AS (SELECT user_id, item_id, rating, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, event_id DESC, rating DESC) AS rn
  FROM ev0) WHERE rn = 1)"""

LI = """li0 AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(1 + floor((l_quantity - 1) / 10) AS DOUBLE) AS rating,
    CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts, l_orderkey, l_linenumber
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
r AS (SELECT user_id, item_id, rating, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, item_id
    ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, rating DESC) AS rn
  FROM li0) WHERE rn = 1)"""

def md5_role(digest: str) -> str:
    return f"CASE WHEN ('0x' || substr(md5({digest}), 1, 8))::BIGINT % 1000 < 800 THEN 'train' ELSE 'test' END"



SPLIT = """s AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY ts, user_id, item_id)
    <= CAST(floor((SELECT count(*) FROM r) * CAST(0.8 AS DOUBLE)) AS BIGINT) THEN 'train' ELSE 'test' END AS role FROM r),
train AS (SELECT * FROM s WHERE role = 'train'),
test AS (SELECT * FROM s WHERE role = 'test')"""

# star products of the training ratings: 25 times the item Gram matrix
GRAM = """g AS (SELECT a.item_id AS row, b.item_id AS col, sum(a.rating * b.rating) AS v
  FROM train a JOIN train b ON a.user_id = b.user_id GROUP BY 1, 2)"""

XS = """xs AS (SELECT t.user_id, g.col AS item_id, sum(t.rating * g.v) AS v
  FROM train t JOIN g ON t.item_id = g.row GROUP BY 1, 2)"""

SCORED = """sc AS (SELECT t.user_id, t.item_id, coalesce(xs.v, 0) / 125 AS score, t.rating,
    CASE WHEN t.rating >= 3 THEN 1 ELSE 0 END AS label
  FROM test t LEFT JOIN xs ON xs.user_id = t.user_id AND xs.item_id = t.item_id)"""

CURVE = """c0 AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM sc GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c0)"""

SGRAM = """s0 AS (SELECT a.item_id AS row, b.item_id AS col, sum(a.rating * b.rating) / 25 AS v
  FROM r a JOIN r b ON a.user_id = b.user_id GROUP BY 1, 2)"""

CROSS = """x1 AS (SELECT user_id, item_id FROM r WHERE rating >= 3),
y1 AS (SELECT user_id, item_id FROM r WHERE rating < 3),
a0 AS (SELECT y1.item_id AS row, x1.item_id AS col, CAST(count(*) AS DOUBLE) AS v
  FROM y1 JOIN x1 ON y1.user_id = x1.user_id GROUP BY 1, 2)"""

FAR = """far AS (SELECT y1.user_id, a0.col AS item_id, sum(a0.v) AS v FROM y1 JOIN a0 ON y1.item_id = a0.row GROUP BY 1, 2)"""

# dense graded training matrices over all users and items
DENSE = """u AS (SELECT DISTINCT user_id FROM r), i AS (SELECT DISTINCT item_id FROM r),
xy AS (SELECT u.user_id, i.item_id, coalesce(t.rating, 0) / 5 AS x, (6 - coalesce(t.rating, 0)) / 5 AS y
  FROM u CROSS JOIN i LEFT JOIN train t ON t.user_id = u.user_id AND t.item_id = i.item_id),
sm AS (SELECT a.item_id AS row, b.item_id AS col, sum(a.x * b.x) AS v FROM xy a JOIN xy b ON a.user_id = b.user_id GROUP BY 1, 2),
am AS (SELECT a.item_id AS row, b.item_id AS col, sum(a.y * b.x) AS v FROM xy a JOIN xy b ON a.user_id = b.user_id GROUP BY 1, 2)"""


def top(k: int, hide: bool = True) -> str:
    seen = "WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = xs.user_id AND t.item_id = xs.item_id)" if hide else ""
    return f"""top AS (SELECT * FROM (SELECT user_id, item_id, v, row_number() OVER (
    PARTITION BY user_id ORDER BY v DESC, item_id DESC) AS rank FROM xs {seen}) WHERE rank <= {k})"""


def w(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def case(column: str, names: dict) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items())
    return f"CASE {column} {whens} END"


# similarity scaled over all cells / over positive cells
SIM_ALL = """b AS (SELECT least(min(v), CASE WHEN count(*) < (SELECT count(DISTINCT item_id) * count(DISTINCT item_id) FROM train)
    THEN 0 ELSE min(v) END) AS lo, max(v) AS hi FROM g),
sim AS (SELECT row, col, (v - lo) / (hi - lo) AS s FROM g, b)"""
SIM_POS = """b AS (SELECT min(v) AS lo, max(v) AS hi FROM g WHERE v > 0),
sim AS (SELECT row, col, CASE WHEN v > 0 THEN (v - lo) / (hi - lo) ELSE 0 END AS s FROM g, b)"""
PAIRS = """pairs AS (SELECT p.user_id, p.item_id AS item_a, q.item_id AS item_b, 1 - coalesce(sim.s, 0) AS distance
  FROM top p JOIN top q ON p.user_id = q.user_id AND p.rank < q.rank
  LEFT JOIN sim ON sim.row = p.item_id AND sim.col = q.item_id)"""
USER_DIV = "ud AS (SELECT user_id, round(avg(distance), 6) AS diversity FROM pairs GROUP BY 1)"
DIV10 = w(EV, SPLIT, GRAM, XS, top(10, False), SIM_ALL, PAIRS, USER_DIV)
DIV50 = w(EV, SPLIT, GRAM, XS, top(50), SIM_POS, PAIRS, USER_DIV)

PAGERANK_START = """e0 AS (SELECT DISTINCT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
e AS (SELECT src, dst FROM e0 UNION ALL SELECT dst, src FROM e0),
deg AS (SELECT src, count(*) AS n FROM e GROUP BY 1),
k0 AS (SELECT src AS id, CAST(1 AS DOUBLE) AS rank FROM deg)"""


def pagerank_round(i: int) -> str:
    return f"""k{i} AS (SELECT k.id, 0.15 + 0.85 * coalesce(sum(p.rank / deg.n), 0) AS rank
  FROM k0 k LEFT JOIN e ON e.dst = k.id LEFT JOIN k{i - 1} p ON p.id = e.src LEFT JOIN deg ON deg.src = e.src GROUP BY 1)"""


def pearson(item: str, having: str = "") -> str:
    return f"""q AS (SELECT {item} AS item),
nu AS (SELECT count(DISTINCT user_id) AS n FROM r),
t AS (SELECT user_id, rating AS x FROM r, q WHERE item_id = item),
tx AS (SELECT sum(x) AS sx, sum(x * x) AS sxx FROM t),
m AS (SELECT item_id, sum(rating) AS sy, sum(rating * rating) AS syy, coalesce(sum(rating * x), 0) AS sxy,
    count(*) AS n_ratings, avg(rating) AS mean_rating
  FROM r LEFT JOIN t ON t.user_id = r.user_id GROUP BY 1 {having}),
c AS (SELECT item_id, (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS pearson, n_ratings, mean_rating
  FROM m, nu, tx WHERE (n * sxx - sx * sx) * (n * syy - sy * sy) <> 0)
SELECT item_id, round(pearson, 6) AS pearson, n_ratings, round(mean_rating, 6) AS mean_rating, p_name AS title
FROM (SELECT * FROM c ORDER BY round(pearson, 9) DESC, item_id LIMIT 10) c LEFT JOIN part ON p_partkey = item_id"""


REVIEWS = """rv AS (SELECT l.doc_id, CAST(1 + 2 * quality + (1 - toxic) + (n_chars % 2) AS INTEGER) AS score, text AS summary
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

_digit3 = """d AS (SELECT *, CASE WHEN dg < 6 THEN 'train' WHEN dg < 8 THEN 'validation' ELSE 'test' END AS role
  FROM (SELECT *, CAST(floor(ts / {unit}) AS BIGINT) % 10 AS dg FROM r))"""

_two_sided = """,
yam AS (SELECT xy.user_id, am.col AS item_id, sum(xy.y * am.v) AS v FROM xy JOIN am ON am.row = xy.item_id GROUP BY 1, 2)"""

SQL = {
    "read_ratings": w(EV) + "SELECT user_id, item_id, rating, ts FROM r",
    "read_items": "SELECT p_partkey AS item_id, p_name AS title, replace(p_type, ' ', '|') AS genres FROM part",
    "read_users": f"""WITH c AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
        CAST(list_extract([1, 18, 25, 35, 45, 50, 56], CAST(c_custkey % 7 + 1 AS INTEGER)) AS INTEGER) AS age_code,
        CAST(c_custkey % 21 AS INTEGER) AS occupation_code, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS zip FROM customer)
      SELECT *, {case('age_code', AGE_GROUPS)} AS age, {case('occupation_code', OCCUPATIONS)} AS occupation FROM c""",
    "read_tags": w(EV) + "SELECT user_id, item_id, event_type AS tag, ts FROM ev0",
    "read_personal_ratings": w(EV) + """SELECT user_id, item_id, rating, ts, p_name AS title
      FROM r JOIN part ON p_partkey = item_id WHERE rating >= 2""",
    "read_titles": """SELECT p_partkey AS item_id, CAST(1990 + p_size AS DOUBLE) AS year,
      p_name || ', édition ' || p_brand AS name FROM part""",
    "block_rows_forward_fill": w(EV) + """SELECT user_id, item_id, rating,
      strftime(DATE '1970-01-01' + CAST(ts // 86400 AS INTEGER), '%Y-%m-%d') AS date FROM r""",
    "reviews_select": w(REVIEWS) + "SELECT score, summary FROM rv WHERE score <> 3",
    "review_label": w(REVIEWS) + """SELECT score, CASE WHEN score < 3 THEN 'negative' ELSE 'positive' END AS sentiment,
      count(*) AS n FROM rv WHERE score <> 3 GROUP BY 1, 2""",
    "reg_click_join": """SELECT 'u' || o_orderkey AS uuid, CAST(o_custkey AS VARCHAR) AS customer_id,
      strftime(o_orderdate, '%Y-%m-%d') AS reg_date, strftime(l_shipdate, '%Y-%m-%d') AS click_date,
      l_linenumber AS landing_page, CAST(o_custkey % 90 AS DOUBLE) AS lat, CAST(o_custkey % 180 AS DOUBLE) AS lon
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "ratings_dedup": w(LI) + "SELECT * FROM r",
    "xoy_graded": w(EV) + """SELECT user_id, item_id, rating / 5 AS x, least(greatest(rating, 0.0), 1.0)::DOUBLE AS o,
      (6 - rating) / 5 AS y FROM r""",
    "xoy_binary": w(EV) + """SELECT user_id, item_id, CASE WHEN rating >= 3 THEN 1 ELSE 0 END AS x, 1 AS o,
      CASE WHEN rating >= 3 THEN 0 ELSE 1 END AS y FROM r""",
    "label_scale": w(EV) + "SELECT user_id, item_id, rating / 5 AS label FROM r",
    "sigmoid": w(EV) + "SELECT user_id, item_id, round(1 / (1 + exp(-(rating - 3))), 6) AS p FROM r",
    "genre_counts": """SELECT genre, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS genre FROM part) GROUP BY 1""",
    "validate_ratings": """WITH e AS (SELECT CASE WHEN value < 1 THEN -1 ELSE floor(value / 10) END AS v FROM events)
      SELECT CASE WHEN v BETWEEN 1 AND 5 THEN 'stored' WHEN v <= 0 THEN 'skipped' ELSE 'rejected' END AS status,
        count(*) AS n, sum(CASE WHEN v BETWEEN 1 AND 5 THEN v END) AS stars FROM e GROUP BY 1""",
    "activity_trim": w(LI) + """, ic AS (SELECT item_id, count(*) AS n FROM r GROUP BY 1),
      uc AS (SELECT user_id, count(*) AS n FROM r GROUP BY 1),
      f AS (SELECT (SELECT round_even(quantile_cont(n, 0.7), 0) FROM ic) AS fi, (SELECT round_even(quantile_cont(n, 0.7), 0) FROM uc) AS fu)
      SELECT user_id, item_id, rating, ts FROM r JOIN ic USING (item_id) JOIN uc USING (user_id), f
      WHERE ic.n >= fi AND uc.n >= fu""",
    "concat_vectors": w(EV) + """, o AS (SELECT max(item_id) + 1 AS k FROM r)
      SELECT user_id AS row, item_id AS col, round(rating / 5, 6) AS value, 1 AS block FROM r
      UNION ALL SELECT user_id, item_id + k, round((6 - rating) / 5 * 0.2::DOUBLE, 6), 2 FROM r, o""",
    "blend_scores": w(EV, CROSS, FAR) + """, bx AS (SELECT min(rating / 5) AS lo, max(rating / 5) AS hi FROM r),
      bf AS (SELECT min(v) AS lo, max(v) AS hi FROM far WHERE v > 0)
      SELECT r.user_id, r.item_id, round((rating / 5 - bx.lo) / (bx.hi - bx.lo)
        + 0.5 * coalesce((far.v - bf.lo) / (bf.hi - bf.lo), 0), 6) AS score
      FROM r LEFT JOIN far ON far.user_id = r.user_id AND far.item_id = r.item_id, bx, bf""",
    "split_by_digit": w(EV) + "SELECT user_id, item_id, rating, CASE WHEN ts % 10 < 8 THEN 'train' ELSE 'test' END AS role FROM r",
    "split_by_digit3": w(LI, _digit3.format(unit=86400)) + "SELECT user_id, item_id, rating, role FROM d",
    "split_by_time": w(LI, SPLIT) + "SELECT user_id, item_id, ts, role FROM s",
    "split_by_time3": w(EV) + """, p AS (SELECT *, row_number() OVER (ORDER BY ts, user_id, item_id) AS pos,
        count(*) OVER () * CAST(0.6 AS DOUBLE) AS a, count(*) OVER () * CAST(0.8 AS DOUBLE) AS b FROM r)
      SELECT CASE WHEN pos <= floor(a) THEN 'train' WHEN pos <= floor(b) THEN 'validation' ELSE 'test' END AS role,
        count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, sum(rating) AS stars FROM p GROUP BY 1""",
    "split_by_hash": w(LI) + f"SELECT user_id, item_id, rating, {md5_role("concat_ws('|', user_id, item_id, 42)")} AS role FROM r",
    "sample_cells": w(EV) + """SELECT user_id, item_id, rating FROM r
      ORDER BY md5(concat_ws('|', user_id, item_id, 0)), user_id, item_id LIMIT 50""",
    "reviews_split": w(REVIEWS) + f"""SELECT CASE WHEN score > 3 THEN 'positive' ELSE 'negative' END AS sentiment, summary,
      {md5_role("concat_ws('|', summary, 42)")} AS role FROM rv WHERE score <> 3""",
    "job_reviews": w(REVIEWS) + f"""SELECT CASE WHEN score > 3 THEN 'positive' ELSE 'negative' END AS sentiment,
      {md5_role("concat_ws('|', summary, 42)")} AS role, count(*) AS n FROM rv WHERE score <> 3 GROUP BY 1, 2""",
    "job_cv_subsets": w(EV) + """, p AS (SELECT *, row_number() OVER (ORDER BY user_id, item_id) - 1 AS pos,
        count(*) OVER () // 5 AS size, row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS nth FROM r)
      SELECT 'r' || (1 + least(pos // size, 4)) AS fold, 'test' AS role, count(*) AS n FROM p GROUP BY 1
      UNION ALL SELECT 'ra', CASE WHEN nth <= 10 THEN 'test' ELSE 'train' END, count(*) FROM p GROUP BY 2
      UNION ALL SELECT 'rb', CASE WHEN nth BETWEEN 11 AND 20 THEN 'test' ELSE 'train' END, count(*) FROM p GROUP BY 2""",
    "five_fold": w(LI) + """, p AS (SELECT *, row_number() OVER (ORDER BY user_id, item_id) - 1 AS pos,
        count(*) OVER () // 5 AS size FROM r)
      SELECT user_id, item_id, CAST(1 + least(pos // size, 4) AS INTEGER) AS fold FROM p""",
    "allbut_split": w(EV) + """SELECT user_id, item_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY item_id)
        BETWEEN 1 AND 10 THEN 'test' ELSE 'train' END AS role FROM r""",
    "allbut_split_capped": w(EV) + """, p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS nth FROM r),
      t AS (SELECT *, CASE WHEN nth BETWEEN 11 AND 20 THEN row_number() OVER (
        PARTITION BY nth BETWEEN 11 AND 20 ORDER BY user_id, item_id) END AS k FROM p)
      SELECT user_id, item_id, CASE WHEN k <= 500 THEN 'test' ELSE 'train' END AS role FROM t""",
    "every_nth": w(LI) + """SELECT pos, user_id, item_id, rating FROM (
        SELECT *, row_number() OVER (ORDER BY user_id, item_id) - 1 AS pos FROM r) WHERE pos % 50 = 0""",
    "join_pred_label": w(EV, SPLIT) + """, m AS (SELECT item_id, avg(rating) AS score FROM train GROUP BY 1)
      SELECT user_id, item_id, round(score, 6) AS score, rating, CASE WHEN rating >= 3 THEN 1 ELSE 0 END AS label
      FROM test JOIN m USING (item_id)""",
    "user_favourites": w(EV) + "SELECT item_id, p_name AS title FROM r LEFT JOIN part ON p_partkey = item_id WHERE user_id = 7 AND rating = 5",
    "unseen_candidates": w(LI) + """SELECT p_partkey AS item_id FROM part
      WHERE p_partkey NOT IN (SELECT item_id FROM r WHERE user_id = 7)""",
    "recommend_titles": w(LI) + """, m AS (SELECT item_id, avg(rating) AS score FROM r GROUP BY 1)
      SELECT item_id, round(score, 6) AS score, p_name AS title FROM (
        SELECT * FROM m WHERE item_id NOT IN (SELECT item_id FROM r WHERE user_id = 7) ORDER BY score DESC, item_id LIMIT 50)
      LEFT JOIN part ON p_partkey = item_id""",
    "dataset_stats": w(LI) + """SELECT count(*) AS n_ratings, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items,
      count(*) FILTER (WHERE rating IS NULL) AS n_missing, max(user_id) + 1 AS n_rows, max(item_id) + 1 AS n_cols FROM r""",
    "rating_histogram": w(LI) + "SELECT rating, count(*) AS n FROM r GROUP BY 1",
    "item_summary": w(LI) + "SELECT item_id, count(*) AS n_ratings, round(avg(rating), 6) AS mean_rating FROM r GROUP BY 1",
    "user_summary": w(LI) + "SELECT user_id, count(*) AS n_ratings, round(avg(rating), 6) AS mean_rating FROM r GROUP BY 1",
    "matrix_histogram": w(LI) + """SELECT rating AS value, count(*) AS n FROM r GROUP BY 1 UNION ALL
      SELECT 0, count(DISTINCT user_id) * count(DISTINCT item_id) - count(*) FROM r""",
    "pivot_ratings": w(EV) + "SELECT user_id, " + ", ".join(
        f"coalesce(avg(CASE WHEN item_id = {i} THEN rating END), 0) AS item_{i}" for i in range(100)) + " FROM r GROUP BY 1",
    "mean_baseline": w(EV, _digit3.format(unit=1)) + """, m AS (SELECT avg(rating) AS mean FROM d WHERE role <> 'test')
      SELECT round(any_value(mean), 6) AS mean_rating, round(sqrt(sum((rating - mean) * (rating - mean)) / count(*)), 6) AS baseline_rmse
      FROM d, m WHERE role = 'test'""",
    "similar_items_pearson": w(EV, pearson("7")),
    "similar_titles_by_name": w(LI, pearson("(SELECT min(p_partkey) FROM part WHERE p_name = 'hot bolt')", "HAVING count(*) > 30")),
    "bias_model": w(EV) + """, m AS (SELECT avg(rating) AS mu FROM r),
      bi AS (SELECT item_id, sum(rating - mu) / (10 + count(*)) AS b FROM r, m GROUP BY 1),
      bu AS (SELECT user_id, sum(rating - mu - b) / (15 + count(*)) AS b FROM r JOIN bi USING (item_id), m GROUP BY 1)
      SELECT 'item' AS kind, item_id AS id, round(b, 6) AS bias FROM bi UNION ALL SELECT 'user', user_id, round(b, 6) FROM bu""",
    "gram_items": w(EV, SGRAM) + "SELECT row, col, round(v, 6) AS value FROM s0",
    "gram_kept": w(EV, SGRAM) + "SELECT row, col, round(v, 6) AS value FROM s0",
    "gram_items_sparse": w(LI) + """SELECT row, count(*) AS n, sum(v) AS total FROM (
        SELECT a.item_id AS row, b.item_id AS col, sum(a.rating * b.rating) AS v
        FROM r a JOIN r b ON a.user_id = b.user_id GROUP BY 1, 2) GROUP BY 1""",
    "gram_neg_binary": w(EV, CROSS) + "SELECT row, col, v AS value FROM a0",
    "gram_neg_graded": w(EV, SGRAM) + """, bs AS (SELECT item_id AS col, sum(rating) / 5 * 1.2::DOUBLE AS b FROM r GROUP BY 1)
      SELECT row, col, round(b - v, 6) AS value FROM s0 JOIN bs USING (col)
      UNION ALL SELECT NULL, col, round(b, 6) FROM bs
        WHERE (SELECT count(*) FROM s0 WHERE s0.col = bs.col) < (SELECT count(DISTINCT item_id) FROM r)""",
    "gram_neg_graded_sparse": w(LI, SGRAM) + """, bs AS (SELECT item_id AS col, sum(rating) / 5 * 1.2::DOUBLE AS b FROM r GROUP BY 1),
      k AS (SELECT col, count(*) AS n, sum(v) AS s FROM s0 GROUP BY 1), ni AS (SELECT count(DISTINCT item_id) AS ni FROM r)
      SELECT col, n + CASE WHEN n < ni THEN 1 ELSE 0 END AS n, round(b * n - s + CASE WHEN n < ni THEN b ELSE 0 END, 4) AS total
      FROM bs JOIN k USING (col), ni""",
    "neg_propagation": w(EV, CROSS, FAR) + "SELECT user_id AS row, item_id AS col, v AS value FROM far",
    "neg_propagation_graded": w(EV, SPLIT, DENSE) + _two_sided + """
      SELECT t.user_id, t.item_id, round(yam.v, 6) AS score FROM test t JOIN yam ON yam.user_id = t.user_id AND yam.item_id = t.item_id""",
    "neg_cut_columns": w(EV, SPLIT) + """,
      xy AS (SELECT u.user_id, i.item_id, coalesce(t.rating / 5, 0) AS x, coalesce((6 - t.rating) / 5, 1.2::DOUBLE) AS y
        FROM (SELECT DISTINCT user_id FROM train) u CROSS JOIN (SELECT DISTINCT item_id FROM r) i LEFT JOIN train t USING (user_id, item_id)),
      a AS (SELECT p.item_id AS row, t.item_id AS col, sum(p.y * t.rating / 5) AS v FROM xy p JOIN train t USING (user_id) GROUP BY 1, 2),
      f AS (SELECT xy.user_id, a.col, sum(xy.y * a.v) AS v FROM xy JOIN a ON xy.item_id = a.row GROUP BY 1, 2),
      b AS (SELECT min(v) AS lo, max(v) AS hi FROM f)
      SELECT col AS item_id, round(sum(CASE WHEN (v - lo) / (hi - lo) < 0.2::DOUBLE THEN 0 ELSE (v - lo) / (hi - lo) END), 4) AS total
      FROM f, b GROUP BY col""",
    "minmax_positive": w(EV, SGRAM) + """, b AS (SELECT min(v) AS lo, max(v) AS hi FROM s0 WHERE v > 0)
      SELECT row, col, round((v - lo) / (hi - lo), 6) AS value FROM s0, b""",
    "minmax_all": w(EV, SGRAM) + """, b AS (SELECT CASE WHEN count(*) < (SELECT count(DISTINCT item_id) * count(DISTINCT item_id) FROM r)
        THEN least(min(v), 0) ELSE min(v) END AS lo, max(v) AS hi FROM s0)
      SELECT row, col, round((v - lo) / (hi - lo), 6) AS value FROM s0, b""",
    "minmax_threshold": w(EV, CROSS) + """, b AS (SELECT min(v) AS lo, max(v) AS hi FROM a0 WHERE v > 0)
      SELECT row, col, round((v - lo) / (hi - lo), 6) AS value FROM a0, b WHERE (v - lo) / (hi - lo) >= 0.1::DOUBLE""",
    "stack_blocks": w(EV, SGRAM, CROSS) + """, o AS (SELECT max(item_id) + 1 AS k FROM r)
      SELECT row, col, round(v, 6) AS value, 1 AS block FROM s0 UNION ALL SELECT row, col + k, round(v, 6), 2 FROM a0, o""",
    "score_items_s": w(EV, SPLIT, GRAM, XS, SCORED) + "SELECT user_id, item_id, round(score, 6) AS score, label FROM sc",
    "score_two_sided": w(EV, SPLIT, DENSE) + _two_sided + """,
      bs AS (SELECT min(v) AS lo, max(v) AS hi FROM sm WHERE v > 0), ba AS (SELECT min(v) AS lo, max(v) AS hi FROM am WHERE v > 0),
      pos AS (SELECT xy.user_id, sm.col AS item_id, sum(xy.x * (sm.v - lo) / (hi - lo)) AS v FROM xy JOIN sm ON sm.row = xy.item_id, bs
        WHERE sm.v > 0 AND xy.x > 0 GROUP BY 1, 2),
      neg AS (SELECT xy.user_id, am.col AS item_id, sum(xy.y * (am.v - lo) / (hi - lo)) AS v FROM xy JOIN am ON am.row = xy.item_id, ba
        WHERE am.v > 0 GROUP BY 1, 2)
      SELECT t.user_id, t.item_id, round(coalesce(pos.v, 0) + 0.2::DOUBLE * coalesce(neg.v, 0), 5) AS score FROM test t
      LEFT JOIN pos ON pos.user_id = t.user_id AND pos.item_id = t.item_id
      LEFT JOIN neg ON neg.user_id = t.user_id AND neg.item_id = t.item_id""",
    "topk_unseen": w(EV, SPLIT, GRAM, XS, top(10)) + "SELECT user_id, item_id, round(v / 125, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top",
    "roc_auc": w(EV, SPLIT, GRAM, XS, SCORED, CURVE) + """SELECT round(sum(CAST(pos AS DOUBLE) * (2 * (n - fp) + neg)) / (2.0::DOUBLE * any_value(p) * any_value(n)), 6) AS auc,
      CAST(any_value(p) AS BIGINT) AS n_pos, CAST(any_value(n) AS BIGINT) AS n_neg FROM c""",
    "roc_curve": w(EV, SPLIT, GRAM, XS, SCORED, CURVE) + """SELECT round(score, 6) AS threshold, round(CAST(tp AS DOUBLE) / p, 6) AS tpr,
      round(CAST(fp AS DOUBLE) / n, 6) AS fpr FROM c""",
    "pr_curve": w(EV, SPLIT, GRAM, XS, SCORED, CURVE) + """SELECT round(score, 6) AS threshold, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision,
      round(CAST(tp AS DOUBLE) / p, 6) AS recall FROM c UNION ALL SELECT NULL, 1, 0""",
    "pr_auc": w(EV, SPLIT, GRAM, XS, SCORED, CURVE) + """, z AS (SELECT pos, p, CAST(tp AS DOUBLE) / (tp + fp) AS h,
        lag(CAST(tp AS DOUBLE) / (tp + fp)) OVER (ORDER BY score DESC) AS b FROM c)
      SELECT round(sum(pos * (h + coalesce(b, h)) / 2) / any_value(p), 6) AS pr_auc FROM z""",
    "rmse": w(LI) + """, d AS (SELECT *, CAST(floor(ts / 86400) AS BIGINT) % 10 < 8 AS tr FROM r),
      m AS (SELECT item_id, avg(rating) AS score FROM d WHERE tr GROUP BY 1),
      j AS (SELECT (score - rating) * (score - rating) AS e FROM d JOIN m USING (item_id) WHERE NOT tr)
      SELECT round(sqrt(sum(e) / count(*)), 6) AS rmse, round(sqrt(sum(e) / (SELECT count(*) FROM d WHERE NOT tr)), 6) AS rmse_all,
        count(*) AS n FROM j""",
    "mae_rmse": w(EV, SPLIT) + """, m AS (SELECT item_id, avg(rating) AS score FROM train GROUP BY 1)
      SELECT round(avg(abs(score - rating)), 6) AS mae, round(sqrt(sum((score - rating) * (score - rating)) / count(*)), 6) AS rmse
      FROM test JOIN m USING (item_id)""",
    "diversity_top10": DIV10 + "SELECT * FROM ud",
    "diversity_unseen": DIV50 + "SELECT * FROM ud",
    "diversity_liked": DIV50 + "SELECT * FROM ud WHERE user_id IN (SELECT user_id FROM train WHERE rating >= 3)",
    "diversity_summary": w(EV, SPLIT, GRAM, XS, top(50), SIM_POS, PAIRS, "ud AS (SELECT user_id, avg(distance) AS diversity FROM pairs GROUP BY 1)") + """,
      z AS (SELECT diversity, row_number() OVER (ORDER BY diversity) - 1 AS pos, count(*) OVER () AS n FROM ud)
      SELECT round(avg(diversity), 6) AS mean, round(max(CASE WHEN pos = n // 2 THEN diversity END), 6) AS median,
        round(max(CASE WHEN pos = n // 4 THEN diversity END), 6) AS quarter, count(*) AS n_users FROM z""",
    "diversity_histogram": DIV10 + """SELECT CAST(least(floor(diversity * 50) + 1, 50) AS INTEGER) AS bin, count(*) AS n
      FROM ud WHERE diversity BETWEEN 0 AND 1 GROUP BY 1""",
    "topk_pairs": w(EV, SPLIT, GRAM, XS, top(10), SIM_POS, PAIRS) + "SELECT user_id, item_a, item_b, round(distance, 6) AS distance FROM pairs",
    "product_extremes": """WITH e AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
      p AS (SELECT list_dot_product(a.v, b.v) AS s FROM e a CROSS JOIN e b)
      SELECT round(min(s), 6) AS low, round(max(s), 6) AS high FROM p""",
    "pagerank": w(PAGERANK_START, *[pagerank_round(i) for i in (1, 2, 3)]) + "SELECT id, round(rank, 6) AS rank FROM k3",
}
SQL["pr_curve_saved"] = SQL["pr_curve"]
