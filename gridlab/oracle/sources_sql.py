"""Oracle SQL for the source and sink round trips."""
from __future__ import annotations

from .features_sql import (BIO_COLUMNS, POINTS_CTES, VARS, cell_features_ctes, cube_crop_sql, r6,
                           surface_cte, with_cube)
from .sampling_sql import _md5i
from .scores_sql import PREDS, W, base_ctes, eval_ctes


def csv_points_sql():
    return with_cube(POINTS_CTES) + f"""
SELECT "ID", {r6('"Latitude"')} AS "Latitude", {r6('"Longitude"')} AS "Longitude", "Occurrence Status" FROM train_pts"""


def feature_store_sql():
    pts = " UNION ALL ".join(f"""SELECT '{part}' AS part, t."ID", t."Latitude", t."Longitude", n.lat_idx, n.lon_idx
        FROM {part}_pts t JOIN near n USING ("Latitude", "Longitude")""" for part in ("train", "test"))
    return with_cube(surface_cte(["srad"]), POINTS_CTES) + f"""
SELECT part, "ID", {r6('"Latitude"')} AS "Latitude", {r6('"Longitude"')} AS "Longitude", lat_idx, lon_idx FROM (
  {pts} UNION ALL SELECT 'pseudo', NULL, "Latitude", "Longitude", NULL, NULL FROM coords)"""


def store_manifest_sql():
    return with_cube(POINTS_CTES) + """
SELECT 'train_rows' AS field, CAST((SELECT count(*) FROM train_pts) AS VARCHAR) AS value
UNION ALL SELECT 'test_rows', CAST((SELECT count(*) FROM test_pts) AS VARCHAR)
UNION ALL SELECT 'pseudo_absence_candidate_rows', CAST((SELECT count(*) FROM coords) AS VARCHAR)
UNION ALL SELECT 'coordinate_rows', CAST((SELECT count(*) FROM coords) AS VARCHAR)
UNION ALL SELECT 'feature_schema_version', '3'
UNION ALL SELECT 'months', CAST((SELECT n FROM nt) AS VARCHAR)
UNION ALL SELECT 'start', CAST((SELECT m0 FROM bounds) AS VARCHAR)
UNION ALL SELECT 'feature_columns', 'srad_median,vap_median'
UNION ALL SELECT 'variables', 'tmax,tmin,vap,ppt,srad,pet,def,soil,pdsi,vpd'
UNION ALL SELECT 'aggregations', 'median'
UNION ALL SELECT 'dropped_all_null_columns', 'swe_median'
UNION ALL SELECT 'spatial_group_size_degrees', '0.5'
UNION ALL SELECT 'min_lat', '0.0' UNION ALL SELECT 'min_lon', '0.0' UNION ALL SELECT 'max_lon', '9.0'
UNION ALL SELECT 'max_lat', CAST(CAST(max(l_suppkey) // 10 AS DOUBLE) AS VARCHAR) FROM lineitem"""


def store_freshness_sql():
    return """SELECT 'complete' AS state, true AS fresh, (SELECT count(*) FROM customer) AS n_rows
UNION ALL SELECT 'old version', false, (SELECT count(*) FROM customer)
UNION ALL SELECT 'unfinished', false, (SELECT count(*) FROM supplier)"""


def probability_artifacts_sql():
    return W(PREDS) + f"\nSELECT candidate, split, row_id, y, {r6('p')} AS p FROM preds"


def materialised_table_sql():
    return "SELECT o_orderstatus, count(*) AS n, 1 AS builds FROM orders GROUP BY o_orderstatus"


def run_report_sql():
    return W(*base_ctes()) + f"""
SELECT CAST(row_number() OVER (ORDER BY oof_f1 DESC, candidate DESC, threshold DESC) - 1 AS INTEGER) AS rank, candidate,
       {r6('oof_f1')} AS oof_f1, {r6('threshold')} AS threshold FROM best"""


def resumed_run_sql():
    return W(*base_ctes()) + f"""
SELECT candidate, {r6('threshold')} AS threshold, {r6('oof_f1')} AS oof_f1 FROM best ORDER BY best.oof_f1 DESC, candidate LIMIT 1"""


def ranked_candidates_sql():
    """m3 has no test rows: cut to five before or after that is looked at."""
    return W(*base_ctes()) + """
SELECT 'before' AS cut, CAST(row_number() OVER (ORDER BY rk) - 1 AS INTEGER) AS rank, candidate FROM ranked WHERE rk <= 5 AND candidate <> 'm3'
UNION ALL SELECT * FROM (SELECT 'after', CAST(row_number() OVER (ORDER BY rk) - 1 AS INTEGER) AS r, candidate FROM ranked WHERE candidate <> 'm3') WHERE r < 5"""


def _chosen(limit: str) -> str:
    """The greedy choice as a recursion over the ranks: a list of the names
    taken so far, and one of those put back."""
    return "WITH RECURSIVE " + ",\n".join([*base_ctes(), f"""
wide AS (SELECT a.candidate AS a, b.candidate AS b, covar_pop(a.p, b.p) / (stddev_pop(a.p) * stddev_pop(b.p)) AS r
         FROM oof a JOIN oof b USING (row_id) GROUP BY a.candidate, b.candidate),
step AS (SELECT 0::BIGINT AS rk, []::VARCHAR[] AS taken, []::VARCHAR[] AS behind
  UNION ALL
  SELECT x.rk, CASE WHEN x.near THEN x.taken ELSE list_append(x.taken, x.candidate) END,
         CASE WHEN x.near THEN list_append(x.behind, x.candidate) ELSE x.behind END
  FROM (SELECT k.rk, k.candidate, s.taken, s.behind,
               EXISTS (SELECT 1 FROM wide w WHERE w.a = k.candidate AND list_contains(s.taken, w.b) AND abs(w.r) >= {limit}) AS near
        FROM step s JOIN ranked k ON k.rk = s.rk + 1) x),
done AS (SELECT list_concat(taken, behind) AS names FROM step ORDER BY rk DESC LIMIT 1)"""])


def diverse_backfill_sql():
    return _chosen("0.03") + """
SELECT k, CAST(i - 1 AS INTEGER) AS place, names[i] AS candidate
FROM done, (VALUES (2), (4), (8)) v(k), LATERAL (SELECT unnest(generate_series(1, k)) AS i)"""


def diverse_topk_sql():
    return _chosen("0.995") + f"""
SELECT candidate, CAST(i AS INTEGER) AS pick, {r6('threshold')} AS threshold, {r6('oof_f1')} AS oof_f1
FROM (SELECT names[i] AS candidate, i FROM done, (SELECT unnest(generate_series(1, 6)) AS i)) JOIN best USING (candidate)"""


def calibrate_isotonic_sql():
    """Cross-fitted isotonic calibration of the four chosen candidates by the
    min-max formula over the distinct scores of each training side, with linear
    interpolation between them; test rows get the mean of the folds' fits."""
    return _chosen("0.995") + f""",
g AS (SELECT grp, sum(y) AS pos, sum(1 - y) AS neg, {_md5i("'42:' || grp")} AS h FROM (SELECT DISTINCT row_id, y, grp FROM oof) GROUP BY grp),
gf AS (SELECT grp, CASE WHEN q < 5 THEN q ELSE 9 - q END AS fold FROM (
  SELECT grp, (row_number() OVER (ORDER BY pos DESC, neg DESC, h, grp) - 1) % 10 AS q FROM g)),
four AS (SELECT unnest(list_slice(names, 1, 4)) AS candidate FROM done),
pf AS (SELECT p.candidate, p.split, p.row_id, p.y, p.p, gf.fold FROM preds p JOIN four USING (candidate) LEFT JOIN gf USING (grp)),
hist AS (SELECT candidate, f, p, sum(y) AS s, count(*) AS n FROM pf, (SELECT unnest(generate_series(0, 4)) AS f)
         WHERE split = 'oof' AND fold <> f GROUP BY candidate, f, p),
num AS (SELECT *, row_number() OVER o AS j, sum(s) OVER o AS cs, sum(n) OVER o AS cn FROM hist WINDOW o AS (PARTITION BY candidate, f ORDER BY p)),
runs AS (SELECT a.candidate, a.f, a.j AS i, b.j AS k, CAST(b.cs - a.cs + a.s AS DOUBLE) / (b.cn - a.cn + a.n) AS m
         FROM num a JOIN num b ON a.candidate = b.candidate AND a.f = b.f AND a.j <= b.j),
lows AS (SELECT candidate, f, i, k AS j, min(m) OVER (PARTITION BY candidate, f, i ORDER BY k DESC) AS low FROM runs),
fit AS (SELECT n.candidate, n.f, n.p, n.j, v.val FROM num n JOIN (SELECT candidate, f, j, max(low) AS val FROM lows GROUP BY candidate, f, j) v
        USING (candidate, f, j)),
pts AS (SELECT DISTINCT candidate, f, q.p FROM (SELECT DISTINCT candidate, p FROM pf) q JOIN (SELECT DISTINCT candidate, f FROM fit) USING (candidate)),
ends AS (SELECT t.candidate, t.f, t.p, max(CASE WHEN x.p <= t.p THEN x.j END) AS lo, min(CASE WHEN x.p >= t.p THEN x.j END) AS hi
         FROM pts t JOIN fit x ON x.candidate = t.candidate AND x.f = t.f GROUP BY t.candidate, t.f, t.p),
val AS (SELECT e.candidate, e.f, e.p, CASE WHEN a.p IS NULL THEN b.val WHEN b.p IS NULL OR a.p = b.p THEN a.val
          ELSE a.val + (b.val - a.val) * ((e.p - a.p) / (b.p - a.p)) END AS v
        FROM ends e LEFT JOIN fit a ON a.candidate = e.candidate AND a.f = e.f AND a.j = e.lo
        LEFT JOIN fit b ON b.candidate = e.candidate AND b.f = e.f AND b.j = e.hi)
SELECT x.split, x.row_id, x.y, CAST(x.fold AS INTEGER) AS fold, {r6('v')} AS p, x.candidate || '_cal_isotonic' AS candidate
FROM pf x JOIN val ON val.candidate = x.candidate AND val.p = x.p AND val.f = x.fold WHERE x.split = 'oof'
UNION ALL SELECT x.split, x.row_id, x.y, CAST(x.fold AS INTEGER), {r6('avg(v)')}, x.candidate || '_cal_isotonic'
FROM pf x JOIN val ON val.candidate = x.candidate AND val.p = x.p WHERE x.split = 'test' GROUP BY x.split, x.row_id, x.y, x.fold, x.candidate"""


def _calibrate_sql(method: str, x0: str, x1: str, full: bool, rounds: int = 14):
    """Cross-fitted logistic calibration of the four chosen candidates by a
    fixed number of Newton rounds, written out one after another; each solves
    its 3 x 3 system by Cramer's rule."""
    sets = "generate_series(-1, 4)" if full else "generate_series(0, 4)"
    clipped = "greatest(least(p, 1.0e0 - 1e-6), 1e-6)"
    terms = {"g0": "(q - y) * x0", "g1": "(q - y) * x1", "g2": "q - y", "a": "q * (1 - q) * x0 * x0", "b": "q * (1 - q) * x0 * x1",
             "c": "q * (1 - q) * x0", "d": "q * (1 - q) * x1 * x1", "e": "q * (1 - q) * x1", "f": "q * (1 - q)"}
    det = "(a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c))"
    step0 = "(g0 * (d * f - e * e) - b * (g1 * f - e * g2) + c * (g1 * e - d * g2))"
    step1 = "(a * (g1 * f - e * g2) - g0 * (b * f - e * c) + c * (b * g2 - g1 * c))"
    step2 = "(a * (d * g2 - g1 * e) - b * (b * g2 - g1 * c) + g0 * (b * e - d * c))"
    chain = ["r0 AS (SELECT DISTINCT candidate, s, 0.0e0 AS w0, 0.0e0 AS w1, 0.0e0 AS w2 FROM tab)"]
    for k in range(rounds):
        sums = ", ".join(f"sum(n * ({t})) AS {name}" for name, t in terms.items())
        chain.append(f"""
r{k + 1} AS MATERIALIZED (SELECT candidate, s, w0 - {step0} / {det} AS w0, w1 - {step1} / {det} AS w1, w2 - {step2} / {det} AS w2 FROM (
  SELECT candidate, s, w0, w1, w2, g0 + w0 AS g0, g1 + w1 AS g1, g2, a + 1 AS a, b, c, d + 1 AS d, e, f + 1e-12 AS f FROM (
    SELECT candidate, s, w0, w1, w2, {sums} FROM (
      SELECT t.*, w0, w1, w2, 1 / (1 + exp(-(w0 * x0 + w1 * x1 + w2))) AS q FROM tab t JOIN r{k} USING (candidate, s))
    GROUP BY candidate, s, w0, w1, w2)))""")
    value = "1 / (1 + exp(-(w0 * x0 + w1 * x1 + w2)))"
    test = "s = -1" if full else "s >= 0"
    return _chosen("0.995") + f""",
g AS (SELECT grp, sum(y) AS pos, sum(1 - y) AS neg, {_md5i("'42:' || grp")} AS h FROM (SELECT DISTINCT row_id, y, grp FROM oof) GROUP BY grp),
gf AS (SELECT grp, CASE WHEN q < 5 THEN q ELSE 9 - q END AS fold FROM (
  SELECT grp, (row_number() OVER (ORDER BY pos DESC, neg DESC, h, grp) - 1) % 10 AS q FROM g)),
four AS (SELECT unnest(list_slice(names, 1, 4)) AS candidate FROM done),
pf AS (SELECT p.candidate, p.split, p.row_id, p.y, p.p, gf.fold, {x0.format(c=clipped)} AS x0, {x1.format(c=clipped)} AS x1
       FROM preds p JOIN four USING (candidate) LEFT JOIN gf USING (grp)),
tab AS MATERIALIZED (SELECT candidate, s, p, y, x0, x1, count(*)::DOUBLE AS n FROM pf, (SELECT unnest({sets}) AS s)
        WHERE split = 'oof' AND fold <> s GROUP BY ALL),
{", ".join(chain)}
SELECT x.split, x.row_id, x.y, CAST(x.fold AS INTEGER) AS fold, {r6(value)} AS p, x.candidate || '_cal_{method}' AS candidate
FROM pf x JOIN r{rounds} w ON w.candidate = x.candidate AND w.s = x.fold WHERE x.split = 'oof'
UNION ALL SELECT x.split, x.row_id, x.y, CAST(x.fold AS INTEGER), {r6(f"avg({value})")}, x.candidate || '_cal_{method}'
FROM pf x JOIN r{rounds} w ON w.candidate = x.candidate AND {test} WHERE x.split = 'test' GROUP BY x.split, x.row_id, x.y, x.fold, x.candidate"""


def calibrate_sigmoid_sql():
    return _calibrate_sql("sigmoid", "ln({c} / (1.0e0 - {c}))", "0.0e0", False)


def calibrate_beta_sql():
    return _calibrate_sql("beta", "ln({c})", "-ln(1.0e0 - {c})", True)


def posthoc_submissions_sql():
    """Rows and positives of every candidate at every public threshold; the
    recommended ones lie near the best threshold of the focus range."""
    return W(*eval_ctes()) + f"""
SELECT p.candidate, printf('%.2f', g.t) AS label, count(*) AS n, CAST(sum(CAST(p.p >= g.t AS INTEGER)) AS BIGINT) AS n_positive,
       any_value(abs(g.t - e.focus_best_threshold) <= CAST('{0.04 + 1e-9!r}' AS DOUBLE)) AS recommended
FROM preds p JOIN evr e USING (candidate) CROSS JOIN g21 g WHERE p.split = 'test' GROUP BY p.candidate, g.t"""


def training_vectors_sql():
    """Medians of the values that a training side has fill its gaps; ranges are
    those of its values, means and deviations those of its filled rows."""
    cols = ("lat", "lon", "bal")
    per = ", ".join(f"median({c}) AS m_{c}, min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in cols)
    fill = ", ".join(f"avg(coalesce({c}, m_{c})) AS mu_{c}, stddev_pop(coalesce({c}, m_{c})) AS sd_{c}" for c in cols)
    out = []
    for i, c in enumerate(cols):
        x = f"coalesce({c}, m_{c})"
        out += [f"{r6(x)} AS raw_{i}", f"{r6(f'CASE WHEN hi_{c} > lo_{c} THEN ({x} - lo_{c}) / (hi_{c} - lo_{c}) ELSE 0.0e0 END')} AS ranged_{i}",
                f"{r6(f'CASE WHEN sd_{c} > 0 THEN ({x} - mu_{c}) / sd_{c} ELSE 0.0e0 END')} AS standard_{i}"]
    return f"""WITH pts AS (SELECT c_custkey AS row_id, c_custkey % 3 AS fold, c_acctbal / 1000.0e0 AS lat, (c_custkey % 97) / 10.0e0 AS lon,
    CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END AS bal, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS y FROM customer),
rows AS (SELECT s, pts.*, CASE WHEN fold = s THEN 'oof' ELSE 'train' END AS role FROM pts, (SELECT unnest(generate_series(0, 2)) AS s)),
a AS (SELECT s, count(*) AS n, sum(y) AS n1, {per} FROM rows WHERE role = 'train' GROUP BY s),
b AS (SELECT s, {fill} FROM rows JOIN a USING (s) WHERE role = 'train' GROUP BY s)
SELECT CAST(s AS INTEGER) AS "set", role, CAST(row_id AS VARCHAR) AS row_id, y, {r6('n / (2.0e0 * CASE WHEN y = 1 THEN n1 ELSE n - n1 END)')} AS weight, {", ".join(out)}
FROM rows JOIN a USING (s) JOIN b USING (s)"""


def saved_models_sql():
    return with_cube(POINTS_CTES) + """
SELECT "ID" AS row_id, true AS in_range, 0.5e0 AS threshold FROM test_pts"""


def cv_structure_sql():
    return with_cube(POINTS_CTES) + f""",
rows AS (SELECT "ID", "Occurrence Status" AS y, CAST(CAST(floor("Latitude" / 0.5) AS BIGINT) AS VARCHAR) || '_' ||
         CAST(CAST(floor("Longitude" / 0.5) AS BIGINT) AS VARCHAR) AS grp FROM train_pts),
g AS (SELECT grp, sum(y) AS pos, sum(1 - y) AS neg, {_md5i("'42:' || grp")} AS h FROM rows GROUP BY grp),
f AS (SELECT grp, (row_number() OVER (ORDER BY pos DESC, neg DESC, h, grp) - 1) % 10 AS q FROM g)
SELECT 'logistic_regression' AS candidate, 'oof' AS split, "ID" AS row_id, y,
       CAST(CASE WHEN q < 5 THEN q ELSE 9 - q END AS INTEGER) AS fold, true AS in_range FROM rows JOIN f USING (grp)
UNION ALL SELECT 'logistic_regression', 'test', "ID", NULL, NULL, true FROM test_pts"""


def pseudo_absence_select_sql():
    """Environmental selection (R4-R6): distances of every second cell to the
    positives of each training side, cut-offs, pools with fall-backs, draws."""
    cols = [f"{v}_{s}" for v in VARS for s in ("median", "last6_mean", "seasonal_amp", "cv")]
    vec = lambda t: "[" + ", ".join(f'coalesce({t}."{c}", m."{c}")' for c in cols) + "]"
    cols += [c for own in BIO_COLUMNS.values() for c in own]
    order = _md5i("'42:' || tf || ':' || bag || ':' || pool || ':' || cid")
    again = _md5i("'42:' || cid")
    target = _md5i("'42:' || d.tf || ':' || d.bag || ':' || d.pool || ':' || d.j")
    return with_cube(*cell_features_ctes(without_focal=True), POINTS_CTES) + f""",
rows AS (SELECT t.*, "Occurrence Status" AS y, CAST(CAST(floor("Latitude" / 0.5) AS BIGINT) AS VARCHAR) || '_' ||
         CAST(CAST(floor("Longitude" / 0.5) AS BIGINT) AS VARCHAR) AS grp FROM train_pts t),
g AS (SELECT grp, sum(y) AS pos, sum(1 - y) AS neg, {_md5i("'42:' || grp")} AS h FROM rows GROUP BY grp),
f AS (SELECT grp, CASE WHEN q < 5 THEN q ELSE 9 - q END AS fold FROM (
  SELECT grp, (row_number() OVER (ORDER BY pos DESC, neg DESC, h, grp) - 1) % 10 AS q FROM g)),
tfs AS (SELECT unnest(generate_series(0, 4)) AS tf),
pos AS (SELECT tf, r."Latitude" AS la, r."Longitude" AS lo, c.* FROM rows r JOIN f USING (grp) JOIN tfs ON fold <> tf
        JOIN near n ON n."Latitude" = r."Latitude" AND n."Longitude" = r."Longitude" JOIN cells c USING (lat_idx, lon_idx) WHERE r.y = 1),
m AS (SELECT tf, {', '.join(f'median("{c}") AS "{c}"' for c in cols)} FROM pos GROUP BY tf),
pv AS (SELECT p.tf, la, lo, {vec("p")} AS v FROM pos p JOIN m USING (tf)),
cv AS (SELECT m.tf, CAST(c.lat AS VARCHAR) || '_' || CAST(c.lon AS VARCHAR) AS cid, c.lat, c.lon, {vec("c")} AS v
       FROM cells c CROSS JOIN m WHERE lat_idx % 2 = 0 AND lon_idx % 2 = 0),
d AS (SELECT c.tf, cid, c.lat, c.lon, min(list_distance(c.v, p.v)) AS env, min(sqrt((c.lat - la) * (c.lat - la) + (c.lon - lo) * (c.lon - lo))) AS geo
      FROM cv c JOIN pv p USING (tf) GROUP BY c.tf, cid, c.lat, c.lon),
cut AS (SELECT tf, quantile_cont(env, 0.8) AS far, quantile_cont(env, 0.1) AS q1, quantile_cont(env, 0.45) AS q2, bool_or(geo >= 0.2) AS any_free FROM d GROUP BY tf),
b AS (SELECT d.*, far, q1, q2, NOT any_free OR geo >= 0.2 AS buf FROM d JOIN cut USING (tf)),
lev AS (SELECT tf, count(*) FILTER (buf AND env >= far) AS f0, count(*) FILTER (buf) AS f1, count(*) FILTER (buf AND env BETWEEN q1 AND q2) AS h0,
               count(*) FILTER (buf AND env < far) AS h1 FROM b GROUP BY tf),
w AS (SELECT b.*, CASE WHEN f0 > 0 THEN buf AND env >= far WHEN f1 > 0 THEN buf ELSE true END AS is_far, h0, h1 FROM b JOIN lev USING (tf)),
pool AS (SELECT tf, cid, lat, lon, 'far' AS pool FROM w WHERE is_far
  UNION ALL SELECT tf, cid, lat, lon, 'hard' FROM w WHERE CASE WHEN h0 > 0 THEN buf AND env BETWEEN q1 AND q2 WHEN h1 > 0 THEN buf AND env < far ELSE is_far END),
size AS (SELECT tf, greatest(1, CAST(round_even(count(*) * 1.0e0, 0) AS BIGINT)) AS s FROM pos GROUP BY tf),
hard AS (SELECT tf, s, least(s, greatest(0, CAST(round_even(s * 0.35e0, 0) AS BIGINT))) AS h FROM size),
want AS (SELECT tf, 'far' AS pool, s - h AS k FROM hard WHERE s - h > 0 UNION ALL SELECT tf, 'hard', h FROM hard WHERE h > 0),
bags AS (SELECT unnest(generate_series(0, 2)) AS bag),
num AS (SELECT *, row_number() OVER (PARTITION BY tf, bag, pool ORDER BY {order}, cid) AS rn,
          row_number() OVER (PARTITION BY tf, bag, pool ORDER BY {again}, cid) AS rr, count(*) OVER (PARTITION BY tf, bag, pool) AS n
        FROM pool CROSS JOIN bags JOIN want USING (tf, pool)),
drawn AS (SELECT tf, bag, pool, lat, lon, rn AS draw FROM num WHERE n >= k AND rn <= k
  UNION ALL SELECT d.tf, d.bag, d.pool, x.lat, x.lon, d.j
  FROM (SELECT tf, bag, pool, n, unnest(generate_series(1, k)) AS j FROM (SELECT DISTINCT tf, bag, pool, n, k FROM num WHERE n < k)) d
  JOIN num x ON x.tf = d.tf AND x.bag = d.bag AND x.pool = d.pool AND x.rr = {target} % d.n + 1)
SELECT CAST(tf AS INTEGER) AS fold, CAST(bag AS INTEGER) AS bag, pool, {r6('lat')} AS "Latitude", {r6('lon')} AS "Longitude", CAST(draw AS BIGINT) AS draw,
       'PA_' || tf || '_' || bag || '_' || pool || '_' || draw AS "ID", 0 AS y, 'pseudo_absence' AS spatial_group FROM drawn"""


def candidate_sets_sql():
    return W(PREDS) + """,
n AS (SELECT DISTINCT candidate AS c FROM preds)
SELECT 2 AS size, a.c || '__' || b.c AS members FROM n a JOIN n b ON a.c < b.c
UNION ALL SELECT 3, a.c || '__' || b.c || '__' || d.c FROM n a JOIN n b ON a.c < b.c JOIN n d ON b.c < d.c"""


SQL = {
    "csv_points": csv_points_sql, "cube_scan": cube_crop_sql, "feature_store": feature_store_sql, "store_manifest": store_manifest_sql,
    "store_freshness": store_freshness_sql, "probability_artifacts": probability_artifacts_sql, "materialised_table": materialised_table_sql,
    "run_report": run_report_sql, "resumed_run": resumed_run_sql, "ranked_candidates": ranked_candidates_sql,
    "pseudo_absence_select": pseudo_absence_select_sql, "diverse_topk": diverse_topk_sql, "calibrate_isotonic": calibrate_isotonic_sql, "calibrate_sigmoid": calibrate_sigmoid_sql, "calibrate_beta": calibrate_beta_sql, "posthoc_submissions": posthoc_submissions_sql, "saved_models": saved_models_sql, "training_vectors": training_vectors_sql, "diverse_backfill": diverse_backfill_sql, "cv_structure": cv_structure_sql, "candidate_sets": candidate_sets_sql,
}
