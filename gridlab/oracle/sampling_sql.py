"""Oracle SQL for nearest neighbours, bagging, imputation, dedup, summaries."""
from __future__ import annotations

from .features_sql import POINTS_CTES, r6, surface_cte, with_cube
from .scores_sql import rows_cte


def nn_feature_distance_sql():
    return f"""SELECT c.vec_id, {r6('min(list_distance(CAST(c.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])))')} AS dist
FROM embeddings c, embeddings p WHERE c.label <> 1 AND p.label = 1 GROUP BY c.vec_id"""


def nn_geo_buffer_sql():
    return f"""WITH cells AS (SELECT DISTINCT CAST(l_suppkey // 10 AS DOUBLE) AS lat, CAST(l_suppkey % 10 AS DOUBLE) AS lon FROM lineitem),
pos AS (SELECT c_acctbal / 1000.0e0 AS la, (c_custkey % 97) / 10.0e0 AS lo FROM customer WHERE c_mktsegment = 'BUILDING'),
d AS (SELECT lat, lon, min(sqrt((lat - la) * (lat - la) + (lon - lo) * (lon - lo))) AS dist FROM cells, pos GROUP BY lat, lon)
SELECT {r6('lat')} AS "Latitude", {r6('lon')} AS "Longitude", {r6('dist')} AS geo_dist,
       (NOT EXISTS (SELECT 1 FROM d WHERE dist >= 0.2e0)) OR dist >= 0.2e0 AS buffered FROM d"""


def _md5i(s: str) -> str:
    return f"('0x' || substr(md5({s}), 1, 15))::BIGINT"


def negative_bag_sql(bags: int = 5, share: str = "1.0e0"):
    return "WITH " + ",\n".join([rows_cte(), f"""
g AS (SELECT grp, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg,
        {_md5i("'42:' || grp")} AS h FROM rows GROUP BY grp),
gf AS (SELECT grp, (row_number() OVER (ORDER BY pos DESC, neg DESC, h, grp) - 1) % 10 AS q FROM g),
rf AS (SELECT r.row_id, r.y, CASE WHEN q < 5 THEN q ELSE 9 - q END AS fold FROM rows r JOIN gf USING (grp)),
mem AS (SELECT rf.*, tf FROM rf CROSS JOIN (SELECT unnest(generate_series(0, 4)) AS tf) t WHERE fold <> tf),
bags AS (SELECT unnest(generate_series(0, {bags - 1})) AS bag),
negn AS (SELECT tf, row_id, y, row_number() OVER (PARTITION BY tf ORDER BY {_md5i("'42:' || CAST(row_id AS VARCHAR)")}, row_id) AS rn,
         count(*) OVER (PARTITION BY tf) AS n FROM mem WHERE y = 0),
draws AS (SELECT tf, bag, j, n FROM (SELECT DISTINCT tf, n FROM negn) CROSS JOIN bags,
          LATERAL (SELECT unnest(generate_series(1, greatest(1, CAST(round_even(n * {share}, 0) AS BIGINT)))) AS j)),
picked AS (SELECT d.tf, d.bag, x.row_id, x.y, d.j AS draw FROM draws d JOIN negn x
           ON x.tf = d.tf AND x.rn = ({_md5i("'42:' || CAST(d.tf AS VARCHAR) || ':' || CAST(d.bag AS VARCHAR) || ':' || CAST(d.j AS VARCHAR)")} % d.n) + 1)"""]) + """
SELECT CAST(tf AS INTEGER) AS fold, CAST(bag AS INTEGER) AS bag, row_id, y, CAST(draw AS BIGINT) AS draw FROM picked
UNION ALL SELECT CAST(tf AS INTEGER), CAST(bag AS INTEGER), row_id, y, CAST(NULL AS BIGINT) FROM mem CROSS JOIN bags WHERE y = 1"""


IMPUTE_COLS = ["ppt", "srad", "vap", "pet"]


def impute_scale_sql():
    med = ", ".join(f"median({c}) AS {c}_m" for c in IMPUTE_COLS)
    mm = ", ".join(f"min(coalesce({c}, {c}_m)) AS {c}_lo, max(coalesce({c}, {c}_m)) AS {c}_hi" for c in IMPUTE_COLS)
    sel = ", ".join(
        f"{r6(f'CASE WHEN {c}_hi - {c}_lo > 0 THEN (coalesce({c}, {c}_m) - {c}_lo) / ({c}_hi - {c}_lo) ELSE 0.0e0 END')} AS {c}"
        for c in IMPUTE_COLS)
    return with_cube(f"tr AS (SELECT * FROM cube WHERE month < DATE '2000-01-01')",
                     f"md AS (SELECT {med} FROM tr)", f"mx AS (SELECT {mm} FROM tr, md)") + \
        f"\nSELECT lat_idx, lon_idx, time_idx, {sel} FROM cube, md, mx"


def dedup_keep_first_sql():
    return with_cube(surface_cte(["srad", "vap"]), POINTS_CTES) + f"""
SELECT "ID", {r6('srad_median')} AS srad_median, {r6('vap_median')} AS vap_median, "Occurrence Status" FROM (
  SELECT t."ID", s.srad_median, s.vap_median, t."Occurrence Status",
         row_number() OVER (PARTITION BY s.srad_median, s.vap_median, t."Occurrence Status" ORDER BY t."ID") AS rk
  FROM train_pts t JOIN near n USING ("Latitude", "Longitude") LEFT JOIN surf s USING (lat_idx, lon_idx)) WHERE rk = 1"""


def describe_table_sql():
    parts = []
    for c in ["srad_median", "vap_median", "ppt_median"]:
        parts.append(f"SELECT '{c}' AS \"column\", count({c}) AS count, {r6(f'avg({c})')} AS mean, "
                     f"{r6(f'stddev_samp({c})')} AS std, {r6(f'min({c})')} AS min, {r6(f'quantile_cont({c}, 0.25)')} AS p25, "
                     f"{r6(f'quantile_cont({c}, 0.5)')} AS p50, {r6(f'quantile_cont({c}, 0.75)')} AS p75, "
                     f"{r6(f'max({c})')} AS max FROM surf")
    return with_cube(surface_cte(["srad", "vap", "ppt"])) + "\n" + " UNION ALL ".join(parts)


def events_spells_sql():
    return """WITH ev AS (SELECT CAST(user_id AS BIGINT) AS u, CAST(ts AS DATE) AS d, value FROM events),
b AS (SELECT min(d) AS d0, max(d) AS d1 FROM ev),
days AS (SELECT CAST(unnest(generate_series(0, datediff('day', d0, d1))) AS INTEGER) AS t FROM b),
users AS (SELECT DISTINCT u FROM ev),
obs AS (SELECT u, datediff('day', (SELECT d0 FROM b), d) AS t, sum(value) AS v FROM ev GROUP BY u, d),
cube AS (SELECT users.u, days.t, obs.v FROM users CROSS JOIN days LEFT JOIN obs USING (u, t)),
isl AS (SELECT u, t - row_number() OVER (PARTITION BY u ORDER BY t) AS g FROM cube WHERE coalesce(v > 0, false)),
run AS (SELECT u, max(n) AS n FROM (SELECT u, g, count(*) AS n FROM isl GROUP BY u, g) GROUP BY u),
roll AS (SELECT u, max(s3) AS s FROM (SELECT u, CASE WHEN count(v) OVER w = 3 THEN sum(v) OVER w END AS s3 FROM cube
         WINDOW w AS (PARTITION BY u ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) GROUP BY u)""" + f"""
SELECT users.u AS user_id, CAST(coalesce(run.n, 0) AS BIGINT) AS longest_active_run, {r6('roll.s')} AS value_wettest_sum
FROM users LEFT JOIN run USING (u) LEFT JOIN roll USING (u)"""


def hash_cap_sql():
    key = _md5i("'42:' || CAST(o_orderkey AS VARCHAR) || ':' || CAST(o_custkey AS VARCHAR)")
    return f"""SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey,
  row_number() OVER (ORDER BY {key}, o_orderkey, o_custkey) AS rn FROM orders) WHERE rn <= 700"""


SQL = {
    "negative_bag_share": lambda: negative_bag_sql(2, "0.35e0"),
    "hash_cap": hash_cap_sql,
    "nn_feature_distance": nn_feature_distance_sql,
    "nn_geo_buffer": nn_geo_buffer_sql,
    "negative_bag": negative_bag_sql,
    "impute_scale": impute_scale_sql,
    "dedup_keep_first": dedup_keep_first_sql,
    "describe_table": describe_table_sql,
    "events_spells": events_spells_sql,
}
