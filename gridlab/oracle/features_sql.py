"""Oracle SQL for the feature half (cube, temporal, bio, focal, sampling)."""
from __future__ import annotations

# variable: (expression over lineitem, aggregate); written out here, so that the
# oracle shares no definition with the engine
CUBE = {
    "tmax": ("l_quantity / 2.0", "max"),
    "tmin": ("l_quantity / 2.0", "min"),
    "vap": ("l_discount", "avg"),
    "ppt": ("l_quantity", "avg"),
    "srad": ("l_extendedprice / 1000.0", "avg"),
    "pet": ("30.0 * (1.0 - l_tax)", "avg"),
    "def": ("30.0 * (1.0 - l_tax) - l_quantity", "avg"),
    "soil": ("l_tax * 100.0", "avg"),
    "pdsi": ("(l_discount - 0.04) * 100.0", "avg"),
    "vpd": ("l_discount * l_tax * 1000.0", "avg"),
}
VARS = list(CUBE)
SEASON_MONTHS = {"djf": (12, 1, 2), "mam": (3, 4, 5), "jja": (6, 7, 8), "son": (9, 10, 11)}
# months of l_shipdate in the given tables: 1995-01 to 2001-11
MONTHS = [f"{y}_{m:02d}" for y in range(1995, 2002) for m in range(1, 13) if (y, m) <= (2001, 11)]
NB = (3, 5, 7)
LAST_N = 6


def r6(e: str) -> str:
    return f"(floor(CAST({e} AS DOUBLE) * 1048576.0e0 + 0.5) / 1048576.0e0)"


def q(name: str) -> str:
    return f'"{name}"'


def cube_ctes() -> str:
    sel = ", ".join(f"CAST({e} AS DOUBLE) AS {q(v)}" for v, (e, _) in CUBE.items())
    agg = ", ".join(f"{a}({q(v)}) AS {q(v)}" for v, (_, a) in CUBE.items())
    vv = ", ".join(f"obs.{q(v)}" for v in VARS)
    return f"""
li AS (SELECT CAST(l_suppkey // 10 AS INTEGER) AS lat_idx, CAST(l_suppkey % 10 AS INTEGER) AS lon_idx,
              CAST(date_trunc('month', l_shipdate) AS DATE) AS month, {sel} FROM lineitem),
bounds AS (SELECT min(month) AS m0, max(month) AS m1, max(lat_idx) AS lmax FROM li),
taxis AS (SELECT CAST(i AS INTEGER) AS time_idx, CAST(m0 + to_months(CAST(i AS INTEGER)) AS DATE) AS month
          FROM (SELECT m0, unnest(generate_series(0, datediff('month', m0, m1))) AS i FROM bounds)),
nt AS (SELECT count(*) AS n FROM taxis),
lat_axis AS (SELECT CAST(unnest(generate_series(0, lmax)) AS INTEGER) AS lat_idx FROM bounds),
lon_axis AS (SELECT CAST(unnest(generate_series(0, 9)) AS INTEGER) AS lon_idx),
obs AS (SELECT lat_idx, lon_idx, month, {agg} FROM li GROUP BY lat_idx, lon_idx, month),
cube AS (SELECT a.lat_idx, o.lon_idx, t.time_idx, CAST(a.lat_idx AS DOUBLE) AS lat,
                CAST(o.lon_idx AS DOUBLE) AS lon, t.month, {vv}
         FROM lat_axis a CROSS JOIN lon_axis o CROSS JOIN taxis t
         LEFT JOIN obs ON obs.lat_idx = a.lat_idx AND obs.lon_idx = o.lon_idx AND obs.month = t.month)"""


def with_cube(*ctes: str) -> str:
    return "WITH " + ",\n".join([cube_ctes(), *ctes])


def cube_crop_sql() -> str:
    vs = ["ppt", "srad", "vap", "pet"]
    return with_cube("""
c AS (SELECT * FROM cube WHERE month BETWEEN DATE '1996-01-01' AND DATE '2000-12-01'
      AND lat BETWEEN 0.0 AND 7.5 AND lon BETWEEN 2.0 AND 8.0)""") + f"""
SELECT CAST(dense_rank() OVER (ORDER BY lat) - 1 AS INTEGER) AS lat_idx,
       CAST(dense_rank() OVER (ORDER BY lon) - 1 AS INTEGER) AS lon_idx,
       CAST(dense_rank() OVER (ORDER BY month) - 1 AS INTEGER) AS time_idx,
       {r6('lat')} AS lat, {r6('lon')} AS lon, month,
       {", ".join(f"{r6(q(v))} AS {q(v)}" for v in vs)}
FROM c"""


def _stats_cols(v: str) -> list[str]:
    c = q(v)
    return [f"{r6(f'avg({c})')} AS {q(v + '_mean')}",
            f"{r6(f'median({c})')} AS {q(v + '_median')}",
            f"{r6(f'stddev_pop({c})')} AS {q(v + '_std')}",
            f"{r6(f'min({c})')} AS {q(v + '_min')}",
            f"{r6(f'max({c})')} AS {q(v + '_max')}",
            f"{r6(f'quantile_cont({c}, 0.1)')} AS {q(v + '_p10')}",
            f"{r6(f'quantile_cont({c}, 0.9)')} AS {q(v + '_p90')}",
            f"{r6(f'CASE WHEN abs(abs(avg({c})) + 1e-6) > 1e-6 THEN stddev_pop({c}) / (abs(avg({c})) + 1e-6) END')} AS {q(v + '_cv')}"]


def _trend_cols(v: str) -> list[str]:
    c = q(v)
    return [f"{r6(f'CASE WHEN count({c}) >= 2 THEN regr_slope({c}, CAST(time_idx AS DOUBLE)) END')} AS {q(v + '_trend')}",
            f"{r6(f'avg({c}) FILTER (WHERE time_idx >= (SELECT n FROM nt) - {LAST_N})')} AS {q(v + f'_last{LAST_N}_mean')}"]


def _season_cols(v: str) -> list[str]:
    c = q(v)
    out, names = [], []
    for s, months in SEASON_MONTHS.items():
        e = f"avg({c}) FILTER (WHERE month(month) IN ({', '.join(map(str, months))}))"
        names.append(e)
        out.append(f"{r6(e)} AS {q(f'{v}_{s}_mean')}")
    out.append(f"{r6(f'greatest({', '.join(names)}) - least({', '.join(names)})')} AS {q(v + '_seasonal_amp')}")
    return out


def cell_stats_sql(parts) -> str:
    cols = [f"{r6('max(lat)')} AS lat", f"{r6('max(lon)')} AS lon"]
    for v in VARS:
        if "stats" in parts:
            cols += _stats_cols(v)
        if "trend" in parts:
            cols += _trend_cols(v)
        if "seasonal" in parts:
            cols += _season_cols(v)
    return with_cube() + f"\nSELECT lat_idx, lon_idx, {', '.join(cols)} FROM cube GROUP BY lat_idx, lon_idx"


# -- bio ---------------------------------------------------------------------
SPELLS = {"dry": "bio_ppt_longest_dry_spell", "deficit": "bio_water_deficit_longest_spell",
          "drought": "bio_pdsi_drought_longest_spell", "hot_dry": "bio_hot_dry_longest_spell"}
COUNTS = {"dry": "bio_ppt_dry_month_count", "wet": "bio_ppt_wet_month_count",
          "soil_low": "bio_soil_low_month_count", "hot": "bio_tmax_hot_month_count",
          "vpd_high": "bio_vpd_high_month_count", "deficit": "bio_water_deficit_month_count",
          "surplus": "bio_water_surplus_month_count", "drought": "bio_pdsi_drought_month_count",
          "hot_dry": "bio_hot_dry_month_count"}


def bio_ctes() -> list[str]:
    w3 = "(PARTITION BY lat_idx, lon_idx ORDER BY time_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    pc = "(PARTITION BY lat_idx, lon_idx)"
    rows = f"""
b0 AS (SELECT lat_idx, lon_idx, time_idx, lat, lon, tmax, tmin, ppt, pet, soil, vpd, "def", pdsi,
              ppt - pet AS wb,
              CASE WHEN count(ppt) OVER {w3} = 3 THEN sum(ppt) OVER {w3} END AS ppt_r3,
              CASE WHEN count(tmax) OVER {w3} = 3 THEN avg(tmax) OVER {w3} END AS tmax_r3,
              CASE WHEN count(tmin) OVER {w3} = 3 THEN avg(tmin) OVER {w3} END AS tmin_r3,
              CASE WHEN count(soil) OVER {w3} = 3 THEN avg(soil) OVER {w3} END AS soil_r3,
              quantile_cont(ppt, 0.25) OVER {pc} AS ppt_lo, quantile_cont(ppt, 0.75) OVER {pc} AS ppt_hi,
              quantile_cont(soil, 0.25) OVER {pc} AS soil_lo, quantile_cont(tmax, 0.75) OVER {pc} AS tmax_hi,
              quantile_cont(vpd, 0.75) OVER {pc} AS vpd_hi
       FROM cube)"""
    masks = f"""
b1 AS (SELECT *, coalesce(ppt <= ppt_lo, false) AS m_dry, coalesce(ppt >= ppt_hi, false) AS m_wet,
              coalesce(soil <= soil_lo, false) AS m_soil_low, coalesce(tmax >= tmax_hi, false) AS m_hot,
              coalesce(vpd >= vpd_hi, false) AS m_vpd_high, coalesce(wb < 0, false) AS m_deficit,
              coalesce(wb > 0, false) AS m_surplus, coalesce(pdsi < 0, false) AS m_drought,
              coalesce(tmax >= tmax_hi, false) AND coalesce(wb < 0, false) AS m_hot_dry
       FROM b0)"""
    spells = []
    for k in SPELLS:
        spells.append(f"""
isl_{k} AS (SELECT lat_idx, lon_idx, time_idx - row_number() OVER (PARTITION BY lat_idx, lon_idx ORDER BY time_idx) AS g
            FROM b1 WHERE m_{k}),
run_{k} AS (SELECT lat_idx, lon_idx, max(n) AS n FROM (SELECT lat_idx, lon_idx, g, count(*) AS n FROM isl_{k}
            GROUP BY lat_idx, lon_idx, g) GROUP BY lat_idx, lon_idx)""")
    recent = f"time_idx >= (SELECT n FROM nt) - {LAST_N}"
    anom = []
    for v, name in [("ppt", "ppt"), ("soil", "soil"), ("vpd", "vpd"), ('"def"', "def"), ("wb", "water_balance")]:
        e = (f"CASE WHEN abs(stddev_pop({v}) + 1e-6) > 1e-6 THEN (avg({v}) FILTER (WHERE {recent}) - avg({v}))"
             f" / (stddev_pop({v}) + 1e-6) END")
        anom.append(f"{r6(e)} AS bio_{name}_recent{LAST_N}_anomaly")
    agg = f"""
bio AS (SELECT lat_idx, lon_idx, {r6('max(lat)')} AS lat, {r6('max(lon)')} AS lon,
   {r6('avg(tmax - tmin)')} AS bio_mean_diurnal_range,
   {r6('max(tmax) - min(tmin)')} AS bio_temp_annual_range,
   {r6('CASE WHEN abs(max(tmax) - min(tmin)) > 1e-6 THEN avg(tmax - tmin) / (max(tmax) - min(tmin)) END')} AS bio_isothermality_proxy,
   {r6('coalesce(sum(ppt), 0.0)')} AS bio_annual_ppt_total,
   {r6('max(ppt_r3)')} AS bio_wettest_quarter_ppt, {r6('min(ppt_r3)')} AS bio_driest_quarter_ppt,
   {r6('max(tmax_r3)')} AS bio_warmest_quarter_tmax, {r6('min(tmin_r3)')} AS bio_coldest_quarter_tmin,
   {r6('max(soil_r3)')} AS bio_wettest_quarter_soil, {r6('min(soil_r3)')} AS bio_driest_quarter_soil,
   {r6('coalesce(sum(wb), 0.0)')} AS bio_water_balance_total,
   {r6(f'coalesce(sum(wb) FILTER (WHERE {recent}), 0.0)')} AS bio_water_balance_last{LAST_N},
   {", ".join(f"CAST(count(*) FILTER (WHERE m_{k}) AS BIGINT) AS {n}" for k, n in COUNTS.items())},
   {", ".join(anom)}
  FROM b1 GROUP BY lat_idx, lon_idx),
bio_all AS (SELECT bio.*, {", ".join(f"CAST(coalesce(run_{k}.n, 0) AS BIGINT) AS {n}" for k, n in SPELLS.items())}
  FROM bio {" ".join(f"LEFT JOIN run_{k} USING (lat_idx, lon_idx)" for k in SPELLS)})"""
    return [rows, masks, *spells, agg]


def bio_sql(columns=None) -> str:
    cols = "*" if columns is None else ", ".join(["lat_idx", "lon_idx", *columns])
    return with_cube(*bio_ctes()) + f"\nSELECT {cols} FROM bio_all"


# -- focal -------------------------------------------------------------------
def surface_cte(variables=VARS) -> str:
    return ("surf AS (SELECT lat_idx, lon_idx, max(lat) AS lat, max(lon) AS lon, "
            + ", ".join(f"median({q(v)}) AS {q(v + '_median')}" for v in variables)
            + " FROM cube GROUP BY lat_idx, lon_idx)")


def focal_cols(v: str) -> list[str]:
    m = f"b.{q(v + '_median')}"
    out = []
    for k in NB:
        r = (k - 1) // 2
        f = f"FILTER (WHERE abs(a.lat_idx - b.lat_idx) <= {r} AND abs(a.lon_idx - b.lon_idx) <= {r})"
        out += [f"{r6(f'avg({m}) {f}')} AS {q(f'{v}_local_mean_w{k}')}",
                f"{r6(f'stddev_pop({m}) {f}')} AS {q(f'{v}_local_std_w{k}')}",
                f"{r6(f'max({m}) {f} - min({m}) {f}')} AS {q(f'{v}_local_range_w{k}')}",
                f"{r6(f'any_value(a.{q(v + chr(95) + 'median')}) - avg({m}) {f}')} AS {q(f'{v}_local_contrast_w{k}')}"]
    return out


def focal_cte(variables=VARS) -> str:
    cols = [c for v in variables for c in focal_cols(v)]
    return (f"foc AS (SELECT a.lat_idx, a.lon_idx, {', '.join(cols)} FROM surf a JOIN surf b "
            f"ON abs(a.lat_idx - b.lat_idx) <= 3 AND abs(a.lon_idx - b.lon_idx) <= 3 "
            f"GROUP BY a.lat_idx, a.lon_idx)")


def focal_sql() -> str:
    return with_cube(surface_cte(), focal_cte()) + "\nSELECT * FROM foc"


def zonal_sql() -> str:
    return with_cube() + "\nSELECT time_idx, month, " + ", ".join(
        f"{r6(f'avg({q(v)})')} AS {q(v + '_zonal_mean')}" for v in VARS) + " FROM cube GROUP BY time_idx, month"


def median_surface_sql() -> str:
    return with_cube() + (f"\nSELECT lat_idx, lon_idx, {r6('max(lat)')} AS lat, {r6('max(lon)')} AS lon, "
                          f"{r6('median(srad)')} AS srad_median, {r6('median(vap)')} AS vap_median "
                          f"FROM cube GROUP BY lat_idx, lon_idx")


# -- points ------------------------------------------------------------------
POINTS_CTES = """
train_pts AS (SELECT 'C' || CAST(c_custkey AS VARCHAR) AS "ID", c_acctbal / 1000.0 AS "Latitude",
                     (c_custkey % 97) / 10.0 AS "Longitude",
                     CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS "Occurrence Status" FROM customer),
test_pts AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS "ID", s_acctbal / 1000.0 AS "Latitude",
                    (s_suppkey % 97) / 10.0 AS "Longitude" FROM supplier),
coords AS (SELECT DISTINCT "Latitude", "Longitude" FROM (SELECT "Latitude", "Longitude" FROM train_pts
           UNION ALL SELECT "Latitude", "Longitude" FROM test_pts)),
near_lat AS (SELECT "Latitude", "Longitude", lat_idx FROM (SELECT c."Latitude", c."Longitude", a.lat_idx,
             row_number() OVER (PARTITION BY c."Latitude", c."Longitude"
                                ORDER BY abs(c."Latitude" - a.lat_idx), a.lat_idx DESC) AS rk
             FROM coords c CROSS JOIN lat_axis a) WHERE rk = 1),
near AS (SELECT n."Latitude", n."Longitude", n.lat_idx, o.lon_idx FROM near_lat n JOIN (
             SELECT "Latitude", "Longitude", lon_idx FROM (SELECT c."Latitude", c."Longitude", b.lon_idx,
             row_number() OVER (PARTITION BY c."Latitude", c."Longitude"
                                ORDER BY abs(c."Longitude" - b.lon_idx), b.lon_idx DESC) AS rk
             FROM coords c CROSS JOIN lon_axis b) WHERE rk = 1) o USING ("Latitude", "Longitude"))"""


def nearest_sql() -> str:
    return with_cube(surface_cte(["srad", "vap"]), POINTS_CTES) + f"""
SELECT {r6('n."Latitude"')} AS "Latitude", {r6('n."Longitude"')} AS "Longitude", n.lat_idx, n.lon_idx,
       {r6('s.srad_median')} AS srad_median, {r6('s.vap_median')} AS vap_median
FROM near n LEFT JOIN surf s USING (lat_idx, lon_idx)"""


RAW_MONTHLY = ["soil", "ppt", "vap", "tmin", "tmax", "def", "pdsi", "vpd"]


def monthly_cte() -> str:
    """One row per sampled cell, one column per variable and month."""
    cols = []
    for v in RAW_MONTHLY:
        c = q(v)
        cols += [f"{r6(f'max({c}) FILTER (WHERE time_idx = {k})')} AS {q(f'{v}_{label}')}" for k, label in enumerate(MONTHS)]
        last = len(MONTHS) - 1
        cols += [f"{r6(f'max({c}) FILTER (WHERE time_idx = {last}) - max({c}) FILTER (WHERE time_idx = 0)')} AS {q(v + '_delta_start_end')}",
                 f"{r6(f'avg({c}) FILTER (WHERE time_idx > {last - 3})')} AS {q(v + '_recent3_mean')}",
                 f"{r6(f'stddev_pop({c}) FILTER (WHERE time_idx > {last - 6})')} AS {q(v + '_recent6_std')}"]
    return (f"mon AS (SELECT lat_idx, lon_idx, {', '.join(cols)} FROM cube "
            "WHERE (lat_idx, lon_idx) IN (SELECT (lat_idx, lon_idx) FROM near) GROUP BY lat_idx, lon_idx)")


def monthly_sql() -> str:
    return with_cube(surface_cte(["srad"]), POINTS_CTES, monthly_cte()) + f"""
SELECT {r6('n."Latitude"')} AS "Latitude", {r6('n."Longitude"')} AS "Longitude", m.* EXCLUDE (lat_idx, lon_idx)
FROM near n LEFT JOIN mon m USING (lat_idx, lon_idx)"""


def cell_features_ctes(without_focal: bool = False) -> list[str]:
    stat_cols = []
    for v in VARS:
        stat_cols += _stats_cols(v) + _trend_cols(v) + _season_cols(v)
    return [f"cst AS (SELECT lat_idx, lon_idx, {r6('max(lat)')} AS lat, {r6('max(lon)')} AS lon, "
            f"{', '.join(stat_cols)} FROM cube GROUP BY lat_idx, lon_idx)",
            *([] if without_focal else [surface_cte(), focal_cte()]), *bio_ctes(),
            f"cells AS (SELECT * FROM cst {'' if without_focal else 'JOIN foc USING (lat_idx, lon_idx) '}"
            "JOIN (SELECT * EXCLUDE (lat, lon) FROM bio_all) USING (lat_idx, lon_idx))"]


def cell_features_sql() -> str:
    return with_cube(*cell_features_ctes()) + "\nSELECT * FROM cells"


def feature_table_sql() -> str:
    return with_cube(*cell_features_ctes(), POINTS_CTES, monthly_cte()) + f"""
SELECT t."ID", {r6('t."Latitude"')} AS "Latitude", {r6('t."Longitude"')} AS "Longitude", t."Occurrence Status",
       c.* EXCLUDE (lat_idx, lon_idx, lat, lon), m.* EXCLUDE (lat_idx, lon_idx),
       CAST(CAST(floor(t."Latitude" / 0.5) AS BIGINT) AS VARCHAR) || '_' ||
       CAST(CAST(floor(t."Longitude" / 0.5) AS BIGINT) AS VARCHAR) AS spatial_group
FROM train_pts t JOIN near n USING ("Latitude", "Longitude")
LEFT JOIN cells c USING (lat_idx, lon_idx)
LEFT JOIN mon m USING (lat_idx, lon_idx)"""


def pseudo_absence_grid_sql() -> str:
    cand = []
    # P5 column rule, in cell-table order
    for v in VARS:
        cand += [f"{v}_median", f"{v}_last6_mean", f"{v}_seasonal_amp", f"{v}_cv"]
    return with_cube(*cell_features_ctes()) + f"""
SELECT lat AS "Latitude", lon AS "Longitude", {", ".join(q(c) for c in cand)}, COLUMNS('^bio_')
FROM cells WHERE lat_idx % 2 = 0 AND lon_idx % 2 = 0"""


SQL = {
    "cube_crop": cube_crop_sql,
    "temporal_stats": lambda: cell_stats_sql(("stats",)),
    "stored_cube_stats": lambda: cell_stats_sql(("stats",)),
    "temporal_trend": lambda: cell_stats_sql(("trend",)),
    "seasonal_stats": lambda: cell_stats_sql(("seasonal",)),
    "bioclim": lambda: bio_sql(),
    "focal_stats": focal_sql,
    "zonal_mean": zonal_sql,
    "median_surface": median_surface_sql,
    "nearest_cell_join": nearest_sql,
    "monthly_sequence": monthly_sql,
    "cell_features": cell_features_sql,
    "feature_table": feature_table_sql,
    "pseudo_absence_grid": pseudo_absence_grid_sql,
}


# the columns of the bio queries, written out here: the oracle imports no engine code
BIO_COLUMNS = {
    "water_balance": ["bio_annual_ppt_total", "bio_water_balance_total", "bio_water_balance_last6"],
    "climate_ranges": ["bio_mean_diurnal_range", "bio_temp_annual_range", "bio_isothermality_proxy"],
    "rolling_quarter": ["bio_wettest_quarter_ppt", "bio_driest_quarter_ppt", "bio_warmest_quarter_tmax",
                        "bio_coldest_quarter_tmin", "bio_wettest_quarter_soil", "bio_driest_quarter_soil"],
    "event_month_counts": ["bio_ppt_dry_month_count", "bio_ppt_wet_month_count",
                           "bio_soil_low_month_count", "bio_tmax_hot_month_count",
                           "bio_vpd_high_month_count", "bio_water_deficit_month_count",
                           "bio_water_surplus_month_count", "bio_pdsi_drought_month_count",
                           "bio_hot_dry_month_count"],
    "longest_spell": ["bio_ppt_longest_dry_spell", "bio_water_deficit_longest_spell",
                      "bio_pdsi_drought_longest_spell", "bio_hot_dry_longest_spell"],
    "recent_anomaly": ["bio_ppt_recent6_anomaly", "bio_soil_recent6_anomaly", "bio_vpd_recent6_anomaly",
                       "bio_def_recent6_anomaly", "bio_water_balance_recent6_anomaly"],
}
for _name, _cols in BIO_COLUMNS.items():
    SQL[_name] = (lambda c=_cols: bio_sql(c))


def feature_manifest_sql() -> str:
    n_feat = len(VARS) * 27 + 30
    return with_cube(POINTS_CTES) + f"""
SELECT (SELECT count(*) FROM train_pts) AS train_rows, (SELECT count(*) FROM test_pts) AS test_rows,
       (SELECT count(*) FROM (SELECT DISTINCT lat_idx, lon_idx FROM cube WHERE lat_idx % 2 = 0 AND lon_idx % 2 = 0))
           AS pseudo_absence_candidate_rows,
       (SELECT count(*) FROM coords) AS coordinate_rows, 3 AS feature_schema_version,
       CAST((SELECT n FROM nt) AS INTEGER) AS time_steps, {n_feat} AS cell_feature_columns"""


SQL["feature_manifest"] = feature_manifest_sql


def raster_sample_sql() -> str:
    return with_cube(surface_cte(["srad", "vap"]), POINTS_CTES) + f"""
SELECT t."ID", {r6('s.srad_median')} AS srad, {r6('s.vap_median')} AS vap
FROM train_pts t JOIN near n USING ("Latitude", "Longitude") LEFT JOIN surf s USING (lat_idx, lon_idx)"""


SQL["raster_sample"] = raster_sample_sql
