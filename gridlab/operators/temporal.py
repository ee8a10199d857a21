"""Per-cell temporal reducers over a long cube.

Everything here is keyed by the cell ``(lat_idx, lon_idx)``. All window
columns (rolling quarters, per-cell thresholds, run lengths) use windows
partitioned by the cell, and the final reduction groups by the cell, so the
cube is shuffled **once** (or not at all when it is stored bucketed by cell).
A cell holds one row per month, so no key can be hot.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ANOMALY_VARIABLES, EPSILON, SEASONS, FeatureParams
from ..functions.scalar import null_safe, safe_ratio

CELL = ["lat_idx", "lon_idx"]
STAT_PARTS = ("stats", "trend", "seasonal")


def quantile_name(q: float) -> str:
    return f"p{int(round(q * 100)):02d}"


def _by_cell() -> Window:
    return Window.partitionBy(*CELL)


def _by_cell_time() -> Window:
    return Window.partitionBy(*CELL).orderBy("time_idx")


# ---------------------------------------------------------------------------
# Per-variable statistics
# ---------------------------------------------------------------------------
def variable_aggs(v: str, parts: Iterable[str], quantiles=(0.10, 0.90),
                  last_n: int = 6, n_time: int | None = None) -> list[Column]:
    parts = set(parts)
    out: list[Column] = []
    c = F.col(v)
    if "stats" in parts:
        qs = [0.5, *quantiles]
        out.append(F.percentile(c, F.array(*[F.lit(q) for q in qs])).alias(f"__{v}_q"))
        out += [F.avg(c).alias(f"{v}_mean"), F.stddev_pop(c).alias(f"{v}_std"),
                F.min(c).alias(f"{v}_min"), F.max(c).alias(f"{v}_max")]
    if "trend" in parts:
        out.append(F.regr_slope(c, F.col("time_idx").cast("double")).alias(f"{v}_trend"))
        out.append(F.avg(F.when(F.col("time_idx") >= F.lit(n_time - last_n), c))
                   .alias(f"{v}_last{last_n}_mean"))
    if "seasonal" in parts:
        for s, months in SEASONS.items():
            out.append(F.avg(F.when(F.month("month").isin(*months), c)).alias(f"{v}_{s}_mean"))
    return out


def variable_post(v: str, parts: Iterable[str], quantiles=(0.10, 0.90),
                  last_n: int = 6) -> list[Column]:
    parts = set(parts)
    out: list[Column] = []
    if "stats" in parts:
        out += [F.col(f"{v}_mean"), F.col(f"__{v}_q")[0].alias(f"{v}_median"),
                F.col(f"{v}_std"), F.col(f"{v}_min"), F.col(f"{v}_max")]
        out += [F.col(f"__{v}_q")[i + 1].alias(f"{v}_{quantile_name(q)}")
                for i, q in enumerate(quantiles)]
    if "trend" in parts:
        out += [F.col(f"{v}_trend"), F.col(f"{v}_last{last_n}_mean")]
    if "seasonal" in parts:
        seas = [F.col(f"{v}_{s}_mean") for s in SEASONS]
        out += seas
        out.append((F.greatest(*seas) - F.least(*seas)).alias(f"{v}_seasonal_amp"))
    if "stats" in parts:
        out.append(safe_ratio(F.col(f"{v}_std"), F.abs(F.col(f"{v}_mean")) + F.lit(EPSILON))
                   .alias(f"{v}_cv"))
    return out


def cell_statistics(cube: DataFrame, variables, parts=STAT_PARTS, quantiles=(0.10, 0.90),
                    last_n: int = 6, n_time: int | None = None) -> DataFrame:
    """Per-cell statistics for the chosen parts, one aggregate."""
    aggs = [F.max("lat").alias("lat"), F.max("lon").alias("lon")]
    post = [*CELL, "lat", "lon"]
    for v in variables:
        aggs += variable_aggs(v, parts, quantiles, last_n, n_time)
        post += variable_post(v, parts, quantiles, last_n)
    return cube.groupBy(*CELL).agg(*aggs).select(*post)


# ---------------------------------------------------------------------------
# W2 rolling windows, W3 spells, W6 per-cell thresholds
# ---------------------------------------------------------------------------
def rolling_complete(v: str, size: int = 3, how: str = "sum") -> Column:
    """Trailing window of ``size`` steps; NULL unless all ``size`` are valid."""
    w = _by_cell_time().rowsBetween(-(size - 1), 0)
    agg = F.sum(v) if how == "sum" else F.avg(v)
    return F.when(F.count(v).over(w) == size, agg.over(w))


def run_length(mask: Column) -> Column:
    """Length of the run of true values ending at this row (0 on false).

    A missing month (a gap in time_idx) breaks a run like a false value.
    Longest run per cell = max of this over the cell.
    """
    w = _by_cell_time()
    t = F.col("time_idx")
    gap = (t - F.lag(t, 1, -1).over(w)) > 1
    brk = F.when(~mask, t).when(gap, t - 1)
    last_brk = F.max(brk).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(mask, t - F.coalesce(last_brk, F.lit(-1))).otherwise(F.lit(0))


def window_quantile(v: str, q: float) -> Column:
    """Per-cell linear-interpolated quantile broadcast to each month."""
    return F.percentile(F.col(v), F.lit(q)).over(_by_cell())


SPELLS = {"dry": "bio_ppt_longest_dry_spell", "deficit": "bio_water_deficit_longest_spell",
          "drought": "bio_pdsi_drought_longest_spell", "hot_dry": "bio_hot_dry_longest_spell"}
COUNTS = {"dry": "bio_ppt_dry_month_count", "wet": "bio_ppt_wet_month_count",
          "soil_low": "bio_soil_low_month_count", "hot": "bio_tmax_hot_month_count",
          "vpd_high": "bio_vpd_high_month_count", "deficit": "bio_water_deficit_month_count",
          "surplus": "bio_water_surplus_month_count", "drought": "bio_pdsi_drought_month_count",
          "hot_dry": "bio_hot_dry_month_count"}
BIO_INPUTS = ("tmax", "tmin", "ppt", "pet", "soil", "vpd", "def", "pdsi")


def bio_rows(cube: DataFrame, cfg: FeatureParams, keep=()) -> DataFrame:
    """Month rows with the window columns the bio indices need (W2 rolling
    quarters, W6 per-cell thresholds, F8 masks, W3 run lengths). All windows
    are partitioned by the cell; ``keep`` carries extra columns through."""
    ql, qh = cfg.temporal.extremes[0], cfg.temporal.extremes[1]
    base = list(dict.fromkeys([*CELL, "time_idx", "lat", "lon", *BIO_INPUTS, *keep]))
    rows = cube.select(
        *base, (F.col("ppt") - F.col("pet")).alias("wb"),
        rolling_complete("ppt", 3, "sum").alias("ppt_r3"),
        rolling_complete("tmax", 3, "avg").alias("tmax_r3"),
        rolling_complete("tmin", 3, "avg").alias("tmin_r3"),
        rolling_complete("soil", 3, "avg").alias("soil_r3"),
        window_quantile("ppt", ql).alias("ppt_lo"), window_quantile("ppt", qh).alias("ppt_hi"),
        window_quantile("soil", ql).alias("soil_lo"), window_quantile("tmax", qh).alias("tmax_hi"),
        window_quantile("vpd", qh).alias("vpd_hi"),
    )
    masks = {
        "dry": null_safe(F.col("ppt") <= F.col("ppt_lo")),
        "wet": null_safe(F.col("ppt") >= F.col("ppt_hi")),
        "soil_low": null_safe(F.col("soil") <= F.col("soil_lo")),
        "hot": null_safe(F.col("tmax") >= F.col("tmax_hi")),
        "vpd_high": null_safe(F.col("vpd") >= F.col("vpd_hi")),
        "deficit": null_safe(F.col("wb") < 0),
        "surplus": null_safe(F.col("wb") > 0),
        "drought": null_safe(F.col("pdsi") < 0),
    }
    masks["hot_dry"] = masks["hot"] & masks["deficit"]
    rows = rows.select("*", *[m.alias(f"m_{k}") for k, m in masks.items()])
    return rows.select("*", *[run_length(F.col(f"m_{k}")).alias(f"run_{k}") for k in SPELLS])


def _anomaly_vars():
    return [*ANOMALY_VARIABLES, "wb"]


def bio_aggs(cfg: FeatureParams, n_time: int) -> list[Column]:
    recent = F.col("time_idx") >= F.lit(n_time - cfg.temporal.recent)

    def zsum(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0.0))

    aggs = [
        F.avg(F.col("tmax") - F.col("tmin")).alias("bio_mean_diurnal_range"),
        (F.max("tmax") - F.min("tmin")).alias("bio_temp_annual_range"),
        zsum(F.col("ppt")).alias("bio_annual_ppt_total"),
        F.max("ppt_r3").alias("bio_wettest_quarter_ppt"),
        F.min("ppt_r3").alias("bio_driest_quarter_ppt"),
        F.max("tmax_r3").alias("bio_warmest_quarter_tmax"),
        F.min("tmin_r3").alias("bio_coldest_quarter_tmin"),
        F.max("soil_r3").alias("bio_wettest_quarter_soil"),
        F.min("soil_r3").alias("bio_driest_quarter_soil"),
        zsum(F.col("wb")).alias("bio_water_balance_total"),
        zsum(F.when(recent, F.col("wb"))).alias(f"bio_water_balance_last{cfg.temporal.recent}"),
        *[F.count_if(F.col(f"m_{k}")).cast("long").alias(name) for k, name in COUNTS.items()],
        *[F.max(f"run_{k}").cast("long").alias(name) for k, name in SPELLS.items()],
    ]
    for v in _anomaly_vars():
        aggs += [F.avg(F.when(recent, F.col(v))).alias(f"__{v}_recent"),
                 F.avg(v).alias(f"__{v}_amean"), F.stddev_pop(v).alias(f"__{v}_astd")]
    return aggs


def bio_post(cfg: FeatureParams) -> list:
    last_n = cfg.temporal.recent
    out = ["bio_mean_diurnal_range", "bio_temp_annual_range",
           safe_ratio("bio_mean_diurnal_range", "bio_temp_annual_range").alias("bio_isothermality_proxy"),
           "bio_annual_ppt_total", "bio_wettest_quarter_ppt", "bio_driest_quarter_ppt",
           "bio_warmest_quarter_tmax", "bio_coldest_quarter_tmin", "bio_wettest_quarter_soil",
           "bio_driest_quarter_soil", "bio_water_balance_total", f"bio_water_balance_last{last_n}",
           *COUNTS.values(), *SPELLS.values()]
    for v in _anomaly_vars():
        name = "water_balance" if v == "wb" else v
        out.append(safe_ratio(F.col(f"__{v}_recent") - F.col(f"__{v}_amean"),
                              F.col(f"__{v}_astd") + F.lit(EPSILON))
                   .alias(f"bio_{name}_recent{last_n}_anomaly"))
    return out


def bioclim_frame(cube: DataFrame, cfg: FeatureParams, n_time: int) -> DataFrame:
    """The 30 ``bio_*`` columns (A10-A14, W2, W3, W6, F7, F8) per cell."""
    g = bio_rows(cube, cfg).groupBy(*CELL).agg(F.max("lat").alias("lat"), F.max("lon").alias("lon"),
                                                *bio_aggs(cfg, n_time))
    return g.select(*CELL, "lat", "lon", *bio_post(cfg))


def cell_reduce(cube: DataFrame, variables, cfg: FeatureParams, n_time: int,
                with_bio: bool = True) -> DataFrame:
    """Every per-cell temporal feature in ONE aggregate: statistics, trend
    and seasonal parts for each variable plus the bio indices, over the
    month rows carrying the bio window columns. The windows and the
    aggregate share a single exchange on the cell key."""
    rows = bio_rows(cube, cfg, keep=[*variables, "month"]) if with_bio else cube
    aggs = [F.max("lat").alias("lat"), F.max("lon").alias("lon")]
    post = [*CELL, "lat", "lon"]
    for v in variables:
        aggs += variable_aggs(v, STAT_PARTS, cfg.temporal.quantiles, cfg.temporal.recent, n_time)
        post += variable_post(v, STAT_PARTS, cfg.temporal.quantiles, cfg.temporal.recent)
    if with_bio:
        aggs += bio_aggs(cfg, n_time)
        post += bio_post(cfg)
    return rows.groupBy(*CELL).agg(*aggs).select(*post)


def longest_spell(cube: DataFrame, mask: Column, name: str = "longest_spell") -> DataFrame:
    """W3 on any cube: longest run of ``mask`` per cell (0 when none)."""
    r = cube.select(*CELL, "time_idx", null_safe(mask).alias("__m"))
    return (r.select(*CELL, run_length(F.col("__m")).alias("__run"))
            .groupBy(*CELL).agg(F.max("__run").cast("long").alias(name)))


def rolling_quarter(cube: DataFrame, v: str, size: int = 3) -> DataFrame:
    """W2 + A12: per-cell extremes over complete trailing windows."""
    r = cube.select(*CELL, "time_idx",
                    rolling_complete(v, size, "sum").alias("__s"),
                    rolling_complete(v, size, "avg").alias("__a"))
    return r.groupBy(*CELL).agg(
        F.max("__s").alias(f"{v}_wettest_sum"), F.min("__s").alias(f"{v}_driest_sum"),
        F.max("__a").alias(f"{v}_warmest_mean"), F.min("__a").alias(f"{v}_coldest_mean"))


def median_surface(cube: DataFrame, variables) -> DataFrame:
    """Per-cell temporal median of each variable."""
    return (cube.groupBy(*CELL)
            .agg(F.max("lat").alias("lat"), F.max("lon").alias("lon"),
                 *[F.median(v).alias(f"{v}_median") for v in variables]))


def apply_series_reducer(cube: DataFrame, fn, schema: str, columns=None) -> DataFrame:
    """Custom per-cell series reducer. ``fn(pandas.DataFrame) ->
    pandas.DataFrame`` receives one cell's months (sorted by time_idx; a group
    is bounded by the time axis) and returns its output rows."""
    cols = [*CELL, "time_idx", *(columns or [c for c in cube.columns if c not in (*CELL, "time_idx")])]

    def run(pdf):
        return fn(pdf.sort_values("time_idx"))

    return cube.select(*cols).groupBy(*CELL).applyInPandas(run, schema)
