"""Table summaries, keep-first dedup, imputation, scaling."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantile import exact_medians, exact_quantiles


def describe(df: DataFrame, columns) -> DataFrame:
    """Exact count, mean, sample std, min, quartiles, max per column
    (one aggregate; ``DataFrame.summary`` percentiles are approximate)."""
    aggs = []
    quart = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    for c in columns:
        aggs += [F.count(c).alias(f"{c}__count"), F.avg(c).alias(f"{c}__mean"),
                 F.stddev_samp(c).alias(f"{c}__std"), F.min(c).alias(f"{c}__min"),
                 F.array(*[F.lit(x).cast("double") for x in quart[c]]).alias(f"{c}__q"),
                 F.max(c).alias(f"{c}__max")]
    row = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__count").alias("count"),
                      F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"),
                      F.col(f"{c}__min").cast("double").alias("min"), F.col(f"{c}__q")[0].alias("p25"),
                      F.col(f"{c}__q")[1].alias("p50"), F.col(f"{c}__q")[2].alias("p75"),
                      F.col(f"{c}__max").cast("double").alias("max")) for c in columns]
    return row.select(F.explode(F.array(*items)).alias("s")).select("s.*")


def dedup_keep_first(df: DataFrame, subset, order_key: str) -> DataFrame:
    """Keep the first row (by ``order_key``, then by the other columns) of
    each duplicate group of ``subset``: one aggregate with map-side combine, so
    a hot group sends one row per task."""
    rest = [c for c in df.columns if c not in set(subset)]
    first = F.min(F.struct(F.col(f"`{order_key}`").alias("__o"), *[F.col(f"`{c}`") for c in rest])).alias("__first")
    g = df.groupBy(*[F.col(f"`{c}`") for c in subset]).agg(first)
    return g.select(*[F.col(f"`{c}`") if c in set(subset) else F.col(f"__first.`{c}`").alias(c) for c in df.columns])


def fit_median_minmax(train: DataFrame, columns) -> dict:
    """M1 + M2 fitted on the training side only (exact medians)."""
    med = exact_medians(train, columns)
    filled = [F.coalesce(F.col(c), F.lit(med[c])).alias(c) for c in columns]
    mm = train.select(*filled).agg(*[F.min(c).alias(f"{c}__lo") for c in columns],
                                   *[F.max(c).alias(f"{c}__hi") for c in columns]).first()
    return {c: (med[c], mm[f"{c}__lo"], mm[f"{c}__hi"]) for c in columns}


def apply_median_minmax(df: DataFrame, params: dict) -> DataFrame:
    """Impute with the training medians, then scale to [0, 1] by the
    training range; a constant column scales to 0 (reference library)."""
    out = []
    for c in df.columns:
        if c not in params:
            out.append(F.col(c))
            continue
        med, lo, hi = params[c]
        v = F.coalesce(F.col(c), F.lit(med))
        rng = (hi - lo) if (hi is not None and lo is not None) else None
        out.append((F.when(F.lit(rng is not None and rng > 0), (v - F.lit(lo)) / F.lit(rng or 1.0))
                    .otherwise(F.lit(0.0))).alias(c))
    return df.select(*out)
