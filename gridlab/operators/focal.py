"""Focal (2-D neighbourhood) statistics of a per-cell surface.

Separable box windows: pass 1 aggregates sum / count / sum of squares /
min / max over ``lat_idx`` in [i-r, i+r] (partition by ``lon_idx``); pass 2
aggregates those partials over ``lon_idx`` in [j-r, j+r] (partition by
``lat_idx``). Each window partition is one grid row or column, bounded by the
axis length, and all three sizes share the same two exchanges. Values are
centred by the surface mean before squaring to keep the variance stable.

Semantics: centred window, at least one valid cell; a NULL centre still gets
mean / std / range, its contrast (value - mean) is NULL; std is population std.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = ["lat_idx", "lon_idx"]


def focal_stats(surface: DataFrame, variables, sizes=(3, 5, 7),
                value_suffix: str = "_median") -> DataFrame:
    """``surface``: one row per cell of the full rectangle with
    ``<v><value_suffix>`` columns. Returns CELL + ``<v>_local_*_w<k>``."""
    cols = {v: f"{v}{value_suffix}" for v in variables}
    centre_row = surface.agg(*[F.avg(c).alias(v) for v, c in cols.items()]).first()
    centre = {v: float(centre_row[v]) if centre_row[v] is not None else 0.0 for v in variables}
    radii = {k: (k - 1) // 2 for k in sizes}

    def q(c):
        return "`" + c + "`"

    base = surface.selectExpr(*CELL, *[q(c) for c in cols.values()],
                              *[f"{q(c)} - {centre[v]!r}D AS `__d_{v}`" for v, c in cols.items()])
    # window expressions as SQL strings (one JVM round trip per column)
    p1 = []
    for v, c in cols.items():
        d = f"`__d_{v}`"
        for k, r in radii.items():
            w = f"OVER (PARTITION BY lon_idx ORDER BY lat_idx RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING)"
            p1 += [f"sum({d}) {w} AS `__s_{v}_{k}`", f"count({d}) {w} AS `__n_{v}_{k}`",
                   f"sum({d} * {d}) {w} AS `__q_{v}_{k}`", f"min({q(c)}) {w} AS `__lo_{v}_{k}`",
                   f"max({q(c)}) {w} AS `__hi_{v}_{k}`"]
    pass1 = base.selectExpr(*CELL, *[q(c) for c in cols.values()], *p1)
    p2 = []
    for v in variables:
        for k, r in radii.items():
            w = f"OVER (PARTITION BY lat_idx ORDER BY lon_idx RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING)"
            p2 += [f"sum(`__s_{v}_{k}`) {w} AS `__S_{v}_{k}`", f"sum(`__n_{v}_{k}`) {w} AS `__N_{v}_{k}`",
                   f"sum(`__q_{v}_{k}`) {w} AS `__Q_{v}_{k}`", f"min(`__lo_{v}_{k}`) {w} AS `__LO_{v}_{k}`",
                   f"max(`__hi_{v}_{k}`) {w} AS `__HI_{v}_{k}`"]
    pass2 = pass1.selectExpr(*CELL, *[q(c) for c in cols.values()], *p2)
    out = [*CELL]
    for v, c in cols.items():
        for k in sizes:
            n = f"`__N_{v}_{k}`"
            m = f"(CASE WHEN {n} > 0 THEN `__S_{v}_{k}` / {n} END)"
            var = f"(CASE WHEN {n} > 0 THEN `__Q_{v}_{k}` / {n} END) - {m} * {m}"
            out += [f"{m} + {centre[v]!r}D AS `{v}_local_mean_w{k}`",
                    f"sqrt(greatest({var}, 0.0D)) AS `{v}_local_std_w{k}`",
                    f"`__HI_{v}_{k}` - `__LO_{v}_{k}` AS `{v}_local_range_w{k}`",
                    f"{q(c)} - ({m} + {centre[v]!r}D) AS `{v}_local_contrast_w{k}`"]
    return pass2.selectExpr(*out)
