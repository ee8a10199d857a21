"""Scalar column expressions (all JVM-side built-ins, codegen friendly)."""
from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EPSILON


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_ratio(num, den, eps: float = EPSILON) -> Column:
    """num / den when |den| > eps, else NULL. Divides only inside the branch,
    so ANSI mode never sees a zero divisor."""
    num, den = _c(num), _c(den)
    return F.when(F.abs(den) > F.lit(eps), num / den)


def spatial_block(lat, lon, size: float = 0.5) -> Column:
    """Grid block id 'floor(lat/s)_floor(lon/s)'."""
    return F.concat_ws("_", F.floor(_c(lat) / F.lit(size)).cast("string"),
                       F.floor(_c(lon) / F.lit(size)).cast("string"))


def clip(x, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))


def logit(p, eps: float = EPSILON) -> Column:
    c = clip(p, eps, 1.0 - eps)
    return F.ln(c / (F.lit(1.0) - c))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def beta_basis(p, eps: float = EPSILON) -> tuple[Column, Column]:
    """(ln p, -ln(1-p)) on the clipped value."""
    c = clip(p, eps, 1.0 - eps)
    return F.ln(c), -F.log1p(-c)


def null_safe(pred: Column) -> Column:
    """A comparison involving NULL counts as false."""
    return F.coalesce(pred, F.lit(False))


def nan_to_null(x) -> Column:
    x = _c(x)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(math.inf)), None).otherwise(x)


def bucket_index(x, splits: Sequence[float]) -> Column:
    """Number of split points <= x, as a balanced CASE tree (log2(n) deep).

    Used for short, sorted threshold lists; stays inside whole-stage codegen.
    """
    x = _c(x)
    s = list(splits)

    def tree(lo: int, hi: int) -> Column:
        # answer lies in [lo, hi]
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2  # x >= s[mid-1] -> answer >= mid
        return F.when(x >= F.lit(s[mid - 1]), tree(mid, hi)).otherwise(tree(lo, mid - 1))

    return F.when(x.isNotNull(), tree(0, len(s)))


def md5_int(*parts) -> Column:
    """Deterministic 60-bit draw from md5 of ':'-joined parts.

    Same number as DuckDB ('0x' || substr(md5(s), 1, 15))::BIGINT."""
    s = F.concat_ws(":", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("bigint")


def f1_from_counts(tp, fp, fn) -> Column:
    """F1 of the positive class; 0.0 when tp+fp+fn = 0."""
    tp, fp, fn = _c(tp), _c(fp), _c(fn)
    den = F.lit(2.0) * tp + fp + fn
    return F.when(den > 0, F.lit(2.0) * tp / den).otherwise(F.lit(0.0))


def sha256_of(payload: str) -> str:
    """Driver-side digest of a config (first 16 hex digits)."""
    return hashlib.sha256(payload.encode("utf-8")).hexdigest()[:16]
