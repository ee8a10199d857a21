"""Splitting (F2, R1, R2) and class weights."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import md5_int
from .ordering import global_row_number, group_row_number


def group_folds(rows: DataFrame, group_col: str = "grp", y_col: str = "y", k: int = 5,
                seed: int = 42) -> DataFrame:
    """R2: stratified group k-fold. Groups are ranked by (positives desc,
    negatives desc, seeded hash) and dealt to folds in serpentine order
    (0..k-1, k-1..0, ...), so no group spans two folds and class counts stay
    balanced. Returns (group, pos, neg, fold)."""
    g = rows.groupBy(group_col).agg(F.sum(y_col).cast("long").alias("pos"),
                                    F.sum(F.lit(1) - F.col(y_col)).cast("long").alias("neg"))
    g = g.withColumn("__h", md5_int(F.lit(seed), F.col(group_col)))
    r = global_row_number(g, [F.col("pos").desc(), F.col("neg").desc(), F.col("__h"), F.col(group_col)], "__rn")
    pos = (F.col("__rn") - 1) % (2 * k)
    return r.select(group_col, "pos", "neg",
                    F.when(pos < k, pos).otherwise(2 * k - 1 - pos).cast("int").alias("fold"))


def assign_folds(rows: DataFrame, folds: DataFrame, group_col: str = "grp") -> DataFrame:
    return rows.join(folds.select(group_col, "fold"), group_col)


def stratified_split(rows: DataFrame, key: str = "row_id", y_col: str = "y",
                     valid_fraction: float = 0.3, seed: int = 42) -> DataFrame:
    """Per class, the first ceil(fraction * n_class) rows in seeded hash
    order are validation rows."""
    h = rows.withColumn("__h", md5_int(F.lit(seed), F.col(key)))
    r = group_row_number(h, [y_col], ["__h", key], "__rn", with_count=True)
    return (r.withColumn("is_valid", F.col("__rn") <= F.ceil(F.col("__rn_n") * F.lit(valid_fraction)))
            .drop("__h", "__rn", "__rn_n"))


def class_weights(rows: DataFrame, y_col: str = "y") -> DataFrame:
    """Balanced weights n / (k * n_class), from one count per class (a
    handful, collected)."""
    counts = {r[0]: r[1] for r in rows.groupBy(y_col).agg(F.count(F.lit(1))).collect()}
    n, k = sum(counts.values()), len(counts)
    weight = F.lit(None).cast("double")
    for y, own in counts.items():
        weight = F.when(F.col(y_col).eqNullSafe(F.lit(y)), F.lit(n / (k * own))).otherwise(weight)
    return rows.withColumn("weight", weight)
