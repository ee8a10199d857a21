"""Distributed row numbering and running sums (no single-partition window).

``row_number() OVER (ORDER BY ...)`` without PARTITION BY runs in one task,
and a window partitioned by a low-cardinality key (class label, candidate)
puts a third of the rows in one task when that key is hot. Here the rows are
sorted by a range-partitioned sort and written, each with the number of its
part and its place in the part. All further jobs read that table, so parts
and places mean the same rows in every one of them, however the sort would
sample its bounds or coalesce its partitions if it ran again. A part's offset
in a group is the sum over the group's earlier parts: a table of at most
(parts + groups) rows, joined on (group, part), so no join key is hotter than
one part.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised

_PART_BITS = 33  # monotonically_increasing_id = part << 33 | place


def _sorted_parts(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The rows sorted by ``order`` and written, with __part and __at."""
    s = df.orderBy(*order).withColumn("__mid", F.monotonically_increasing_id())
    t = materialised(s, "sorted")
    return t.withColumns({"__part": F.shiftright("__mid", _PART_BITS),
                          "__at": F.col("__mid").bitwiseAND(F.lit((1 << _PART_BITS) - 1))}).drop("__mid")


def _with_offsets(t: DataFrame, groups: Sequence[str], value: Column) -> DataFrame:
    """Adds __before (sum of ``value`` over the group's earlier parts),
    __total (over the group) and __first (the group's first place in the part)."""
    names = [f"__g{i}" for i in range(len(groups))]
    per = t.groupBy(*[F.col(f"`{g}`").alias(n) for g, n in zip(groups, names)], F.col("__part").alias("__p")).agg(
        F.sum(value).alias("__sum"), F.min("__at").alias("__first"))
    whole = Window.partitionBy(*names) if names else Window.partitionBy()  # one row a part
    upto = whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*names, "__p", "__first", F.coalesce(F.sum("__sum").over(upto), F.lit(0)).alias("__before"),
                     F.sum("__sum").over(whole).alias("__total"))
    same = reduce(lambda a, b: a & b, [t[f"`{g}`"].eqNullSafe(per[n]) for g, n in zip(groups, names)],
                  t["__part"] == per["__p"])
    return t.join(per, same).drop(*names, "__p")


def group_row_number(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str],
                     name: str = "rn", with_count: bool = False) -> DataFrame:
    """``row_number() OVER (PARTITION BY groups ORDER BY order)``, numbers
    1..n of each group. ``order`` must be total for repeatable numbers.
    ``with_count`` adds the group's row count as ``{name}_n``."""
    t = _with_offsets(_sorted_parts(df, [*groups, *order]), groups, F.lit(1))
    more = {f"{name}_n": F.col("__total").cast("long")} if with_count else {}
    return t.withColumns({name: (F.col("__before") + F.col("__at") - F.col("__first") + 1).cast("long"), **more}) \
        .drop("__part", "__at", "__before", "__total", "__first")


def global_row_number(df: DataFrame, order: Sequence[Column | str], name: str = "rn") -> DataFrame:
    """1-based position of each row in ``order`` (which must be total)."""
    return group_row_number(df, [], order, name)


def group_running_sum(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], value: str,
                      name: str, total: str) -> DataFrame:
    """``sum(value) OVER (PARTITION BY groups ORDER BY order)`` up to and
    including each row, and the group's sum."""
    t = _with_offsets(_sorted_parts(df, [*groups, *order]), groups, F.col(f"`{value}`"))
    part = Window.partitionBy("__part", *[F.col(f"`{g}`") for g in groups]).orderBy("__at") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.withColumns({name: F.col("__before") + F.sum(f"`{value}`").over(part), total: F.col("__total")}) \
        .drop("__part", "__at", "__before", "__total", "__first")
