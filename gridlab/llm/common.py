"""Shared pieces of the llm operators: table access, scratch tables, row ids."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlab.session import scratch_path

#: Rows without an id get one from here up, made of their text's hash: they
#: sort after all others (ids are below 2^62), and copies among them are equal.
NO_ID = 2**62


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_id(col: str = "doc_id", text: str = "text") -> Column:
    own = F.lit(NO_ID) + F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit(NO_ID - 1))
    return F.coalesce(F.col(col).cast("long"), own)


def id_or_null(col: str) -> Column:
    return F.when(F.col(col) < F.lit(NO_ID), F.col(col))


def run_folder(spark: SparkSession, operator: str) -> str:
    """A new folder for one run's tables, below the shared checkpoint folder."""
    return scratch_path(spark, f"{operator}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` and read it back: cuts the lineage at a table that every
    executor can read again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
