"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

Documents arrive in batches of ascending doc_id. The runs hold, for every line
key seen so far, its 128-bit hash and the id of the document that owns it (the
smallest that holds it). A run is a Parquet table bucketed and sorted by the
hash, so a new batch is anti-joined with the runs by merging, without dealing
the runs out again; the keys that no run has become a run of level 0. As soon
as a level has ``fanout`` runs they are merged into one run of the next level,
so a key is rewritten once a level and a batch meets few runs.

A line stays if its document owns its key. As (key, document) pairs are looked
up, a key that a third of all documents hold is spread over all tasks.

Defined cases: a null text is one empty line; rows without a doc_id are
documents after all others, equal texts among them one document; rows that repeat a doc_id are one document to
the rule, each with its own result row; an empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_or_null, row_id, run_folder, written

MIN_KEY_CHARS = 10
BATCHES = 4
FANOUT = 2
_WHITE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class LineRuns:
    """The levels of sorted runs, each run a bucketed table (h1, h2, id)."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int, fanout: int = FANOUT):
        self.spark, self.folder, self.buckets, self.fanout = spark, folder, buckets, max(2, fanout)
        self.levels: list[list[str]] = []
        self._made = 0

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{self.folder.rstrip('/').rsplit('-', 1)[-1]}_{self._made}"
        self._made += 1
        (keys.select("h1", "h2", "id").write.format("parquet").mode("overwrite")
         .bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .option("path", f"{self.folder}/{name}").saveAsTable(name))
        return name

    def add(self, keys: DataFrame) -> None:
        """Adds a batch: (h1, h2, id), one row a key, ids not below those of
        earlier batches."""
        for name in self.names():
            keys = keys.join(self.spark.table(name).hint("merge"), ["h1", "h2"], "left_anti")
        self._put(0, self._write(keys))

    def _put(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            both = self.keys(runs).repartition(self.buckets, "h1", "h2")
            merged = self._write(both)
            for old in runs:
                self.spark.sql(f"DROP TABLE IF EXISTS {old}")
            self._put(level + 1, merged)

    def keys(self, names: list[str] | None = None) -> DataFrame:
        """(h1, h2, id) of all runs; every key is in one run."""
        out = None
        for name in names or self.names():
            run = self.spark.read.schema("h1 long, h2 long, id long").parquet(f"{self.folder}/{name}")
            out = run if out is None else out.unionByName(run)
        return out

    def close(self) -> None:
        for name in self.names():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_WHITE)), _UPPER, _UPPER.lower())


def line_hashes(rows: DataFrame) -> DataFrame:
    """(id, version, pos, h1, h2) of each line whose key is long enough.
    rows: id, version, text."""
    return (rows.select("id", "version", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
            .select("id", "version", "pos", line_key(F.col("line")).alias("key"))
            .where(F.char_length("key") >= MIN_KEY_CHARS)
            .select("id", "version", "pos", F.xxhash64("key").alias("h1"),
                    F.xxhash64(F.lit(7), "key").alias("h2")))


def _rows(documents: DataFrame, *more: Column) -> DataFrame:
    """id, version (tells rows of one doc_id apart by text) and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(*more, row_id().alias("__id"), F.xxhash64(text).alias("__version"), text.alias("__text"))


def dropped_lines(documents: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(__id, __version, __drop): the sorted positions of the lines that go,
    for the documents that lose any."""
    spark = documents.sparkSession
    folder = run_folder(spark, "line-runs")
    rows = _rows(documents).toDF("id", "version", "text")
    bounds = documents.select(F.percentile_approx(row_id(), [k / batches for k in range(1, batches)], 10_000)).first()[0] \
        if batches > 1 else []
    batch = F.lit(0)
    for b in sorted(set(bounds or [])):
        batch = batch + F.when(F.col("id") > F.lit(b), 1).otherwise(0)
    lines = line_hashes(rows).withColumn("batch", batch)
    lines.write.mode("overwrite").partitionBy("batch").parquet(f"{folder}/lines")
    lines = spark.read.schema(lines.schema).parquet(f"{folder}/lines")

    runs = LineRuns(spark, folder, int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    for b in range(len(set(bounds or [])) + 1):
        runs.add(lines.where(F.col("batch") == b).groupBy("h1", "h2").agg(F.min("id").alias("id")))
    gone = lines.join(runs.keys(), ["id", "h1", "h2"], "left_anti")
    drops = written(gone.groupBy(F.col("id").alias("__id"), F.col("version").alias("__version"))
                    .agg(F.sort_array(F.collect_set("pos")).alias("__drop")), f"{folder}/drops")
    runs.close()
    return drops


def without_lines(text: Column, drop: Column) -> Column:
    """``text`` without the lines at the sorted positions ``drop``: the slices
    between them, so the work is linear in the number of lines."""
    lines = F.split(text, "\n")
    ends = F.concat(drop, F.array(F.size(lines)))
    slices = F.transform(ends, lambda end, k: F.slice(
        lines, F.when(k == 0, 1).otherwise(F.get(drop, k - 1) + 2),
        end - F.when(k == 0, 0).otherwise(F.get(drop, k - 1) + 1)))
    return F.when(F.size(F.coalesce(drop, F.array().cast("array<int>"))) == 0, text) \
        .otherwise(F.array_join(F.flatten(slices), "\n"))


def dedup_lines(documents: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, dropped (positions)
    and kept_text."""
    drops = dropped_lines(documents, batches, fanout)
    none = F.array().cast("array<int>")
    return (_rows(documents).join(drops, ["__id", "__version"], "left")
            .select(id_or_null("__id").alias("doc_id"),
                    F.size(F.split("__text", "\n")).cast("long").alias("n_lines"),
                    F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
                    F.coalesce("__drop", none).alias("dropped"),
                    without_lines(F.col("__text"), F.coalesce("__drop", none)).alias("kept_text")))


def replace_text(documents: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``documents`` with all their columns, ``text`` without the lines that
    go. A document that loses no line keeps its text as it is, null included."""
    drops = dropped_lines(documents, batches, fanout)
    rows = _rows(documents, F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__row"))
    kept = F.when(F.col("__drop").isNull(), F.col("__row.text")).otherwise(
        without_lines(F.col("__text"), F.col("__drop")))
    return rows.join(drops, ["__id", "__version"], "left").select(
        *[kept.alias("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in documents.columns])
