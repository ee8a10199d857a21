"""Bindings from the driver's test tables to our data model.

* cube   : ``lineitem`` by (l_suppkey, month of l_shipdate);
           lat_idx = l_suppkey div 10, lon_idx = l_suppkey mod 10, 1-degree axes.
* points : ``customer`` (train, label = BUILDING segment) and ``supplier`` (test).
* scores : ``labels`` x ``documents``; deterministic candidate probabilities.
* vectors: ``embeddings`` (positives = label 1).
* series : ``events`` by (user_id, day) as a second time axis.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CubeSpec
from .cube import densify_rows

# ---- fixed binding values ---------------------------------------------------
LON_CELLS = 10                   # lon_idx = l_suppkey mod 10
N_CANDIDATES = 8                 # score candidates m = 0..7
CANDIDATE_MULTIPLIER = 37        # p_m = ((doc_id * (37 + 2m)) mod 101) / 101
CANDIDATE_MODULUS = 101
# variable -> (per-row expression over lineitem, aggregate)
CUBE_BINDING = {
    "tmax": ("l_quantity / 2.0", "max"),
    "tmin": ("l_quantity / 2.0", "min"),
    "vap": ("l_discount", "avg"),
    "ppt": ("l_quantity", "avg"),
    "srad": ("l_extendedprice / 1000.0", "avg"),
    "pet": ("30.0 * (1.0 - l_tax)", "avg"),
    "def": ("30.0 * (1.0 - l_tax) - l_quantity", "avg"),
    "soil": ("l_tax * 100.0", "avg"),
    # offset keeps the per-cell mean away from 0 (cv = std/|mean| would be
    # ill-conditioned) while values still span both signs for drought masks
    "pdsi": ("(l_discount - 0.04) * 100.0", "avg"),
    "vpd": ("l_discount * l_tax * 1000.0", "avg"),
}
# -----------------------------------------------------------------------------
CUBE_VARIABLES = tuple(CUBE_BINDING)
_AGG = {"avg": F.avg, "max": F.max, "min": F.min}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_cube_spec(spark: SparkSession, sf_dir: str) -> CubeSpec:
    """Axis lengths and time origin (one small scalar aggregate)."""
    li = _table(spark, sf_dir, "lineitem")
    r = li.agg(F.min(F.trunc(F.col("l_shipdate").cast("date"), "month")).alias("m0"),
               F.max(F.trunc(F.col("l_shipdate").cast("date"), "month")).alias("m1"),
               F.max("l_suppkey").alias("smax")).first()
    n_time = (r.m1.year - r.m0.year) * 12 + (r.m1.month - r.m0.month) + 1
    n_lat = int(r.smax) // LON_CELLS + 1
    return CubeSpec(n_lat=n_lat, n_lon=LON_CELLS, n_time=n_time,
                    start_month=r.m0.isoformat(), variables=CUBE_VARIABLES,
                    lat_values=tuple(float(i) for i in range(n_lat)),
                    lon_values=tuple(float(i) for i in range(LON_CELLS)))


def lineitem_cube(spark: SparkSession, sf_dir: str,
                  spec: CubeSpec | None = None) -> tuple[DataFrame, CubeSpec]:
    """Dense long cube from ``lineitem``: every (cell, month) of the rectangle,
    NULL where no line item shipped. One shuffle (partial aggregation first)."""
    spec = spec or lineitem_cube_spec(spark, sf_dir)
    start = F.to_date(F.lit(spec.start_month))
    li = _table(spark, sf_dir, "lineitem")
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    obs = li.select(
        (F.col("l_suppkey") / LON_CELLS).cast("int").alias("lat_idx"),
        F.pmod(F.col("l_suppkey"), F.lit(LON_CELLS)).cast("int").alias("lon_idx"),
        F.months_between(month, start).cast("int").alias("time_idx"),
        *[F.expr(e).cast("double").alias(v) for v, (e, _) in CUBE_BINDING.items()],
    )
    skeleton = densify_rows(spark, spec).select(
        "lat_idx", "lon_idx", "time_idx",
        *[F.lit(None).cast("double").alias(v) for v in CUBE_BINDING])
    cube = (obs.unionByName(skeleton)
            .groupBy("lat_idx", "lon_idx", "time_idx")
            .agg(*[_AGG[a](v).alias(v) for v, (_, a) in CUBE_BINDING.items()]))
    cube = cube.select(
        "lat_idx", "lon_idx", "time_idx",
        F.col("lat_idx").cast("double").alias("lat"),
        F.col("lon_idx").cast("double").alias("lon"),
        F.add_months(start, F.col("time_idx")).alias("month"),
        *CUBE_VARIABLES)
    return cube, spec


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training points: ID, Latitude, Longitude, Occurrence Status."""
    c = _table(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ID"),
        (F.col("c_acctbal") / 1000.0).alias("Latitude"),
        (F.pmod(F.col("c_custkey"), F.lit(97)) / 10.0).alias("Longitude"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("Occurrence Status"))


def supplier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test points (no label): ID, Latitude, Longitude."""
    s = _table(spark, sf_dir, "supplier")
    return s.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ID"),
        (F.col("s_acctbal") / 1000.0).alias("Latitude"),
        (F.pmod(F.col("s_suppkey"), F.lit(97)) / 10.0).alias("Longitude"))


def candidate_p(doc_id, m) -> F.Column:
    return (F.pmod(doc_id * (F.lit(CANDIDATE_MULTIPLIER) + F.lit(2) * m),
                   F.lit(CANDIDATE_MODULUS)) / float(CANDIDATE_MODULUS))


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: row_id, split (oof if labelled, else test), y, grp."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = docs.join(labels, "doc_id", "left")
    return j.select(
        F.col("doc_id").alias("row_id"),
        F.when(F.col("quality").isNull(), "test").otherwise("oof").alias("split"),
        F.col("quality").cast("int").alias("y"),
        F.col("source").alias("grp"))


def candidate_names(n: int = N_CANDIDATES) -> list[str]:
    return [f"m{m}" for m in range(n)]


def score_predictions(spark: SparkSession, sf_dir: str,
                      n_candidates: int = N_CANDIDATES) -> DataFrame:
    """Long predictions table: candidate, build_order, split, row_id, y, grp, p."""
    rows = score_rows(spark, sf_dir)
    m = F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1)))
    return (rows.select("*", m.alias("build_order"))
            .select(F.concat(F.lit("m"), F.col("build_order").cast("string")).alias("candidate"),
                    "build_order", "split", "row_id", "y", "grp",
                    candidate_p(F.col("row_id"), F.col("build_order")).alias("p")))


def embedding_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(positives, candidates) with columns vec_id, features ARRAY<DOUBLE>."""
    e = _table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")
    return (e.where(F.col("label") == 1).drop("label"),
            e.where(F.col("label") != 1).drop("label"))


def events_cube(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, CubeSpec]:
    """Second series source: the users of ``events`` x days as a dense cube with
    one variable ``value`` (daily sum); lat_idx = 0, lon_idx = user_id."""
    ev = _table(spark, sf_dir, "events")
    day = F.to_date(F.col("ts"))
    r = ev.agg(F.min(day).alias("d0"), F.max(day).alias("d1"), F.countDistinct("user_id").alias("users")).first()
    n_time = (r.d1 - r.d0).days + 1
    spec = CubeSpec(n_lat=1, n_lon=int(r.users), n_time=n_time,
                    start_month=r.d0.isoformat(), variables=("value",))
    keys = (F.lit(0).alias("lat_idx"), F.col("user_id").cast("long").alias("lon_idx"))
    obs = ev.select(*keys, F.datediff(day, F.to_date(F.lit(spec.start_month))).alias("time_idx"),
                    F.col("value").cast("double").alias("value"))
    skel = ev.select(*keys).distinct().select("lat_idx", "lon_idx", F.explode(F.sequence(F.lit(0), F.lit(n_time - 1))).alias("time_idx"),
                                              F.lit(None).cast("double").alias("value"))
    cube = obs.unionByName(skel).groupBy("lat_idx", "lon_idx", "time_idx").agg(
        F.sum("value").alias("value"))
    return cube, spec


def fold_test_predictions(spark: SparkSession, sf_dir: str, n_candidates: int = N_CANDIDATES,
                          folds: int = 5, bags: int = 2) -> DataFrame:
    """Per-(fold, bag) test probabilities for A23:
    p = ((doc_id * (37 + 2m) + 7 fold + 3 bag) mod 101) / 101 on unlabelled documents."""
    rows = score_rows(spark, sf_dir).where(F.col("split") == "test")
    m = F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1))).alias("build_order")
    x = (rows.select("row_id", m)
         .select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
         .select("*", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))).alias("bag")))
    raw = (F.col("row_id") * (F.lit(CANDIDATE_MULTIPLIER) + F.lit(2) * F.col("build_order"))
           + F.lit(7) * F.col("fold") + F.lit(3) * F.col("bag"))
    return x.select(F.concat(F.lit("m"), F.col("build_order").cast("string")).alias("candidate"),
                    "row_id", "fold", "bag",
                    (F.pmod(raw, F.lit(CANDIDATE_MODULUS)) / float(CANDIDATE_MODULUS)).alias("p"))
