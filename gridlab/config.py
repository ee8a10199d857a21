"""Fixed values and the operators' parameters.

Values that must equal the reference's for equal results stand together in the
marked block. Each operator has a small parameter record of its own, which
holds only what it uses; the two larger records bundle them for a whole build.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# ---- fixed values (must match the reference) -------------------------------
CLIMATE_VARIABLES: tuple[str, ...] = (
    "tmax", "tmin", "vap", "ppt", "srad", "ws", "aet", "pet", "q", "def",
    "soil", "swe", "pdsi", "vpd",
)
SEASONS: dict[str, tuple[int, ...]] = {
    "djf": (12, 1, 2), "mam": (3, 4, 5), "jja": (6, 7, 8), "son": (9, 10, 11),
}
RAW_MONTHLY_VARIABLES: tuple[str, ...] = (
    "soil", "ppt", "vap", "tmin", "tmax", "def", "pdsi", "vpd",
)
ANOMALY_VARIABLES: tuple[str, ...] = ("ppt", "soil", "vpd", "def")
PROTECTED_COLUMNS: tuple[str, ...] = (
    "ID", "Latitude", "Longitude", "Occurrence Status", "spatial_group",
)
CANDIDATE_SUFFIXES: tuple[str, ...] = ("_median", "_seasonal_amp", "_cv")
EPSILON = 1e-6
FEATURE_SCHEMA_VERSION = 3
FIRST_MONTH, LAST_MONTH = "2017-11-01", "2019-11-01"
WEST, SOUTH, EAST, NORTH = 139.94, -39.74, 151.48, -30.92
SEED = 42
MODEL_SEEDS = (42, 202, 404)
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Crop:
    """Months (inclusive) and bounding box of a cube."""
    months: tuple[str, str] = (FIRST_MONTH, LAST_MONTH)
    lat: tuple[float, float] = (SOUTH, NORTH)
    lon: tuple[float, float] = (WEST, EAST)


@dataclass(frozen=True)
class Reducers:
    """Per-cell statistics over time; recent: length of the last-n mean;
    extremes: quantiles that bound dry and wet months."""
    quantiles: tuple[float, float] = (0.10, 0.90)
    recent: int = 6
    extremes: tuple[float, float] = (0.25, 0.75)


@dataclass(frozen=True)
class BackgroundGrid:
    """Every ``stride``-th cell; ``cap`` rows at most (None: all)."""
    stride: int = 2
    cap: int | None = None
    seed: int = SEED


@dataclass(frozen=True)
class FeatureParams:
    variables: tuple[str, ...] = CLIMATE_VARIABLES
    monthly_variables: tuple[str, ...] = RAW_MONTHLY_VARIABLES
    temporal: Reducers = Reducers()
    focal_widths: tuple[int, ...] = (3, 5, 7)
    block_degrees: float = 0.5
    grid: BackgroundGrid = BackgroundGrid()


def arange(start: float, stop: float, step: float) -> list[float]:
    """NumPy's start + i*step grid, so thresholds are bit-identical."""
    return [float(x) for x in np.arange(start, stop, step)]


@dataclass(frozen=True)
class Thresholds:
    """Lowest and highest threshold and their distance."""
    lowest: float
    highest: float
    step: float

    def values(self) -> list[float]:
        return arange(self.lowest, self.highest + self.step, self.step)


@dataclass(frozen=True)
class ThresholdParams:
    optimised: Thresholds = Thresholds(0.10, 0.90, 0.01)
    public: Thresholds = Thresholds(0.45, 0.85, 0.02)
    focus: tuple[float, float] = (0.55, 0.81)
    around_best: tuple[float, float] = (0.12, 0.02)  # radius and step


@dataclass(frozen=True)
class Bagging:
    """Bags of a fold, and their negatives as a share of the fold's."""
    bags: int = 5
    fraction: float = 1.0


@dataclass(frozen=True)
class Background:
    """Pseudo-absences of a fold. ratio: to its positives; buffer:
    degrees kept free around these; far and hard: quantiles of the distance in
    feature space, hard_share of the draws come from between the hard ones."""
    bags: int = 3
    ratio: float = 1.0
    buffer: float = 0.20
    far: float = 0.80
    hard: tuple[float, float] = (0.10, 0.45)
    hard_share: float = 0.35


@dataclass(frozen=True)
class Ensembles:
    """How many candidates enter each step, and how alike
    diverse ones may be."""
    diverse: int = 6
    max_correlation: float = 0.995
    stacked: int = 5
    calibrated: int = 6
    calibrations: tuple[str, ...] = ("sigmoid", "isotonic")


@dataclass(frozen=True)
class Boosting:
    """M5: the most rounds, and for how many without a better held-out loss
    they go on."""
    rounds: int
    depth: int
    rate: float
    patience: int = 10


@dataclass(frozen=True)
class ModelSizes:
    """M4-M7: sizes of the fits. Depths are Spark's (at most 30)."""
    logistic_iterations: int = 2000
    boosted_trees: Boosting = Boosting(900, 6, 0.03)
    boosted_deep: Boosting = Boosting(1200, 7, 0.025)
    boosted_slow: Boosting = Boosting(1400, 5, 0.02)
    trees: int = 1200
    variant_trees: int = 1400
    tree_depth: int = 30
    hidden: tuple[int, ...] = (256, 128, 64)
    network_iterations: int = 200


#: for tests and registered queries but model_suite, which have minutes; the linear model has its full size
SMALL_MODELS = ModelSizes(2000, Boosting(8, 3, 0.2), Boosting(6, 4, 0.2), Boosting(10, 2, 0.2), 20, 24, 6, (16, 8, 4), 40)


@dataclass(frozen=True)
class ModelParams:
    seed: int = SEED
    seeds: tuple[int, ...] = MODEL_SEEDS
    folds: int = 5
    sizes: ModelSizes = ModelSizes()
    thresholds: ThresholdParams = ThresholdParams()
    bagging: Bagging = Bagging()
    background: Background = Background()
    ensembles: Ensembles = Ensembles()


def optimize_grid(params: ModelParams = ModelParams()) -> list[float]:
    return params.thresholds.optimised.values()


def public_grid(params: ModelParams = ModelParams()) -> list[float]:
    return params.thresholds.public.values()


def focus_grid(grid: list[float], params: ModelParams = ModelParams()) -> list[float]:
    lo, hi = params.thresholds.focus
    return [t for t in grid if lo <= t <= hi] or list(grid)


def local_grid(center: float, params: ModelParams = ModelParams()) -> list[float]:
    """Thresholds around the best one, inside [0.05, 0.95]."""
    radius, step = params.thresholds.around_best
    return Thresholds(max(0.05, center - radius), min(0.95, center + radius), step).values()


@dataclass(frozen=True)
class CubeSpec:
    """Shape of a dense long cube: axis lengths and the time origin."""
    n_lat: int
    n_lon: int
    n_time: int
    start_month: str
    variables: tuple[str, ...]
    lat_values: tuple[float, ...] = field(default=())
    lon_values: tuple[float, ...] = field(default=())
