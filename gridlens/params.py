"""Default parameters.  Fixed values that must equal the reference's
defaults for the same results are stated here once, plainly."""

from __future__ import annotations

from dataclasses import dataclass, field


# ---- fixed values: defaults of the modelled application -------------------
TRAIN_RATIO = 0.8
GBT_TREES = 200
GBT_DEPTH = 6
GBT_STEP = 0.1
GBT_SUBSAMPLE = 0.8
GBT_COLSAMPLE = 0.8
GBT_MIN_CHILD = 3
GBT_PATIENCE = 50
SEED = 42
INTERVAL_TREES = 100
INTERVAL_DEPTH = 8
CV_SPLITS = 5
SHAP_SAMPLES = 100
LIME_FEATURES = 10
LIME_SAMPLES = 500
PDP_GRID = 50
PDP_GRID_2D = 30
ICE_GRID = 50
ICE_SAMPLES = 50
ANOMALY_THRESHOLD_PCT = 15.0
ANOMALY_MAX_RESULTS = 20
DIALOGUE_MAX_HISTORY = 5
DEFAULT_LAG_LOAD = 1500.0
Z_95 = 1.96
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """Frozen bundle of the defaults above; pass a modified copy to change."""

    train_ratio: float = TRAIN_RATIO
    gbt_trees: int = GBT_TREES
    gbt_depth: int = GBT_DEPTH
    gbt_step: float = GBT_STEP
    gbt_subsample: float = GBT_SUBSAMPLE
    gbt_colsample: float = GBT_COLSAMPLE
    gbt_min_child: int = GBT_MIN_CHILD
    seed: int = SEED
    interval_trees: int = INTERVAL_TREES
    interval_depth: int = INTERVAL_DEPTH
    cv_splits: int = CV_SPLITS
    anomaly_threshold_pct: float = ANOMALY_THRESHOLD_PCT
    anomaly_max_results: int = ANOMALY_MAX_RESULTS
    # chunk-with-halo layout for windows over one long series
    chunk_rows: int = 100_000
    halo_rows: int = 168
    extra: dict = field(default_factory=dict)


DEFAULTS = Settings()
