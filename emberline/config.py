"""Run settings: model targets, zoning radii, split sizes and scale limits."""
from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Target names, dropped columns and defaults of the data model.
    target_class: str = "fire_detected"
    target_reg: str = "fire_intensity"
    drop_cols: tuple[str, ...] = ("system:index", "geometry_json", ".geo", "date")
    leakage_cols: tuple[str, ...] = (
        "zone_id", "pixel_id", "timestamp", "acquisition_time", "detection_date", "fire_size_after",
    )
    non_features: tuple[str, ...] = ("row_id", "macro_zone", "ecozone")
    eps_km: float = 25.0
    min_samples: int = 120
    test_size: float = 0.2
    seed: int = 42
    trials: int = 30
    min_zone_rows: int = 200
    min_macro_rows: int = 2000
    min_cluster_rows: int = 150
    min_train_rows: int = 50
    route_k: int = 40
    max_null_share: float = 0.8
    ndvi_scale: float = 10000.0
    warmup_rows: int = 4000
    warmup_gate: float = 0.30
    boost_rounds: int = 200
    boost_rate: float = 0.1
    boost_depth: int = 5
    cv_folds: int = 5
    cv_repeats: int = 2
    min_fire_train: int = 10
    min_fire_test: int = 5
    # How many zones are trained at the same time.
    zone_workers: int = 4
    # How many trials of a zone's search for a classifier are fitted at the same time, at most.
    trial_workers: int = 1
