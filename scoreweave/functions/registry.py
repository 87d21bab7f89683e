"""Metric names, groups and the shared call contract.

A metric is ``f(MetricInput, **params) -> DataFrame``.  Users add their own with ``register``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

METRICS: dict[str, Callable[..., DataFrame]] = {}

# Metric names by the kind of analysis, in reporting order.
METRIC_GROUPS: dict[str, tuple[str, ...]] = {
    "offline_regression": ("ridge", "torch_ridge", "torch_lasso", "torch_elastic", "pls", "temporal_ridge", "inverse_ridge"),
    "offline_similarity": ("rsa", "temporal_rsa", "versa", "bidirectional", "one_to_one", "soft_matching", "semi_matching"),
    "online_regression": ("online_linear_regressor",),
    "online_classification": ("online_linear_classifier", "online_transformer_classifier"),
    "physion_contact": ("physion_contact_prediction", "physion_contact_detection"),
    "physion_placement": ("physion_placement_prediction", "physion_placement_detection"),
    "topographic": ("orientation_selectivity",),
    "tr_level": ("ridge", "temporal_rsa"),
}
# Benchmark-name prefixes and the groups they accept; the first match wins.
PREFIX_GROUPS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("LeBel2023AudioTR", ("tr_level",)),
    ("LeBel2023TR", ("tr_level",)),
    ("LeBel2023Audio", ("offline_regression", "offline_similarity")),
    ("NSD", ("offline_regression", "offline_similarity")),
    ("TVSD", ("offline_regression", "offline_similarity")),
    ("BMD", ("offline_regression", "offline_similarity")),
    ("LeBel2023", ("offline_regression", "offline_similarity")),
    ("V1", ("offline_regression", "offline_similarity", "topographic")),
    ("PhysionContact", ("offline_regression", "offline_similarity")),
    ("PhysionPlacement", ("offline_regression", "offline_similarity")),
    ("PhysionIntra", ("offline_regression", "offline_similarity")),
    ("OnlineTVSD", ("online_regression",)),
    ("OnlinePhysionContact", ("online_classification", "physion_contact")),
    ("OnlinePhysionIntraContact", ("online_classification", "physion_contact")),
    ("OnlinePhysionPlacement", ("online_classification", "physion_placement")),
    ("OnlinePhysionIntraPlacement", ("online_classification", "physion_placement")),
    ("SSV2", ("online_classification",)),
    ("AugmentedSSV2", ("online_classification",)),
)


@dataclass
class MetricInput:
    """One row per stimulus: ``key``, feature vector ``x``, response vector ``y``.

    ``split`` (column with 'train'/'test') scores a fixed test set; without it the metric
    cross-validates, stratified by ``stratify`` if given.  ``ceiling`` has (target, ceiling).
    """

    rows: DataFrame
    key: str = "stimulus_id"
    x: str = "x"
    y: str = "y"
    split: str | None = None
    stratify: str | None = None
    ceiling: DataFrame | None = None
    folds: int = 10


def register(name: str):
    def add(fn):
        METRICS[name] = fn
        return fn

    return add


def get_metric(name: str) -> Callable[..., DataFrame]:
    from ..plans import metrics  # noqa: F401  (fills the registry)

    if name not in METRICS:
        raise KeyError(f"unknown metric {name!r}; known: {sorted(METRICS)}")
    return METRICS[name]
