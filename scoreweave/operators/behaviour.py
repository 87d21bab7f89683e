"""Model-to-human agreement on choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.ordering import grouped_median
from .align import first_per_key
from .scoring import cohen_kappa


def participant_kappa(model: DataFrame, human: DataFrame) -> DataFrame:
    """Kappa per (scenario, participant) on the stimuli both answered.

    ``model``: stimulus, scenario, choice, label, ord; ``human``: stimulus, scenario, participant,
    response, ord.  Duplicates resolve to the first row by ``ord``.
    """
    m = model.groupBy("scenario", "stimulus").agg(F.min_by("choice", "ord").alias("choice"))
    h = human.groupBy("scenario", "participant", "stimulus").agg(F.min_by("response", "ord").alias("response"))
    return cohen_kappa(h.join(m, ["scenario", "stimulus"]), ["scenario", "participant"], "choice", "response")


def scenario_kappa(model: DataFrame, human: DataFrame) -> DataFrame:
    """Per scenario: median kappa over participants (0 if none) and the model's accuracy."""
    kappas = participant_kappa(model, human)
    med = grouped_median(kappas, ["scenario"], "kappa", "kappa")
    acc = model.groupBy("scenario").agg(F.avg((F.col("choice") == F.col("label")).cast("double")).alias("accuracy"))
    return acc.join(med, "scenario", "left").select(
        "scenario", F.coalesce("kappa", F.lit(0.0)).alias("kappa"), "accuracy"
    )


def model_human_kappa(model: DataFrame, human: DataFrame) -> DataFrame:
    """Mean and population spread of the scenario kappas, plus overall accuracy."""
    per = scenario_kappa(model, human)
    overall = model.agg(F.avg((F.col("choice") == F.col("label")).cast("double")).alias("a"))
    return per.agg(
        F.avg("kappa").alias("center"), F.stddev_pop("kappa").alias("error"), F.count("scenario").alias("n_scenarios")
    ).withColumn("accuracy", overall.scalar())


def chebyshev(a: Column | str, b: Column | str, grid: int = 16) -> Column:
    a, b = col(a), col(b)
    dy = F.abs(F.floor(a / grid) - F.floor(b / grid))
    dx = F.abs(a % grid - b % grid)
    return F.greatest(dy, dx).cast("double")


def euclidean(a: Column | str, b: Column | str, grid: int = 16) -> Column:
    a, b = col(a), col(b)
    dy = (F.floor(a / grid) - F.floor(b / grid)).cast("double")
    dx = (a % grid - b % grid).cast("double")
    return F.sqrt(dy * dy + dx * dx)


def _pair_scores(a: str, b: str, name: str, near: bool, grid: int) -> list[Column]:
    out = [
        F.avg((F.col(a) == F.col(b)).cast("double")).alias(f"accuracy_{name}"),
        F.avg(chebyshev(a, b, grid)).alias(f"chebyshev_distance_{name}"),
        F.avg(euclidean(a, b, grid)).alias(f"euclidean_distance_{name}"),
    ]
    if near:
        out += [
            F.avg((chebyshev(a, b, grid) <= 1).cast("double")).alias(f"accuracy_cheby_{name}"),
            F.avg((euclidean(a, b, grid) <= 1).cast("double")).alias(f"accuracy_euclidean_{name}"),
        ]
    return out


def grid_accuracy(model: DataFrame, human: DataFrame, key: str = "stimulus", order: str = "ord", grid: int = 16) -> DataFrame:
    """Exact and distance-based agreement of model, human and ground truth on a square grid.

    ``model``: key, order, choice, contacts; ``human``: key, order, choice.  Model against ground
    truth uses all model rows; comparisons with humans use the first row per joint stimulus.
    """
    alone = model.agg(*_pair_scores("contacts", "choice", "model_gt", True, grid))
    m = first_per_key(model, key, order).select(key, F.col("choice").alias("m"), F.col("contacts").alias("g"))
    h = first_per_key(human, key, order).select(key, F.col("choice").alias("h"))
    joint = m.join(h, key).agg(
        *_pair_scores("h", "m", "model_human", False, grid), *_pair_scores("h", "g", "human_gt", False, grid)
    )
    # two one-row tables: scalar subqueries instead of a join
    for c in alone.columns:
        joint = joint.withColumn(c, alone.select(c).scalar())
    return joint
