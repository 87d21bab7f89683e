"""Scorers over long predictions ``(target, y, p)`` and the score roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import columns as C
from ..functions.ordering import grouped_median

SCORERS = {
    "pearson": C.corrected_pearson,
    "r2": C.r_squared,
    "mse": C.mse,
    "ccc": C.concordance,
    "clipped_pearson": C.clipped_pearson,
    "guarded_r2": C.r_squared_guarded,
}


def score(df: DataFrame, keys: Sequence[str], scorers: dict | Sequence[str] = ("pearson", "r2"), y: str = "y", p: str = "p") -> DataFrame:
    """All requested scorers per key in one aggregate.

    ``scorers`` is a list of built-in names or ``{name: f(y, p) -> aggregate Column}``; user-defined
    grouped-aggregate pandas UDFs fit the same contract.
    """
    table = scorers if isinstance(scorers, dict) else {n: SCORERS[n] for n in scorers}
    return df.groupBy(*keys).agg(*[f(F.col(y), F.col(p)).alias(n) for n, f in table.items()])


def r2_summary(df: DataFrame, keys: Sequence[str] = (), unit: str = "unit") -> DataFrame:
    """Uniform-average and variance-weighted R2 over units."""
    per = df.groupBy(*keys, unit).agg(C.ss_res("y", "p").alias("res"), C.ss_tot("y", "p").alias("tot"))
    r2 = 1 - F.try_divide(F.col("res"), F.col("tot"))
    return per.groupBy(*keys).agg(
        F.avg(r2).alias("uniform_average"),
        F.try_divide(F.sum(F.col("tot") - F.col("res")), F.sum("tot")).alias("variance_weighted"),
    )


def summarise_targets(scores: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and exact median of a per-target score."""
    keys = list(keys)
    mean = scores.groupBy(*keys).agg(F.avg(value).alias(f"{value}_mean"))
    median = grouped_median(scores, keys, value, f"{value}_median")
    if keys:
        return mean.join(median, keys)
    return mean.withColumn(f"{value}_median", median.scalar())


def regression_losses(df: DataFrame, weight: float = 0.5, unit: str = "unit", y: str = "y", p: str = "p") -> DataFrame:
    """Correlation, concordance and combined losses plus the scale ratio, over all units.

    ``combined`` adds the weighted correlation loss; ``blended`` and ``ccc_mse`` mix with 1 - w.
    """
    per = df.groupBy(unit).agg(
        C.correlation_with_norm_floor(y, p).alias("corr"),
        C.concordance(y, p).alias("ccc"),
        C.ss_res(y, p).alias("sse"),
        F.count(F.lit(1)).alias("n"),
        F.stddev_samp(p).alias("sp"),
        F.stddev_samp(y).alias("sy"),
    )
    flat = per.agg(
        (-F.avg("corr")).alias("correlation_loss"),
        (1 - F.avg("ccc")).alias("ccc_loss"),
        (F.sum("sse") / F.sum("n")).alias("mse"),
        (F.avg("sp") / F.greatest(F.avg("sy"), F.lit(1e-6))).alias("scale_ratio"),
    )
    return flat.select(
        "correlation_loss",
        "ccc_loss",
        "mse",
        "scale_ratio",
        (F.col("mse") + weight * F.col("correlation_loss")).alias("combined"),
        ((1 - weight) * F.col("mse") + weight * F.col("correlation_loss")).alias("blended"),
        ((1 - weight) * F.col("mse") + weight * F.col("ccc_loss")).alias("ccc_mse"),
    )


# ---------------------------------------------------------------- classification


def confusion(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*keys, y, p).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_table(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    """Per (keys, class): times true, times predicted, times both.  Built from the confusion counts
    by emitting each cell under its row class and its column class; no joins."""
    cells = confusion(df, keys, y, p)
    same = F.when(F.col(y) == F.col(p), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col(y).alias("cls"), F.col("n").alias("rows"), F.lit(0).cast("long").alias("cols"), same.alias("hits")),
        F.struct(F.col(p).alias("cls"), F.lit(0).cast("long").alias("rows"), F.col("n").alias("cols"), F.lit(0).cast("long").alias("hits")),
    )
    long = cells.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
    return long.groupBy(*keys, "cls").agg(F.sum("rows").alias("rows"), F.sum("cols").alias("cols"), F.sum("hits").alias("hits"))


def classification_scores(df: DataFrame, keys: Sequence[str], y: str, p: str, positive=1, prefix: str = "") -> DataFrame:
    """Accuracy, F1 of the positive class, macro F1 (0 where undefined) and Cohen's kappa."""
    t = class_table(df, keys, y, p)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hits"), F.col("rows") + F.col("cols")), F.lit(0.0))
    out = t.groupBy(*keys).agg(
        F.sum("hits").alias("_h"),
        F.sum("rows").alias("_n"),
        F.sum(F.col("rows").cast("double") * F.col("cols")).alias("_m"),
        F.coalesce(F.max(F.when(F.col("cls") == positive, f1)), F.lit(0.0)).alias(f"{prefix}f1_binary"),
        F.avg(f1).alias(f"{prefix}f1_macro"),
    )
    return out.select(
        *keys,
        (F.col("_h") / F.col("_n")).alias(f"{prefix}accuracy"),
        f"{prefix}f1_binary",
        f"{prefix}f1_macro",
        _kappa(F.col("_h"), F.col("_n"), F.col("_m")).alias(f"{prefix}kappa"),
        F.col("_n").alias(f"{prefix}n"),
    )


def _kappa(hits: Column, n: Column, marginal: Column) -> Column:
    observed = hits / n
    chance = marginal / (n.cast("double") * n)
    return 1 - F.try_divide(1 - observed, 1 - chance)


def cohen_kappa(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    """Cohen's kappa per key; undefined (NULL) when chance agreement is complete."""
    return classification_scores(df, keys, y, p).select(*keys, "kappa", "n")


def dual_scores(df: DataFrame, keys: Sequence[str], pred: str, gt: str, behaviour: str) -> DataFrame:
    """The same scores against ground truth (``gt_``) and against behaviour (``human_``)."""
    keys = list(keys)
    a = classification_scores(df, keys, gt, pred, prefix="gt_")
    b = classification_scores(df, keys, behaviour, pred, prefix="human_")
    return a.join(b, keys)


# ---------------------------------------------------------------- roll-ups


def rollup(scores: DataFrame, ceilings: DataFrame | None, keys: Sequence[str], fold: str = "fold", unit: str = "unit", value: str = "score") -> DataFrame:
    """Median over units per fold, mean over folds; raw and ceiled."""
    from .align import apply_ceiling

    keys = list(keys)
    if ceilings is None:
        s = scores.withColumn("_ceiled", F.col(value))
    else:
        s = apply_ceiling(scores, ceilings, [unit], value).withColumn("_ceiled", F.col(f"ceiled_{value}"))
    raw = grouped_median(s, [*keys, fold], value, "raw")
    ceiled = grouped_median(s, [*keys, fold], "_ceiled", "ceiled")
    both = raw.join(ceiled, [*keys, fold], "left")
    return both.groupBy(*keys).agg(F.avg("raw").alias("final_unceiled"), F.avg("ceiled").alias("final"))


def rollup_time(scores: DataFrame, keys: Sequence[str], t: str = "t", fold: str = "fold", value: str = "score") -> DataFrame:
    """Three-axis roll-up: median over units per (fold, time), then mean over folds per time."""
    med = grouped_median(scores, [*keys, fold, t], value, "m")
    return med.groupBy(*keys, t).agg(F.avg("m").alias(f"final_{value}"))


def rollup_inverse(scores: DataFrame, keys: Sequence[str], fold: str = "fold", value: str = "score") -> DataFrame:
    """Inverse-map roll-up: never ceiled, so only the unceiled numbers exist."""
    med = grouped_median(scores, [*keys, fold], value, "m")
    return med.groupBy(*keys).agg(F.avg("m").alias(f"final_unceiled_{value}"))


# ---------------------------------------------------------------- feature and label statistics


def feature_stats(df: DataFrame, vec: str, floor: float = 1e-12) -> DataFrame:
    """Mean and n-1 standard deviation of every feature; Spark merges the central moments itself."""
    d = df.select(A.as_double(vec).alias("v")).agg(A.vector_mean("v").alias("m"), A.vector_std("v").alias("s"))
    zipped = F.arrays_zip(F.col("m"), F.col("s"))
    return d.select(F.posexplode(zipped).alias("unit", "z")).select(
        "unit", F.col("z.m").alias("mean"), F.greatest(F.col("z.s"), F.lit(floor)).alias("std")
    )


def label_stats(df: DataFrame, keys: Sequence[str], value: str, floor: float = 1e-8) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.greatest(F.stddev_samp(value), F.lit(floor)).alias("std"), F.count(value).alias("n")
    )


def robust_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact median and median absolute deviation per key."""
    keys = list(keys)
    med = grouped_median(df, keys, value, "median")
    dev = df.join(med, keys).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    return med.join(grouped_median(dev, keys, "_d", "mad"), keys)


def robust_zscore(df: DataFrame, keys: Sequence[str], value: str, out: str = "z") -> DataFrame:
    s = robust_stats(df, keys, value)
    z = (F.col(value) - F.col("median")) / (F.col("mad") * C.MAD_TO_SD + 1e-8)
    return df.join(s, list(keys)).withColumn(out, z).select(*df.columns, out)


def can_stratify(df: DataFrame, column: str, continuous: bool = False, min_per_class: int = 2) -> DataFrame:
    """One row: class counts and whether a stratified split is possible."""
    per = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    s = per.agg(F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("smallest"), F.sum("n").alias("n_rows"))
    ok = (F.col("n_classes") >= 2) & (F.col("smallest") >= min_per_class)
    if continuous:
        ok = ok & (F.col("n_classes") <= F.col("n_rows") * 0.5)
    return s.withColumn("stratify", F.coalesce(ok, F.lit(False)))
