"""Registered metrics: folds or a fixed split, one moment pass, a solver, scores as rows.

Every metric returns (run, target, pearson, r2...) or a similarity table; ``runs.roll`` turns
per-target scores into final numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.registry import MetricInput, register
from ..operators import linear as L
from ..operators import matching as M
from ..operators import similarity as S
from ..operators.dual import ridge_dual
from ..operators.gram import MAX_DIM, Moments, moments
from ..operators.splits import holdout, kfold, stratified_kfold
from ..operators.tiles import ridge_subsampled


def parted(inp: MetricInput, with_val: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows with a ``part`` label, and the design that reads it."""
    spark = inp.rows.sparkSession
    if inp.split is not None:
        if not with_val:
            return inp.rows.withColumn("part", F.col(inp.split)), L.train_test_design(spark)
        train = holdout(inp.rows.where(F.col(inp.split) == "train"), inp.key, 0.1, out="is_val")
        rows = train.withColumn("part", F.when(F.col("is_val"), "val").otherwise("fit")).unionByName(
            inp.rows.where(F.col(inp.split) == "test").withColumn("is_val", F.lit(False)).withColumn("part", F.lit("test"))
        )
        return rows, L.holdout_design(spark)
    if inp.stratify is not None:
        rows = stratified_kfold(inp.rows, inp.key, inp.stratify, inp.folds)
    else:
        rows = kfold(inp.rows, inp.key, inp.folds)
    if with_val:
        rows = holdout(rows, inp.key, 0.1, seed=43, out="is_val")
        label = F.concat(F.col("fold").cast("string"), F.when(F.col("is_val"), "v").otherwise(""))
        return rows.withColumn("part", label), L.cv_design(spark, inp.folds, holdout=True)
    return rows.withColumn("part", F.col("fold").cast("string")), L.cv_design(spark, inp.folds)


def _moments(inp: MetricInput, rows: DataFrame, x: str | None = None, y: str | None = None, parts: int = 0) -> Moments:
    return moments(rows, "part", x or inp.x, y or inp.y, pilot=inp.rows, parts=parts or 2 * inp.folds)


@register("ridge")
def ridge(inp: MetricInput, alphas: Sequence[float] = L.RIDGE_ALPHAS, subsample: int | None = None) -> DataFrame:
    """Per-target alpha by leave-one-out; optionally a shared alpha searched on few features.

    With ``subsample`` features may be of any number; without, more of them than a Gram can hold are solved on the stimulus kernel.
    """
    rows, plan = parted(inp)
    if subsample is not None:
        return ridge_subsampled(rows, "part", inp.x, inp.y, plan, subsample, alphas)
    if inp.rows.select(F.size(inp.x)).first()[0] > MAX_DIM:
        return ridge_dual(rows, inp.key, "part", inp.x, inp.y, plan, alphas)
    return L.ridge_loo(rows, "part", inp.x, inp.y, _moments(inp, rows), plan, alphas)


@register("torch_ridge")
def holdout_ridge(inp: MetricInput, alphas: Sequence[float] = L.RIDGE_ALPHAS) -> DataFrame:
    rows, plan = parted(inp, with_val=True)
    return L.ridge_holdout(_moments(inp, rows), plan, alphas)


@register("torch_lasso")
def lasso(inp: MetricInput, alphas: Sequence[float] = L.RIDGE_ALPHAS, **kw) -> DataFrame:
    rows, plan = parted(inp, with_val=True)
    return L.elastic_net(_moments(inp, rows), plan, alphas, 1.0, **kw)


@register("torch_elastic")
def elastic(inp: MetricInput, alphas: Sequence[float] = L.RIDGE_ALPHAS, **kw) -> DataFrame:
    rows, plan = parted(inp, with_val=True)
    return L.elastic_net(_moments(inp, rows), plan, alphas, 0.5, **kw)


@register("pls")
def pls(inp: MetricInput, components: Sequence[int] = L.PLS_COMPONENTS) -> DataFrame:
    rows, plan = parted(inp, with_val=True)
    return L.pls(_moments(inp, rows), plan, components)


@register("temporal_ridge")
def temporal_ridge(inp: MetricInput, n_times: int, alphas: Sequence[float] = L.RIDGE_ALPHAS) -> DataFrame:
    """Targets are (unit, time) flattened with time fastest; the result carries both again."""
    out = ridge(inp, alphas)
    return out.withColumn("unit", F.floor(F.col("target") / n_times).cast("int")).withColumn("t", F.col("target") % n_times)


@register("inverse_ridge")
def inverse_ridge(inp: MetricInput, alphas: Sequence[float] = L.RIDGE_ALPHAS) -> DataFrame:
    """Responses predict features; never ceiled."""
    swapped = MetricInput(inp.rows, inp.key, inp.y, inp.x, inp.split, inp.stratify, None, inp.folds)
    return ridge(swapped, alphas)


@register("bidirectional")
def bidirectional(inp: MetricInput, alphas: Sequence[float] = L.RIDGE_ALPHAS) -> DataFrame:
    """Both directions from one joint moment pass; ``direction`` tells them apart."""
    rows, plan = parted(inp)
    joint = rows.withColumn("_xy", F.concat(A.as_double(inp.x), A.as_double(inp.y)))
    m = moments(joint, "part", "_xy", pilot=inp.rows.withColumn("_xy", F.concat(A.as_double(inp.x), A.as_double(inp.y))), parts=inp.folds)
    d = inp.rows.select(F.size(inp.x)).first()[0]
    ahead, back = m.view((0, d), (d, m.dim_x)), m.view((d, m.dim_x), (0, d))
    a = L.ridge_loo(rows, "part", inp.x, inp.y, ahead, plan, alphas).withColumn("direction", F.lit("source_to_target"))
    b = L.ridge_loo(rows, "part", inp.y, inp.x, back, plan, alphas).withColumn("direction", F.lit("target_to_source"))
    return a.unionByName(b)


@register("semi_matching")
def semi_matching(inp: MetricInput) -> DataFrame:
    rows, plan = _test_parts(inp)
    return M.semi_match(_moments(inp, rows))


@register("one_to_one")
def one_to_one(inp: MetricInput, rectangular: bool = False) -> DataFrame:
    rows, plan = _test_parts(inp)
    return M.one_to_one(_moments(inp, rows), rectangular)


def _test_parts(inp: MetricInput) -> tuple[DataFrame, DataFrame]:
    """Matching has no training step: the scored rows are the test rows of each fold."""
    rows, plan = parted(inp)
    return (rows.where(F.col("part") == "test") if inp.split is not None else rows), plan


@register("soft_matching")
def soft_matching(inp: MetricInput, regs: Sequence[float] = M.TRANSPORT_REGS, max_iter: int = 2000) -> DataFrame:
    rows, plan = parted(inp, with_val=True)
    return M.soft_match(_moments(inp, rows), plan, regs, max_iter)


@register("rsa")
def rsa(inp: MetricInput, methods: Sequence[str] = ("spearman", "corr", "kendall", "cosine")) -> DataFrame:
    rows = inp.rows.where(F.col(inp.split) == "test") if inp.split is not None else inp.rows
    a = S.correlation_rows(rows, [], inp.key, inp.x)
    b = S.correlation_rows(rows, [], inp.key, inp.y)
    return S.compare_rdm(S.pair_up(a, b, []), [], methods)


@register("temporal_rsa")
def temporal_rsa(inp: MetricInput, t: str = "t", methods: Sequence[str] = ("spearman", "corr", "kendall", "cosine")) -> DataFrame:
    """Rows are (stimulus, t) with the static feature vector repeated or time-resolved."""
    a = S.correlation_rows(inp.rows, [t], inp.key, inp.x)
    b = S.correlation_rows(inp.rows, [t], inp.key, inp.y)
    return S.compare_rdm(S.pair_up(a, b, [t]), [t], methods)


@register("versa")
def versa(inp: MetricInput, alphas: Sequence[float] = L.SIMILARITY_ALPHAS) -> DataFrame:
    """A fixed split gives one score; otherwise each fold is the test set once."""
    if inp.split is not None:
        return S.versa(inp.rows, inp.key, inp.x, inp.y, inp.split, alphas).withColumn("run", F.lit("0"))
    rows = kfold(inp.rows, inp.key, inp.folds)
    out = None
    for f in range(inp.folds):
        split = rows.withColumn("_split", F.when(F.col("fold") == f, "test").otherwise("train"))
        one = S.versa(split, inp.key, inp.x, inp.y, "_split", alphas).withColumn("run", F.lit(str(f)))
        out = one if out is None else out.unionByName(one)
    return out


@register("online_linear_regressor")
def loss_regressor(inp: MetricInput, loss: str = "mse", weight: float = 0.5) -> DataFrame:
    rows, plan = parted(inp, with_val=True)
    return L.loss_regressor(_moments(inp, rows), plan, loss, weight)


@register("online_linear_classifier")
def linear_classifier(inp: MetricInput, label: str = "label", c_grid: Sequence[float] = (1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)) -> DataFrame:
    """Accuracy, F1 and kappa of a linear classifier on the test rows."""
    from ..operators.scoring import classification_scores

    return classification_scores(_classified(inp, label, c_grid), [], label, "pred")


def _classified(inp: MetricInput, label: str, c_grid: Sequence[float]) -> DataFrame:
    """(key, label, pred) of the test rows, by a linear classifier fitted on the others."""
    from ..operators.classify import classify, fit_classifier

    split = inp.split or "_split"
    rows = inp.rows if inp.split else holdout(inp.rows, inp.key, 0.1, label, out="_v").withColumn(
        "_split", F.when(F.col("_v"), "test").otherwise("train"))
    fitted = fit_classifier(rows.where(F.col(split) == "train"), inp.key, inp.x, label, c_grid)
    test = rows.where(F.col(split) == "test")
    return classify(test, fitted, [inp.key, label], inp.x)


C_GRID = (1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)


@register("physion_contact_prediction")
@register("physion_contact_detection")
def contact_agreement(inp: MetricInput, human: DataFrame, label: str = "label", c_grid: Sequence[float] = C_GRID) -> DataFrame:
    """Agreement of the classifier's choices with people's, scenario by scenario: mean kappa, its spread, accuracy.

    ``human``: stimulus, scenario, participant, response, ord.  The two names differ by the human table that they are given.
    """
    from ..operators.align import attach_scenario
    from ..operators.behaviour import model_human_kappa

    key = F.col(inp.key)
    model = _classified(inp, label, c_grid).select(key.alias("stimulus"), F.col("pred").alias("choice"), F.col(label).alias("label"), key.alias("ord"))
    return model_human_kappa(attach_scenario(model, human, "stimulus"), human)


@register("physion_placement_prediction")
@register("physion_placement_detection")
def placement_agreement(inp: MetricInput, human: DataFrame, label: str = "label", c_grid: Sequence[float] = C_GRID, grid: int = 16) -> DataFrame:
    """Exact and distance-based agreement of classifier, people and truth on the cells of a square grid.  ``human``: stimulus, choice, ord."""
    from ..operators.behaviour import grid_accuracy

    key = F.col(inp.key)
    model = _classified(inp, label, c_grid).select(key.alias("stimulus"), F.col("pred").alias("choice"), F.col(label).alias("contacts"), key.alias("ord"))
    return grid_accuracy(model, human, "stimulus", "ord", grid)


@register("orientation_selectivity")
def orientation_selectivity(inp: MetricInput, angle: str = "angle") -> DataFrame:
    """Circular variance of every feature over the angles of the stimuli."""
    from ..operators.tuning import circular_variance

    long = inp.rows.select(F.col(angle).alias("angle"), F.posexplode(A.as_double(inp.x)).alias("unit", "response"))
    return circular_variance(long)
