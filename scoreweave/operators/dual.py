"""Ridge for more features than a Gram can hold: solve on the stimulus-by-stimulus kernel.

The kernel X X' is a sum over feature blocks, so each block is one task whatever the number of
features.  All runs then share the one kernel: a run's centred training kernel is a sub-matrix of it.
Needs at most ``gram.MAX_DIM`` stimuli; with more stimuli than that, use the primal side.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.matrices import stack
from ..session import cut_lineage
from .gram import MAX_DIM
from .linear import RIDGE_ALPHAS, TARGET_BLOCK, nan_free
from .windows import pick_best

FEATURE_BLOCK = 2048
SCORES = "run string, target int, alpha double, pearson double, r2 double, n_test long"


def index_rows(df: DataFrame, key: str, part: str, x: str, y: str) -> DataFrame:
    """Rows with a dense stimulus index ``i``; their number is checked first."""
    n = df.count()
    if n > MAX_DIM:
        raise ValueError(f"{n} stimuli and too many features for either side; project the features first")
    # at most MAX_DIM keys are ordered here, without their vectors
    ids = df.select(key).withColumn("i", F.row_number().over(Window.orderBy(key)) - 1)
    return df.select(key, F.col(part).cast("string").alias("part"), A.as_double(x).alias("x"), A.as_double(y).alias("y")).join(
        F.broadcast(ids), key
    )


def kernel(rows: DataFrame, dim: int, block: int = FEATURE_BLOCK) -> DataFrame:
    """(i, k): rows of X X'.  Feature blocks are shuffled, multiplied and summed."""
    blocks = -(-dim // block)
    cut = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.slice(F.col("x"), b * block + 1, F.lit(block)))
    pieces = rows.select("i", F.posexplode(cut).alias("cb", "v"))

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        m = stack(pdf["v"])
        return pd.DataFrame({"i": pdf["i"].to_numpy(), "k": list(m @ m.T)})

    return pieces.groupBy("cb").applyInPandas(multiply, "i int, k array<double>").groupBy("i").agg(A.vector_sum("k").alias("k"))


def _centred(k: np.ndarray, fit: np.ndarray):
    """Training kernel centred on the training mean, and a function for other rows."""
    kf = k[np.ix_(fit, fit)]
    col, grand = kf.mean(axis=0), kf.mean()

    def other(idx):
        return k[np.ix_(idx, fit)] - k[np.ix_(idx, fit)].mean(axis=1, keepdims=True) - col[None, :] + grand

    return kf - col[None, :] - col[:, None] + grand, other


def _corrected(y: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    yc, pc = y - y.mean(0), p - p.mean(0)
    yy, pp = (yc * yc).sum(0), (pc * pc).sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (yc * pc).sum(0) / np.sqrt(yy * pp)
        sb = np.where(r == -1, np.nan, 2 * r / (1 + r))
        r2 = 1 - ((y - p) ** 2).sum(0) / yy
    flat = (yy / len(y) < 1e-8) | (pp / len(y) < 1e-8)
    same = np.all(np.isclose(y, p, rtol=1e-5, atol=1e-8), axis=0)
    return np.where(flat, np.where(same, 1.0, 0.0), sb) if len(y) > 1 else np.full(y.shape[1], np.nan), np.where(np.isfinite(r2), r2, np.nan)


def ridge_dual(
    df: DataFrame, key: str, part: str, x: str, y: str, plan: DataFrame, alphas: Sequence[float] = RIDGE_ALPHAS, shared: bool = False
) -> DataFrame:
    """Ridge with alpha by leave-one-out (per target or shared), scored on each run's test rows."""
    size = df.select(F.size(x).alias("d"), F.size(y).alias("t")).first()
    rows = cut_lineage(index_rows(df, key, part, x, y))
    k = cut_lineage(kernel(rows, size["d"]))
    alphas = list(alphas)
    blocks = -(-size["t"] // TARGET_BLOCK)
    roles: dict[str, dict[str, str]] = {}
    for r in plan.collect():
        roles.setdefault(r["run"], {})[r["part"]] = r["role"]
    every = F.explode(F.array(*[F.lit(r) for r in sorted(roles)]))
    tb = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    target = rows.select("i", "part", tb.alias("tblock"), "y").withColumn(
        "y", F.slice("y", F.col("tblock") * TARGET_BLOCK + 1, F.lit(TARGET_BLOCK))
    ).withColumn("run", every)
    side = k.withColumn("tblock", tb).withColumn("run", every)

    def prepared(run, tdf, kdf):
        tdf = tdf.sort_values("i")
        role = tdf["part"].map(roles[run]).to_numpy()
        full = stack(kdf.sort_values("i")["k"])
        return stack(tdf["y"]), full, np.flatnonzero((role == "fit") | (role == "val")), np.flatnonzero(role == "test")

    def search(key_, tdf, kdf):
        yv, full, fit, _ = prepared(key_[0], tdf, kdf)
        kc, _ = _centred(full, fit)
        lam, q = np.linalg.eigh(kc)
        lam, yc = np.maximum(lam, 0), yv[fit] - yv[fit].mean(0)
        z, out = q.T @ yc, []
        for pos, a in enumerate(alphas):
            shrink = lam / (lam + a)
            lever = (q * q) @ shrink + 1.0 / len(fit)
            e = (yc - q @ (z * shrink[:, None])) / (1 - lever)[:, None]
            out.append(pd.DataFrame({"run": key_[0], "target": key_[1] * TARGET_BLOCK + np.arange(yc.shape[1]), "pos": pos, "alpha": a, "score": -(e * e).mean(0)}))
        return pd.concat(out)

    def cogroup(left, fn, schema):
        right = side.toDF(*side.columns)
        return left.groupBy("run", "tblock").cogroup(right.groupBy("run", "tblock")).applyInPandas(fn, schema)

    grid = cogroup(target, search, "run string, target int, pos int, alpha double, score double")
    keys = ["run"] if shared else ["run", "target"]
    if shared:
        grid = grid.groupBy("run", "pos", "alpha").agg(F.avg("score").alias("score"))
    best = pick_best(grid, keys, "score", "pos").select(*keys, "alpha")
    if shared:
        best = best.withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(size["t"] - 1))))
    packed = best.withColumn("tblock", F.floor(F.col("target") / TARGET_BLOCK).cast("int")).groupBy("run", "tblock").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("target", "alpha"))), lambda s: s["alpha"]).alias("alphas")
    )
    chosen = target.join(packed, ["run", "tblock"])

    def refit(key_, tdf, kdf):
        per = np.asarray(tdf["alphas"].iloc[0], float)
        yv, full, fit, test = prepared(key_[0], tdf, kdf)
        kc, other = _centred(full, fit)
        lam, q = np.linalg.eigh(kc)
        mean = yv[fit].mean(0)
        c = q @ ((q.T @ (yv[fit] - mean)) / (np.maximum(lam, 0)[:, None] + per[None, :]))
        pearson, r2 = _corrected(yv[test], other(test) @ c + mean)
        return pd.DataFrame({"run": key_[0], "target": key_[1] * TARGET_BLOCK + np.arange(len(per)), "alpha": per, "pearson": pearson, "r2": r2, "n_test": len(test)})

    return nan_free(cogroup(chosen, refit, SCORES))
