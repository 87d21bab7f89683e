"""Unit-to-unit matching from the cross-correlation matrix."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.matrices import stack
from .gram import Moments, cross_correlation
from .linear import (
    GRID, WEIGHTS, evaluate, grid_rows, intercept, nan_free, read_blocks, role_moments, shared_choice, val_r2, weight_rows,
)

MAX_ASSIGNMENT = 4096  # units per side of one assignment problem (128 MB matrix)
TRANSPORT_REGS = (1e-4, 1e-3, 1e-2, 1e-1, 1.0, 1e1, 1e2, 1e3, 1e4)  # fixed values


def semi_match(m: Moments) -> DataFrame:
    """Half the mean best partner over source units plus half the same over target units, per part."""
    corr = cross_correlation(m)
    by_target = corr.groupBy("part").agg(F.avg(F.array_max("r")).alias("target_best"))
    best = corr.select("part", F.posexplode("r").alias("source", "r")).groupBy("part", "source").agg(F.max("r").alias("r"))
    by_source = best.groupBy("part").agg(F.avg("r").alias("source_best"))
    return by_source.join(by_target, "part").withColumn("score", (F.col("source_best") + F.col("target_best")) / 2)


def assign(score: np.ndarray) -> np.ndarray:
    """Column matched to each row in the assignment of maximal total score (rows <= columns).

    Shortest augmenting paths with dual prices; each path step is one vector operation.
    """
    cost = -np.asarray(score, float)
    rows, cols = cost.shape
    price_r, price_c = np.zeros(rows), np.zeros(cols)
    owner = np.full(cols, -1)
    for start in range(rows):
        dist = np.full(cols, np.inf)
        prev = np.full(cols, -1)
        done = np.zeros(cols, bool)
        row, reach, sink = start, 0.0, -1
        while sink < 0:
            slack = reach + cost[row] - price_r[row] - price_c
            better = ~done & (slack < dist)
            dist[better], prev[better] = slack[better], row
            j = int(np.argmin(np.where(done, np.inf, dist)))
            reach, done[j] = dist[j], True
            if owner[j] < 0:
                sink = j
            else:
                row = owner[j]
        settled = done.copy()
        settled[sink] = False
        price_r[start] += reach
        price_r[owner[settled]] += reach - dist[settled]
        price_c[settled] -= reach - dist[settled]
        j = sink
        while True:
            i = prev[j]
            nxt = np.flatnonzero(owner == i) if i != start else np.array([], int)
            owner[j] = i
            if i == start:
                break
            j = int(nxt[nxt != j][0])
    out = np.empty(rows, int)
    for j in np.flatnonzero(owner >= 0):
        out[owner[j]] = j
    return out


def one_to_one(m: Moments, rectangular: bool = False) -> DataFrame:
    """Mean correlation of the best one-to-one matching per part.

    By default the first min(d1, d2) units of each side compete; ``rectangular`` lets every unit.
    """
    d = min(m.dim_x, m.dim_y)
    if d > MAX_ASSIGNMENT:
        raise ValueError(f"{d} units per side exceed {MAX_ASSIGNMENT}; split them by region")
    corr = cross_correlation(m)
    if not rectangular:
        corr = corr.where(F.col("target") < d).withColumn("r", F.slice("r", 1, d))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.nan_to_num(stack(pdf.sort_values("target")["r"]).T, nan=-1.0)
        r = r if r.shape[0] <= r.shape[1] else r.T
        cols = assign(r)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "n_matched": [len(cols)], "score": [r[np.arange(len(cols)), cols].mean()]})

    return corr.groupBy("part").applyInPandas(match, "part string, n_matched long, score double")


# ---------------------------------------------------------------- soft matching


def transport(cost: np.ndarray, reg: float, max_iter: int = 2000, tol: float = 1e-9) -> np.ndarray:
    """Entropic transport plan with uniform margins, iterated in the log domain."""
    nx, ny = cost.shape
    la, lb = -np.log(nx), -np.log(ny)
    k = -cost / reg
    f, g = np.zeros(nx), np.zeros(ny)

    def lse(z, axis):
        top = z.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(z - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for it in range(max_iter):
        f = la - lse(k + g[None, :], 1)
        g = lb - lse(k + f[:, None], 0)
        if it % 10 == 9:
            rows = np.exp(lse(k + f[:, None] + g[None, :], 1))
            if np.abs(rows - 1.0 / nx).sum() < tol:
                break
    return np.exp(k + f[:, None] + g[None, :])


def soft_match(
    m: Moments, plan: DataFrame, regs: Sequence[float] = TRANSPORT_REGS, max_iter: int = 2000, raw_norms: bool = False
) -> DataFrame:
    """Soft matching: transport on correlation distance, regularisation chosen on the hold-out.

    The fitted predictor is linear (plan x correlation, rescaled by column norms), so hold-out and
    test scores come from the moments.  ``raw_norms`` takes the norms before centring.  The plan
    couples all units of one problem; its size is checked, and regions or layers are separate parts.
    """
    if m.dim_x * m.dim_y > 2**24:
        raise ValueError("transport problem too large for one task; match regions or layers separately")
    d, shift, regs = m.dim_x, m.shift, list(regs)

    def fit(f, reg):
        nx, ny = np.sqrt(np.diag(f.sxx)), np.sqrt(f.syy)
        with np.errstate(divide="ignore", invalid="ignore"):
            corr = f.sxy / np.outer(nx, ny)
        cost = np.clip(np.nan_to_num(1 - corr, nan=1.0), 0, 2)
        if raw_norms:
            nx = np.sqrt(np.diag(f.xx) + 2 * shift[:d] * f.sx + f.n * shift[:d] ** 2)
            ny = np.sqrt(f.yy + 2 * shift[d:] * f.sy + f.n * shift[d:] ** 2)
        p = transport(cost, reg, max_iter) * (1 - cost) * cost.shape[1]
        inv = np.divide(1.0, nx, out=np.zeros_like(nx), where=nx != 0)
        w = p * inv[:, None] * ny[None, :]
        return w, intercept(f, w)

    def search(run, ids, parts):
        out = []
        for pos, reg in enumerate(regs):
            w, b = fit(parts["fit"], reg)
            v = parts["val"]
            out.append(grid_rows(run, ids, pos, reg, val_r2(v, w, b), evaluate(v, w, b)[0]))
        return pd.concat(out)

    grid = _whole(m, plan, search, GRID, None)
    chosen = shared_choice(grid, "val_pearson").select("run", "alpha")

    def refit(run, ids, parts, reg):
        f = parts["fit"] + parts["val"]
        w, b = fit(f, reg)
        return weight_rows(run, ids, w, b, shift, reg, parts.get("test"))

    return nan_free(_whole(m, plan, refit, WEIGHTS, chosen))


def _whole(m: Moments, plan: DataFrame, kernel, schema: str, chosen: DataFrame | None) -> DataFrame:
    """One task per run with all targets (the size was checked by the caller)."""
    rm, d = role_moments(m, plan), m.dim_x
    picked = chosen is not None
    if picked:
        rm = rm.join(chosen, "run")

    def run_all(key, pdf):
        x = pdf[pdf["g"] < d]
        y = pdf[pdf["g"] >= d].assign(target=lambda t: t["g"] - d)
        ids, parts = read_blocks(y, x)
        if "val" in parts:
            parts["val"].centre = parts["fit"].my
        args = (str(key[0]), ids, parts) + ((float(pdf["alpha"].iloc[0]),) if picked else ())
        return kernel(*args)

    return rm.groupBy("run").applyInPandas(run_all, schema)
