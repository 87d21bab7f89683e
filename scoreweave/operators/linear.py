"""Linear maps fitted on moments.

The data is scanned once (``gram.moments``).  A *design* says which parts of the data play which
role (fit, val, test) in which run; joining it to the moment table gives every run's training and
test sums without touching the rows again.  Each (run, block of targets) is then solved in its own
task, and test scores follow from the test moments: for weights w, the prediction variance is
w'Sw and its covariance with the target is w's.  Only the leave-one-out search and explicit
predictions need the rows a second time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.columns import CLOSE_ATOL, CLOSE_RTOL, VARIANCE_FLOOR
from ..functions.joins import checked_broadcast
from ..functions.matrices import list_column, list_matrix, stack
from .gram import Moments
from .windows import pick_best

TARGET_BLOCK = 256
MODEL_BYTES = 256 * 2**20  # largest model sent to all tasks at once; larger ones go in target blocks

# Hyper-parameter grids.
RIDGE_ALPHAS = tuple(10.0**e for e in range(-10, 11))
GROUP_ALPHAS = (1e-6, 1e-4, 1e-2, 1.0, 10.0, 100.0, 1e4, 1e6)
SIMILARITY_ALPHAS = (0.1, 1.0, 10.0)
PLS_COMPONENTS = (5, 10, 15, 20, 25, 30, 35, 40, 45, 50)

WEIGHTS = "run string, target int, alpha double, w array<double>, b double, pearson double, r2 double, n_test long"
GRID = "run string, target int, pos int, alpha double, val_r2 double, val_pearson double"


# ---------------------------------------------------------------- designs


def design(spark: SparkSession, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(run, role, part) rows: the roles each part of the data plays."""
    return spark.createDataFrame([tuple(map(str, r)) for r in rows], "run string, role string, part string")


def cv_design(spark: SparkSession, k: int, holdout: bool = False) -> DataFrame:
    """k runs; run f tests on part f and fits on the others.  With ``holdout`` every fold has two
    parts, ``f`` and ``fv``, and the training share of ``fv`` selects hyper-parameters."""
    rows = []
    for f in range(k):
        for g in range(k):
            for suffix in ("", "v") if holdout else ("",):
                role = "test" if f == g else ("val" if suffix else "fit")
                rows.append((f, role, f"{g}{suffix}"))
    return design(spark, rows)


def holdout_design(spark: SparkSession) -> DataFrame:
    return design(spark, [("0", "fit", "fit"), ("0", "val", "val"), ("0", "test", "test")])


def train_test_design(spark: SparkSession) -> DataFrame:
    return design(spark, [("0", "fit", "train"), ("0", "test", "test")])


def role_moments(m: Moments, plan: DataFrame) -> DataFrame:
    """Moments per (run, role, column).  The moment table is small; the plan is a list of labels."""
    return (
        m.df.join(F.broadcast(plan), "part")
        .groupBy("run", "role", "g")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), A.vector_sum("xr").alias("xr"))
    )


# ---------------------------------------------------------------- numpy view of one block


@dataclass
class Block:
    """Sums of one role for all features and a block of targets, in shifted coordinates."""

    n: float
    sx: np.ndarray
    xx: np.ndarray
    sy: np.ndarray
    yy: np.ndarray
    xy: np.ndarray  # features x targets

    def __add__(self, o: "Block") -> "Block":
        return Block(self.n + o.n, self.sx + o.sx, self.xx + o.xx, self.sy + o.sy, self.yy + o.yy, self.xy + o.xy)

    def pick(self, features: np.ndarray) -> "Block":
        return Block(self.n, self.sx[features], self.xx[np.ix_(features, features)], self.sy, self.yy, self.xy[features])

    @property
    def mx(self):
        return self.sx / self.n

    @property
    def my(self):
        return self.sy / self.n

    @property
    def sxx(self):
        return self.xx - np.outer(self.sx, self.sx) / self.n

    @property
    def sxy(self):
        return self.xy - np.outer(self.sx, self.sy) / self.n

    @property
    def syy(self):
        return np.maximum(self.yy - self.sy**2 / self.n, 0.0)


def read_blocks(targets: pd.DataFrame, features: pd.DataFrame) -> tuple[np.ndarray, dict[str, Block]]:
    ids = np.sort(targets["target"].unique())
    out = {}
    for role, fx in features.groupby("role"):
        fx = fx.sort_values("g")
        ty = targets[targets["role"] == role].sort_values("target")
        out[role] = Block(
            float(fx["n"].iloc[0]), fx["s"].to_numpy(), stack(fx["xr"]), ty["s"].to_numpy(), ty["ss"].to_numpy(),
            stack(ty["xr"]).T,
        )
    return ids, out


def evaluate(t: Block, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corrected correlation and R2 of predictions x w + b on a block's rows, from its sums."""
    pp = np.maximum(np.einsum("dt,dt->t", w, t.sxx @ w), 0.0)
    return scores_from(t.n, t.my, t.mx @ w + b, pp, np.einsum("dt,dt->t", w, t.sxy), t.syy)


def scores_from(n: float, my: np.ndarray, mp: np.ndarray, pp: np.ndarray, cov: np.ndarray, yy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corrected correlation and R2 from the means of targets and predictions and their centred sums of products."""
    res = n * (my - mp) ** 2 + yy - 2 * cov + pp
    with np.errstate(divide="ignore", invalid="ignore"):
        r = cov / np.sqrt(pp * yy)
        sb = np.where(r == -1, np.nan, 2 * r / (1 + r))
        r2 = 1 - res / yy
    flat = (yy / n < VARIANCE_FLOOR) | (pp / n < VARIANCE_FLOOR)
    match = np.sqrt(np.maximum(res, 0) / n) <= CLOSE_ATOL + CLOSE_RTOL * np.abs(mp)
    pearson = np.where(flat, np.where(match, 1.0, 0.0), sb)
    if n < 2:
        pearson = np.full_like(pearson, np.nan)
    return pearson, np.where(np.isfinite(r2), r2, np.nan)


def val_r2(v: Block, w: np.ndarray, b: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    """Hold-out R2 around the training mean, with the denominator guard of the search.

    ``b`` is the fitted intercept, so residuals and totals share the training centre.
    """
    centre = getattr(v, "centre", v.my)
    tot = v.yy - 2 * centre * v.sy + v.n * centre**2
    mp = v.mx @ w + b
    pp = np.einsum("dt,dt->t", w, v.sxx @ w)
    cov = np.einsum("dt,dt->t", w, v.sxy)
    res = v.n * (v.my - mp) ** 2 + v.syy - 2 * cov + pp
    return 1 - res / (tot + eps)


def ridge_path(f: Block, alphas: Sequence[float]):
    """Weights for every alpha from one eigendecomposition."""
    lam, vec = np.linalg.eigh(f.sxx)
    lam = np.maximum(lam, 0.0)
    z = vec.T @ f.sxy
    for a in alphas:
        yield vec @ (z / (lam + a)[:, None])


def intercept(f: Block, w: np.ndarray) -> np.ndarray:
    return f.my - f.mx @ w


# ---------------------------------------------------------------- running a kernel


def solve(m: Moments, plan: DataFrame, kernel: Callable, schema: str, extra: DataFrame | None = None, hint: bool = True) -> DataFrame:
    """Apply ``kernel(run, target_ids, blocks, shift, targets_frame) -> DataFrame`` to every block.

    One task per (run, block of targets): it receives the run's feature sums (D x D, bounded by
    ``gram.MAX_DIM``) and its own targets' rows, so the number of targets is not limited.
    """
    d, shift = m.dim_x, m.shift
    rm = role_moments(m, plan)
    blocks = max(1, -(-m.dim_y // TARGET_BLOCK))
    y = rm.where(F.col("g") >= d).withColumn("target", (F.col("g") - d).cast("int")).drop("g")
    if extra is not None:
        y = y.join(checked_broadcast(extra) if hint else extra, [c for c in ("run", "target") if c in extra.columns], "left")
    y = y.withColumn("tblock", F.floor(F.col("target") / TARGET_BLOCK).cast("int"))
    x = rm.where(F.col("g") < d).withColumn("tblock", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    x = x.toDF(*x.columns)  # fresh column identities: both sides come from the same table

    def run_block(key, targets: pd.DataFrame, features: pd.DataFrame) -> pd.DataFrame:
        ids, parts = read_blocks(targets, features)
        if "val" in parts and "fit" in parts:
            parts["val"].centre = parts["fit"].my
        return kernel(str(key[0]), ids, parts, shift, targets)

    return y.groupBy("run", "tblock").cogroup(x.groupBy("run", "tblock")).applyInPandas(run_block, schema)


def weight_rows(run, ids, w, b, shift, alpha, test: Block | None) -> pd.DataFrame:
    """Result rows with the intercept moved back to unshifted coordinates."""
    d = w.shape[0]
    pearson, r2 = evaluate(test, w, b) if test is not None else (np.full(len(ids), np.nan),) * 2
    return pd.DataFrame(
        {
            "run": run, "target": ids.astype(np.int32), "alpha": np.broadcast_to(np.asarray(alpha, float), len(ids)),
            "w": list(w.T), "b": b + shift[d + ids] - shift[:d] @ w, "pearson": pearson, "r2": r2,
            "n_test": int(test.n) if test is not None else 0,
        }
    )


def grid_rows(run, ids, pos, alpha, r2, pearson) -> pd.DataFrame:
    return pd.DataFrame(
        {"run": run, "target": ids.astype(np.int32), "pos": pos, "alpha": float(alpha), "val_r2": r2, "val_pearson": pearson}
    )


def nan_free(scores: DataFrame) -> DataFrame:
    """NaN marks an undefined score inside tasks; it leaves as NULL."""
    return scores.withColumn("pearson", F.when(~F.isnan("pearson"), F.col("pearson"))).withColumn(
        "r2", F.when(~F.isnan("r2"), F.col("r2"))
    )


# ---------------------------------------------------------------- ridge family


def ridge(m: Moments, plan: DataFrame, alpha: float | DataFrame) -> DataFrame:
    """Ridge with an unpenalised intercept; ``alpha`` is a number or (run[, target], alpha) rows.

    The validation share, if the design has one, is part of the final fit.
    """
    fixed = None if isinstance(alpha, DataFrame) else float(alpha)
    extra = alpha.select(*[c for c in ("run", "target", "alpha") if c in alpha.columns]) if fixed is None else None

    def kernel(run, ids, parts, shift, targets):
        f = parts["fit"] + parts["val"] if "val" in parts else parts["fit"]
        if fixed is not None:
            per = np.full(len(ids), fixed)
        else:
            per = targets.drop_duplicates("target").sort_values("target")["alpha"].to_numpy()
        lam, vec = np.linalg.eigh(f.sxx)
        lam = np.maximum(lam, 0.0)
        w = vec @ ((vec.T @ f.sxy) / (lam[:, None] + per[None, :]))
        return weight_rows(run, ids, w, intercept(f, w), shift, per, parts.get("test"))

    return nan_free(solve(m, plan, kernel, WEIGHTS, extra))


def shared_choice(grid: DataFrame, score: str = "val_r2") -> DataFrame:
    """One alpha per run: best mean score over targets, first on ties."""
    mean = grid.groupBy("run", "pos", "alpha").agg(F.avg(score).alias("score"))
    return pick_best(mean, ["run"], "score", "pos").select("run", "alpha", "pos", "score")


def holdout_grid(m: Moments, plan: DataFrame, alphas: Sequence[float] = RIDGE_ALPHAS) -> DataFrame:
    """Hold-out score of every (run, target, alpha): the grid as rows."""
    alphas = list(alphas)

    def kernel(run, ids, parts, shift, targets):
        f, v = parts["fit"], parts["val"]
        out = []
        for pos, (a, w) in enumerate(zip(alphas, ridge_path(f, alphas))):
            b = intercept(f, w)
            out.append(grid_rows(run, ids, pos, a, val_r2(v, w, b), evaluate(v, w, b)[0]))
        return pd.concat(out)

    return solve(m, plan, kernel, GRID)


def ridge_holdout(m: Moments, plan: DataFrame, alphas: Sequence[float] = RIDGE_ALPHAS) -> DataFrame:
    """Ridge with one alpha per run chosen on the hold-out share, refitted on everything."""
    return ridge(m, plan, shared_choice(holdout_grid(m, plan, alphas)).select("run", "alpha"))


def loo_errors(df: DataFrame, part: str, x: str, y: str, m: Moments, plan: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """Leave-one-out squared error per (run, target) as an array over alphas.

    Second scan of the rows.  With z the row in the eigenbasis of the run's fit rows, the leverage is
    h = sum z^2 / (lambda + alpha) + 1/n and the left-out residual is e / (1 - h).  Tasks emit only
    sums per (run, target, alpha).  The model sent to tasks is checked against ``MODEL_BYTES`` and
    split by runs and target blocks when larger.
    """
    spark = df.sparkSession
    d, t, shift = m.dim_x, m.dim_y, m.shift
    alpha = np.asarray(list(alphas), float)
    fit_parts: dict[str, set] = {}
    for r in plan.where(F.col("role").isin("fit", "val")).collect():
        fit_parts.setdefault(r["run"], set()).add(r["part"])
    per_run = d * d * 8
    run_group = max(1, MODEL_BYTES // (2 * per_run))
    target_group = int(max(1, min(t, MODEL_BYTES // (2 * d * 8 * min(run_group, len(fit_parts))))))

    def kernel(run, ids, parts, shift_, targets):
        f = parts["fit"] + parts["val"] if "val" in parts else parts["fit"]
        lam, vec = np.linalg.eigh(f.sxx)
        lam = np.maximum(lam, 0.0)
        z = (vec.T @ f.sxy).T
        rows = [("z", int(i), z[k], f.my[k]) for k, i in enumerate(ids)]
        if ids[0] == 0:
            rows += [("v", i, vec[i], lam[i]) for i in range(d)] + [("m", 0, f.mx, f.n)]
        return pd.DataFrame([(run, *r) for r in rows], columns=["run", "kind", "idx", "vec", "num"])

    # Everything the row scan needs about a run: eigenvectors, eigenvalues, projected targets, means.
    models = solve(m, plan, kernel, "run string, kind string, idx int, vec array<double>, num double").persist()
    out = None
    runs = sorted(fit_parts)
    for r0 in range(0, len(runs), run_group):
        chosen = runs[r0 : r0 + run_group]
        for t0 in range(0, t, target_group):
            t1 = min(t, t0 + target_group)
            rows = models.where(
                F.col("run").isin(chosen) & ((F.col("kind") != "z") | F.col("idx").between(t0, t1 - 1))
            ).toPandas()
            model = {}
            for run in chosen:
                g = rows[rows["run"] == run]
                v = g[g["kind"] == "v"].sort_values("idx")
                z = g[g["kind"] == "z"].sort_values("idx")
                mean = g[g["kind"] == "m"].iloc[0]
                model[run] = (
                    fit_parts[run], stack(v["vec"]), v["num"].to_numpy(), stack(z["vec"]).T, z["num"].to_numpy(),
                    np.asarray(mean["vec"]), float(mean["num"]),
                )
            shared = spark.sparkContext.broadcast(model)
            part_df = df.select(
                F.col(part).cast("string").alias("part"), A.as_double(x).alias("x"),
                F.slice(A.as_double(y), t0 + 1, t1 - t0).alias("y"),
            ).mapInArrow(_loo_scan(shared, alpha, shift[:d], shift[d + t0 : d + t1], t0), "run string, target int, n long, err array<double>")
            out = part_df if out is None else out.unionByName(part_df)
    models.unpersist()
    return out.groupBy("run", "target").agg(F.sum("n").alias("n"), A.vector_sum("err").alias("err"))


def _loo_scan(shared, alpha, shift_x, shift_y, t0):
    def run_batches(batches):
        held = {}
        for b in batches:
            if b.num_rows == 0:
                continue
            part = b.column(0).to_numpy(zero_copy_only=False)
            x = list_matrix(b.column(1)) - shift_x
            y = list_matrix(b.column(2)) - shift_y
            for run, (own, vec, lam, z, my, mx, n) in shared.value.items():
                mask = np.isin(part, list(own))
                if not mask.any():
                    continue
                u = (x[mask] - mx) @ vec
                resid0 = y[mask] - my
                acc = held.setdefault(run, [0, np.zeros((resid0.shape[1], alpha.size))])
                acc[0] += int(mask.sum())
                for k, a in enumerate(alpha):
                    inv = 1.0 / (lam + a)
                    lever = (u * u) @ inv + 1.0 / n
                    e = (resid0 - u @ (z * inv[:, None])) / (1.0 - lever)[:, None]
                    acc[1][:, k] += (e * e).sum(axis=0)
        for run, (n, err) in held.items():
            w = err.shape[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([run] * w), pa.array(t0 + np.arange(w, dtype=np.int32)), pa.array(np.full(w, n)), list_column(err)],
                names=["run", "target", "n", "err"],
            )

    return run_batches


def loo_choice(errors: DataFrame, alphas: Sequence[float], shared: bool) -> DataFrame:
    """The alpha with the lowest leave-one-out error, per target or (mean over targets) per run."""
    table = F.array(*[F.lit(float(a)) for a in alphas])
    long = errors.select(
        "run", "target", F.posexplode(F.transform("err", lambda e: -e / F.col("n"))).alias("pos", "score")
    )
    keys = ["run"] if shared else ["run", "target"]
    if shared:
        long = long.groupBy("run", "pos").agg(F.avg("score").alias("score"))
    best = pick_best(long, keys, "score", "pos")
    return best.withColumn("alpha", F.element_at(table, F.col("pos") + 1)).select(*keys, "alpha")


def ridge_loo(
    df: DataFrame, part: str, x: str, y: str, m: Moments, plan: DataFrame, alphas: Sequence[float] = RIDGE_ALPHAS, shared: bool = False
) -> DataFrame:
    """Ridge with alpha by leave-one-out, per target or shared."""
    return ridge(m, plan, loo_choice(loo_errors(df, part, x, y, m, plan, alphas), alphas, shared))


# ---------------------------------------------------------------- sparse, constrained and block maps


def sparse_gap(f: Block, w: np.ndarray, alpha: float, l1_ratio: float) -> np.ndarray:
    """How far (1/2n)|y - xw|^2 + alpha (l1 |w|_1 + (1 - l1)/2 |w|^2) is from its least value at most, per target: the duality gap."""
    lam1, lam2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    xw, ww = f.sxx @ w, (w * w).sum(0)
    left = np.maximum(f.syy - 2 * (w * f.sxy).sum(0) + (w * xw).sum(0), 0.0) + f.n * lam2 * ww  # |residual|^2, the squared penalty as extra rows
    steep = np.abs(f.sxy - xw - f.n * lam2 * w).max(axis=0, initial=0.0)
    s = np.minimum(1.0, f.n * lam1 / np.maximum(steep, 1e-300))
    primal = left / 2 + f.n * lam1 * np.abs(w).sum(0)
    return (primal - s * (f.syy - (w * f.sxy).sum(0)) + s * s * left / 2) / f.n


def sparse_fit(f: Block, alpha: float, l1_ratio: float, start: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """Accelerated proximal gradient; every target goes on until its own duality gap is below ``tol`` of its variance.

    Momentum restarts per target, so targets do not influence one another.  A target also stops when a thousand steps have not
    lowered its gap: it is as exact as doubles allow.
    """
    lam1, lam2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    sxx, sxy = f.sxx, f.sxy
    step = 1.0 / (np.linalg.eigvalsh(sxx)[-1] / f.n + lam2 + 1e-30)
    w = start.copy()
    limit = tol * f.syy / (2 * f.n)
    gap = sparse_gap(f, w, alpha, l1_ratio)
    live = np.flatnonzero(gap > limit)
    look, t, best, since = w[:, live], np.ones(len(live)), gap[live], 0
    while len(live):
        z = look - step * ((sxx @ look - sxy[:, live]) / f.n + lam2 * look)
        new = np.sign(z) * np.maximum(np.abs(z) - lam1 * step, 0.0)
        back = ((look - new) * (new - w[:, live])).sum(0) > 0
        t_next = np.where(back, 1.0, (1 + np.sqrt(1 + 4 * t * t)) / 2)
        look = new + np.where(back, 0.0, (t - 1) / t_next) * (new - w[:, live])
        w[:, live], t, since = new, t_next, since + 1
        if since % 10:
            continue
        part = Block(f.n, f.sx, f.xx, f.sy[live], f.yy[live], f.xy[:, live])
        gap = sparse_gap(part, new, alpha, l1_ratio)
        go = gap > limit[live]
        if since % 1000 == 0:
            go &= gap < best
            best = np.minimum(best, gap)
        live, look, t, best = live[go], look[:, go], t[go], best[go]
    return w


def elastic_net(m: Moments, plan: DataFrame, alphas: Sequence[float], l1_ratio: float = 1.0, tol: float = 1e-12) -> DataFrame:
    """Lasso (l1_ratio 1) or elastic net: descending alphas with warm starts on the hold-out, shared
    choice, refit on everything, then each target's weights rescaled to undo the shrinkage."""
    desc = sorted(alphas, reverse=True)

    def search(run, ids, parts, shift, targets):
        f, v, out = parts["fit"], parts["val"], []
        w = np.zeros_like(f.xy)
        for pos, a in enumerate(desc):
            w = sparse_fit(f, a, l1_ratio, w, tol)
            b = intercept(f, w)
            out.append(grid_rows(run, ids, pos, a, val_r2(v, w, b), evaluate(v, w, b)[0]))
        return pd.concat(out)

    chosen = shared_choice(solve(m, plan, search, GRID)).select("run", "alpha")

    def refit(run, ids, parts, shift, targets):
        f = parts["fit"] + parts["val"]
        a = float(targets["alpha"].iloc[0])
        sxx, sxy = f.sxx, f.sxy
        w = np.zeros_like(sxy)
        for step in [s for s in desc if s >= a]:
            w = sparse_fit(f, step, l1_ratio, w, tol)
        w = w * ((w * sxy).sum(axis=0) / ((w * (sxx @ w)).sum(axis=0) + 1e-10))
        return weight_rows(run, ids, w, intercept(f, w), shift, a, parts.get("test"))

    return nan_free(solve(m, plan, refit, WEIGHTS, chosen))


def _masked_ridge(m: Moments, plan: DataFrame, alphas: Sequence[float], allowed: Callable[[int], np.ndarray], group: Callable[[int], str]):
    """Ridge in which each target may use only some features; alpha per run and target group.

    Targets with the same allowed set share one solve.
    """
    alphas = list(alphas)

    def groups(ids):
        out: dict[bytes, list[int]] = {}
        for k, i in enumerate(ids):
            out.setdefault(allowed(int(i)).tobytes(), []).append(k)
        return [(allowed(int(ids[ks[0]])), np.array(ks)) for ks in out.values()]

    def cut(b: Block, feats, ks):
        s = b.pick(feats)
        return Block(s.n, s.sx, s.xx, s.sy[ks], s.yy[ks], s.xy[:, ks])

    def search(run, ids, parts, shift, targets):
        out = []
        for feats, ks in groups(ids):
            f, v = cut(parts["fit"], feats, ks), cut(parts["val"], feats, ks)
            v.centre = f.my
            for pos, (a, w) in enumerate(zip(alphas, ridge_path(f, alphas))):
                b = intercept(f, w)
                out.append(grid_rows(run, ids[ks], pos, a, val_r2(v, w, b), evaluate(v, w, b)[0]))
        return pd.concat(out)

    labels = m.df.sparkSession.createDataFrame([(i, group(i)) for i in range(m.dim_y)], "target int, grp string")
    grid = solve(m, plan, search, GRID).join(labels, "target")
    mean = grid.groupBy("run", "grp", "pos", "alpha").agg(F.avg("val_r2").alias("score"))
    best = pick_best(mean, ["run", "grp"], "score", "pos").select("run", "grp", "alpha")
    chosen = best.join(labels, "grp").select("run", "target", "alpha")

    def refit(run, ids, parts, shift, targets):
        per = targets.drop_duplicates("target").sort_values("target")["alpha"].to_numpy()
        full = parts["fit"] + parts["val"]
        w = np.zeros_like(full.xy)
        for feats, ks in groups(ids):
            f = cut(full, feats, ks)
            lam, vec = np.linalg.eigh(f.sxx)
            w[np.ix_(feats, ks)] = vec @ ((vec.T @ f.sxy) / (np.maximum(lam, 0.0)[:, None] + per[ks][None, :]))
        return weight_rows(run, ids, w, intercept(full, w), shift, per, parts.get("test"))

    return nan_free(solve(m, plan, refit, WEIGHTS, chosen))


def constrained_ridge(m: Moments, plan: DataFrame, alphas: Sequence[float] = RIDGE_ALPHAS, block_size: int = 1024) -> DataFrame:
    """Ridge with ``W[b * block_size + i, i] = 0`` for every block b; one shared alpha."""
    if m.dim_y != block_size or m.dim_x % block_size:
        raise ValueError("targets must number block_size and features a multiple of it")
    feats = np.arange(m.dim_x)
    return _masked_ridge(m, plan, alphas, lambda i: feats[feats % block_size != i], lambda i: "all")


def block_ridge(
    m: Moments, plan: DataFrame, regions: dict[str, tuple[int, int]], period: int, mode: str = "exclusion",
    alphas: Sequence[float] = RIDGE_ALPHAS,
) -> DataFrame:
    """Targets of a region use only (selection) or all but (exclusion) that region's features."""
    if mode not in ("exclusion", "selection"):
        raise ValueError("block_mode must be 'exclusion' or 'selection'.")
    feats = np.arange(m.dim_x)

    def region_of(i: int) -> str:
        return next((n for n, (a, b) in regions.items() if a <= i % period < b), "none")

    def allowed(i: int) -> np.ndarray:
        name = region_of(i)
        if name == "none":
            return feats
        a, b = regions[name]
        inside = (feats % period >= a) & (feats % period < b)
        keep = feats[~inside] if mode == "exclusion" else feats[inside]
        if keep.size == 0:
            raise ValueError(f"No features selected for region {name} under mode={mode}.")
        return keep

    return _masked_ridge(m, plan, alphas, allowed, region_of)


# ---------------------------------------------------------------- partial least squares


def pls_directions(sxx: np.ndarray, k: np.ndarray, comps: int):
    """Rotations and score norms of up to ``comps`` components from X'X and X'YY'X alone.

    Deflating X'Y by a component turns K = X'YY'X into (I - p r') K (I - r p'), so the search for
    directions never needs the individual targets.
    """
    d = sxx.shape[0]
    rot, load, norm = [], [], []
    k = k.copy()
    for _ in range(min(comps, d)):
        lam, vec = np.linalg.eigh((k + k.T) / 2)
        if lam[-1] <= 1e-14 * max(1.0, np.trace(sxx)):
            break
        r = vec[:, -1].copy()
        for rr, p in zip(rot, load):
            r -= rr * (p @ vec[:, -1])
        tt = r @ sxx @ r
        if tt <= 1e-14:
            break
        p = sxx @ r / tt
        rot.append(r), load.append(p), norm.append(tt)
        left = k - np.outer(p, r @ k)
        k = left - np.outer(left @ r, p)
    return np.array(rot).T, np.array(norm)


def pls(m: Moments, plan: DataFrame, components: Sequence[int] = PLS_COMPONENTS) -> DataFrame:
    """PLS regression with the component count chosen on the hold-out by mean corrected r.

    Three small steps on the moment table: (1) K = sum over targets of s s' per run, a vector sum
    over target rows; (2) directions per run; (3) weights per target, spread over target blocks.
    """
    comps = sorted({min(c, m.dim_x) for c in components})
    first = _pls_stage(m, plan, ("fit",), comps, None)
    grid = first.groupBy("run", "pos", "alpha").agg(F.avg("val_pearson").alias("score"))
    best = pick_best(grid, ["run"], "score", "pos").select("run", "alpha")
    return nan_free(_pls_stage(m, plan, ("fit", "val"), comps, best))


def _pls_stage(m: Moments, plan: DataFrame, fit_roles, comps, best):
    d = m.dim_x
    refit = best is not None

    def join_fit(parts):
        f = parts["fit"]
        return f + parts["val"] if refit and "val" in parts else f

    def scaled(f: Block):
        sdx = np.sqrt(np.diag(f.sxx) / (f.n - 1))
        sdy = np.sqrt(f.syy / (f.n - 1))
        sdx[sdx == 0], sdy[sdy == 0] = 1.0, 1.0
        return sdx, sdy, f.sxx / np.outer(sdx, sdx), f.sxy / np.outer(sdx, sdy)

    def cross(run, ids, parts, shift, targets):
        _, _, sxx, sxy = scaled(join_fit(parts))
        k = sxy @ sxy.T
        rows = [(run, "k", i, k[i]) for i in range(d)]
        if ids[0] == 0:
            rows += [(run, "x", i, sxx[i]) for i in range(d)]
        return pd.DataFrame(rows, columns=["run", "kind", "idx", "vec"])

    sums = solve(m, plan, cross, "run string, kind string, idx int, vec array<double>").groupBy("run", "kind", "idx").agg(
        A.vector_sum("vec").alias("vec")
    )

    def directions(key, pdf):
        k = stack(pdf[pdf["kind"] == "k"].sort_values("idx")["vec"])
        sxx = stack(pdf[pdf["kind"] == "x"].sort_values("idx")["vec"])
        rot, norm = pls_directions(sxx, k, max(comps))
        return pd.DataFrame({"run": [key[0]], "rot": [rot.ravel()], "norm": [norm]})

    dirs = sums.groupBy("run").applyInPandas(directions, "run string, rot array<double>, norm array<double>")
    # one row per run, D x components: carried only by the first target row of each block
    extra = dirs if best is None else dirs.join(best, "run")
    extra = extra.withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(m.dim_y - 1), F.lit(TARGET_BLOCK))))

    def weights(run, ids, parts, shift, targets):
        f = join_fit(parts)
        sdx, sdy, _, sxy = scaled(f)
        row = targets[targets["target"] == ids[0]].iloc[0]
        norm = np.asarray(row["norm"], float)
        rot = np.asarray(row["rot"], float).reshape(d, norm.size)
        out = []
        for pos, c in enumerate(comps):
            if refit and c != int(row["alpha"]):
                continue
            r = rot[:, :c]
            w = (r @ ((r.T @ sxy) / norm[:c, None])) * sdy[None, :] / sdx[:, None]
            b = intercept(f, w)
            if refit:
                return weight_rows(run, ids, w, b, shift, c, parts.get("test"))
            v = parts["val"]
            out.append(grid_rows(run, ids, pos, c, val_r2(v, w, b), evaluate(v, w, b)[0]))
        return pd.concat(out)

    return solve(m, plan, weights, WEIGHTS if refit else GRID, extra, hint=False)


# ---------------------------------------------------------------- loss-trained linear map


def loss_value(kind: str, weight: float, f: Block, w: np.ndarray, b: float, j: int, sxx, sxy, syy):
    """Loss and gradient of one target's (w, b) from the sums; see ``scoring.regression_losses``."""
    n = f.n
    sw = sxx @ w
    pp, cov = max(w @ sw, 0.0), w @ sxy
    gap = f.mx @ w + b - f.my[j]
    mse = (pp - 2 * cov + syy) / n + gap**2
    g_mse_w, g_mse_b = 2 * (sw - sxy) / n + 2 * gap * f.mx, 2 * gap
    if kind == "mse":
        return mse, g_mse_w, g_mse_b
    if kind in ("correlation", "combined"):
        norms = max(np.sqrt(pp * syy), 1e-6)
        corr = cov / norms
        g = -(sxy / norms - (cov * sw / (pp * norms) if np.sqrt(pp * syy) > 1e-6 else 0.0))
        if kind == "correlation":
            return -corr, g, 0.0
        return (1 - weight) * mse - weight * corr, (1 - weight) * g_mse_w + weight * g, (1 - weight) * g_mse_b
    den = (pp + syy) / (n - 1) + gap**2 + 1e-8
    ccc = 2 * cov / n / den
    g_den_w, g_den_b = 2 * sw / (n - 1) + 2 * gap * f.mx, 2 * gap
    g_w, g_b = -(2 * sxy / n / den - ccc * g_den_w / den), ccc * g_den_b / den
    if kind == "ccc":
        return 1 - ccc, g_w, g_b
    if kind == "ccc_mse":
        return (1 - weight) * mse + weight * (1 - ccc), (1 - weight) * g_mse_w + weight * g_w, (1 - weight) * g_mse_b + weight * g_b
    raise ValueError(f"Invalid loss_type: {kind}")


def minimise(fun, z: np.ndarray, iters: int = 300, tol: float = 1e-9, memory: int = 10) -> np.ndarray:
    """Limited-memory quasi-Newton descent with backtracking."""
    val, g = fun(z)
    s_list, y_list = [], []
    for _ in range(iters):
        q, alphas = g.copy(), []
        for s, y in reversed(list(zip(s_list, y_list))):
            a = (s @ q) / (y @ s)
            alphas.append(a)
            q -= a * y
        if s_list:
            q *= (s_list[-1] @ y_list[-1]) / (y_list[-1] @ y_list[-1])
        for (s, y), a in zip(zip(s_list, y_list), reversed(alphas)):
            q += s * (a - (y @ q) / (y @ s))
        step, slope = 1.0, -(g @ q)
        if slope >= 0:
            q, slope, s_list, y_list = g.copy(), -(g @ g), [], []
        while step > 1e-12:
            trial = z - step * q
            new_val, new_g = fun(trial)
            if new_val <= val + 1e-4 * step * slope:
                break
            step *= 0.5
        else:
            break
        s, y = trial - z, new_g - g
        if s @ y > 1e-14:
            s_list, y_list = (s_list + [s])[-memory:], (y_list + [y])[-memory:]
        done = abs(val - new_val) <= tol * max(1.0, abs(val))
        z, val, g = trial, new_val, new_g
        if done:
            break
    return z


def loss_regressor(
    m: Moments, plan: DataFrame, loss: str = "mse", weight: float = 0.5, l2_grid: Sequence[float] = (0.0, 0.1, 0.2)
) -> DataFrame:
    """Linear map trained on one of five losses plus ``l2 * (|w|^2 + b^2)``, l2 chosen on the hold-out.

    Every loss depends on the data only through the sums, so training needs no further scan.
    Features are standardised first; the returned weights are in original units.
    """
    grid = list(l2_grid)
    total = m.dim_y

    def train(f: Block, l2: float):
        sd = np.sqrt(np.maximum(np.diag(f.sxx) / (f.n - 1), 1e-24))
        sxx, sxy, syy = f.sxx / np.outer(sd, sd), f.sxy / sd[:, None], f.syy
        unit = Block(f.n, np.zeros_like(f.sx), sxx, f.sy, f.yy, sxy)
        warm = np.linalg.solve(sxx + (f.n * max(l2 * total, 1e-3)) * np.eye(sxx.shape[0]), sxy)
        ws, bs = [], []
        for j in range(sxy.shape[1]):

            def fun(z, j=j):
                v, gw, gb = loss_value(loss, weight, unit, z[:-1], z[-1], j, sxx, sxy[:, j], syy[j])
                return v / total + l2 * (z @ z), np.append(gw, gb) / total + 2 * l2 * z

            z = minimise(fun, np.append(warm[:, j], f.my[j]))
            ws.append(z[:-1] / sd), bs.append(z[-1])
        w = np.array(ws).T
        return w, np.array(bs) - f.mx @ w

    def search(run, ids, parts, shift, targets):
        out = []
        for pos, l2 in enumerate(grid):
            w, b = train(parts["fit"], l2)
            out.append(grid_rows(run, ids, pos, l2, val_r2(parts["val"], w, b), evaluate(parts["val"], w, b)[0]))
        return pd.concat(out)

    found = solve(m, plan, search, GRID)
    scored = found.withColumn("val_pearson", F.when(~F.isnan("val_pearson"), F.col("val_pearson")))
    chosen = shared_choice(scored, "val_pearson").select("run", "alpha")

    def refit(run, ids, parts, shift, targets):
        f = parts["fit"] + parts["val"]
        l2 = float(targets["alpha"].iloc[0])
        w, b = train(f, l2)
        return weight_rows(run, ids, w, b, shift, l2, parts.get("test"))

    return nan_free(solve(m, plan, refit, WEIGHTS, chosen))


# ---------------------------------------------------------------- predictions


def predict(df: DataFrame, keys: Sequence[str], x: str, weights: DataFrame, dim_x: int, dim_y: int, run: str | None = None, run_of: str | None = None) -> DataFrame:
    """Prediction vectors per row: (keys, t0, yhat) for target blocks that fit the model allowance.

    ``run`` fixes the run; ``run_of`` names a column that says which run predicts the row (the run
    in which the row is a test row).
    """
    spark = df.sparkSession
    if (run is None) == (run_of is None):
        raise ValueError("give exactly one of run and run_of")
    weights = weights.select("run", "target", "w", "b").persist()
    runs = [run] if run is not None else [r[0] for r in weights.select("run").distinct().collect()]
    span = int(max(1, min(dim_y, MODEL_BYTES // (8 * (dim_x + 1) * len(runs)))))
    label = F.lit(run) if run is not None else F.col(run_of).cast("string")
    base = df.select(*keys, label.alias("_run"), A.as_double(x).alias("_x"))
    fields = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)
    out = None
    for t0 in range(0, dim_y, span):
        rows = weights.where(F.col("run").isin(runs) & F.col("target").between(t0, t0 + span - 1)).toPandas()
        model = {}
        for name, g in rows.groupby("run"):
            g = g.sort_values("target")
            model[str(name)] = (stack(g["w"]).T, g["b"].to_numpy())
        shared = spark.sparkContext.broadcast(model)
        block = base.mapInArrow(_predict_scan(shared, len(keys), t0), f"{fields}, t0 int, yhat array<double>")
        out = block if out is None else out.unionByName(block)
    weights.unpersist()
    return out


def _predict_scan(shared, n_keys, t0):
    def run_batches(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            runs = b.column(n_keys).to_numpy(zero_copy_only=False)
            x = list_matrix(b.column(n_keys + 1))
            for name in np.unique(runs.astype(str)):
                idx = np.flatnonzero(runs.astype(str) == name)
                w, c = shared.value[name]
                p = x[idx] @ w + c
                take = pa.array(idx)
                yield pa.RecordBatch.from_arrays(
                    [b.column(i).take(take) for i in range(n_keys)]
                    + [pa.array(np.full(len(idx), t0, dtype=np.int32)), list_column(p)],
                    names=[*b.schema.names[:n_keys], "t0", "yhat"],
                )

    return run_batches


def long_predictions(pred: DataFrame, keys: Sequence[str], y: DataFrame, y_col: str) -> DataFrame:
    """Long (keys, target, y, p) rows from prediction blocks and the response vectors."""
    joined = pred.join(y.select(*keys, A.as_double(y_col).alias("_y")), list(keys))
    zipped = F.arrays_zip(F.slice("_y", F.col("t0") + 1, F.size("yhat")).alias("y"), F.col("yhat").alias("p"))
    return joined.select(*keys, "t0", F.posexplode(zipped).alias("_i", "_z")).select(
        *keys, (F.col("t0") + F.col("_i")).alias("target"), F.col("_z.y").alias("y"), F.col("_z.p").alias("p")
    )
