"""Penalised linear classifiers by batched Newton steps, selected by cross-validated accuracy.

A candidate is a penalty and a set of training parts.  One scan of the rows gives loss, gradient and Hessian of all candidates that have
not converged; the Newton systems are solved in tasks, one per candidate.  Only weights come to the driver, whose size is
that of the models.  A step that raises the loss is halved and tried again in the next scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.matrices import list_column, list_matrix
from ..session import cut_lineage
from .splits import kfold

C_GRID = (1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)  # fixed values
TASK_BYTES = 128 << 20  # Hessians that a task sums up in one scan; more candidates take turns
TOL = 1e-9  # largest gradient entry of a converged fit, per row


@dataclass
class Linear:
    """One fit: class scores are ((x - mean) / scale) w + b; with two classes there is one score, for the second."""

    c: float
    parts: frozenset
    classes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    n: int
    w: np.ndarray  # (features + 1) x scores, the last row is the intercept
    loss: float = np.inf
    step: np.ndarray | None = None
    size: float = 1.0
    done: bool = False
    tries: list = field(default_factory=list)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Per class; a fit with one class gives it 1."""
        z = ((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]
        if len(self.classes) < 3:
            z = np.hstack([np.zeros((len(x), 1)), z])[:, : len(self.classes)] if len(self.classes) == 2 else np.zeros((len(x), 1))
        z = z - z.max(axis=1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.classes[self.probabilities(x).argmax(axis=1)]


def _sums(fit: Linear, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of the rows; scores are the outer index of the flattened weights."""
    z = np.hstack([(x - fit.mean) / fit.scale, np.ones((len(x), 1))])
    p = fit.probabilities(x)
    k = np.searchsorted(fit.classes, y)
    loss = -np.log(np.maximum(p[np.arange(len(y)), k], 1e-300)).sum()
    one = (k[:, None] == np.arange(len(fit.classes))[None, :]).astype(float)
    if len(fit.classes) == 2:
        p, one = p[:, 1:], one[:, 1:]
    d, s = z.shape[1], p.shape[1]
    grad = (z.T @ (p - one)).T.ravel()
    hess = np.empty((s * d, s * d))
    for i in range(s):
        for j in range(i, s):
            block = z.T @ (z * (p[:, i] * ((i == j) - p[:, j]))[:, None])
            hess[i * d : (i + 1) * d, j * d : (j + 1) * d] = block
            hess[j * d : (j + 1) * d, i * d : (i + 1) * d] = block.T
    return float(loss), grad, hess


def _penalty(fit: Linear) -> tuple[float, np.ndarray, np.ndarray]:
    """|w|^2 / 2C on the weights, not on intercepts; of several classes the intercepts' common shift, which changes nothing, is held at 0."""
    d, s = fit.w.shape
    rate = np.tile(np.append(np.full(d - 1, 1.0 / fit.c), 0.0), s)
    flat = fit.w.T.ravel()
    hess = np.diag(rate)
    ends = np.arange(d - 1, s * d, d)
    if s > 1:
        hess[np.ix_(ends, ends)] += 1.0
    return float((rate * flat * flat).sum() / 2 + (flat[ends].sum() ** 2 / 2 if s > 1 else 0.0)), hess @ flat, hess


def _scan(fits: dict[int, Linear], own):
    """Every task's sums per candidate; ``own`` says which parts of the rows a candidate reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(0).to_numpy(zero_copy_only=False)
            x, y = list_matrix(b.column(1)), b.column(2).to_numpy(zero_copy_only=False)
            for i, fit in fits.items():
                at = np.isin(part, list(fit.parts)) == own
                if at.any():
                    loss, grad, hess = _sums(fit, x[at], y[at])
                    if i not in held:
                        held[i] = [loss, grad, hess]
                    else:
                        held[i][0] += loss
                        held[i][1] += grad
                        held[i][2] += hess
        while held:  # one candidate at a time, as arrays: a list of Python numbers takes four times the room
            i, (loss, grad, hess) = held.popitem()
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([loss], pa.float64()), list_column(grad[None]), list_column(hess.reshape(1, -1))], ["i", "loss", "g", "h"])

    return run


SUMS = "i int, loss double, g array<double>, h array<double>"


def newton(rows: DataFrame, fits: list[Linear]) -> list[Linear]:
    """Fit all candidates on the rows (part, x, y) of their parts."""
    open_ = {i: f for i, f in enumerate(fits) if len(f.classes) > 1}
    while any(not f.done for f in open_.values()):
        taken, room = {}, TASK_BYTES
        for i, f in open_.items():
            if not f.done and (room > f.w.size**2 * 8 or not taken):
                taken[i], room = f, room - f.w.size**2 * 8
        added = rows.mapInArrow(_scan(taken, True), SUMS).groupBy("i").agg(F.sum("loss").alias("loss"), A.vector_sum("g").alias("g"), A.vector_sum("h").alias("h"))

        def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                out = []
                for r in pdf.itertuples(index=False):
                    loss, grad, hess = _penalty(taken[r.i])
                    g = np.asarray(r.g) + grad
                    hess = hess + np.asarray(r.h).reshape(len(g), -1)
                    try:
                        step = -np.linalg.solve(hess, g)
                    except np.linalg.LinAlgError:
                        step = -np.linalg.lstsq(hess, g, rcond=None)[0]
                    out.append((r.i, r.loss + loss, float(np.abs(g).max()), float(g @ step), step))
                yield pd.DataFrame(out, columns=["i", "loss", "steep", "slope", "step"])

        for r in added.mapInPandas(solve, "i int, loss double, steep double, slope double, step array<double>").collect():
            f = taken[r["i"]]
            f.tries.append(r["loss"])
            if r["loss"] > f.loss and f.size > 1e-4:  # too far: back half of the way
                f.w = f.w - f.step * (f.size / 2)
                f.size /= 2
                continue
            f.loss, f.size, f.step = r["loss"], 1.0, np.asarray(r["step"]).reshape(f.w.shape[1], -1).T
            f.done = r["steep"] <= TOL * f.n or -r["slope"] <= 1e-15 * max(1.0, abs(f.loss))
            if not f.done:
                f.w = f.w + f.step
    return fits


def candidates(rows: DataFrame, held: Sequence[int | None], c_grid: Sequence[float]) -> list[Linear]:
    """A fit per penalty and held-out part (None: none), standardised by its own training rows, from one scan of sums."""
    x = F.col("x")
    shift = np.array(rows.limit(1).first()["x"], float)
    moved = F.zip_with(x, F.array(*[F.lit(float(v)) for v in shift]), lambda a, b: a - b)
    sums = rows.withColumn("_m", moved).groupBy("part", "y").agg(
        F.count(F.lit(1)).alias("n"), A.vector_sum("_m").alias("s"), A.vector_sum(F.transform("_m", lambda v: v * v)).alias("ss"))
    got = [(r["part"], r["y"], r["n"], np.array(r["s"]), np.array(r["ss"])) for r in sums.collect()]  # parts times classes
    out = []
    for c in c_grid:
        for h in held:
            own = [g for g in got if g[0] != h]
            n = sum(g[2] for g in own)
            if not n:
                raise ValueError("a training share has no rows")
            mean = sum(g[3] for g in own) / n
            var = np.maximum(sum(g[4] for g in own) / n - mean**2, 0.0)
            scale = np.where(var > 1e-14 * np.maximum(mean**2, 1e-300), np.sqrt(var), 1.0)
            classes = np.unique([g[1] for g in own])
            scores = 1 if len(classes) < 3 else len(classes)
            out.append(Linear(c, frozenset({g[0] for g in got} - {h}), classes, mean + shift, scale, n, np.zeros((len(mean) + 1, scores))))
    return out


def _hits(rows: DataFrame, fits: list[Linear]) -> list[int]:
    """Right answers of every candidate on the rows it has not seen."""

    def run(batches):
        right = np.zeros(len(fits), np.int64)
        for b in batches:
            if b.num_rows:
                part, y = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
                x = list_matrix(b.column(1))
                for i, f in enumerate(fits):
                    at = ~np.isin(part, list(f.parts))
                    if at.any():
                        right[i] += int((f.predict(x[at]) == y[at]).sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(fits)), pa.int32()), pa.array(right)], ["i", "right"])

    got = rows.mapInArrow(run, "i int, right long").groupBy("i").agg(F.sum("right").alias("right")).collect()
    right = {r["i"]: r["right"] for r in got}
    return [right.get(i, 0) for i in range(len(fits))]


def fit_classifier(df: DataFrame, key: str, vec: str, label: str, c_grid: Sequence[float] = C_GRID, folds: int = 5) -> Linear:
    """Logistic regression on standardised inputs, multinomial for more than two classes; C by k-fold accuracy, first on ties.

    Rows with a NULL label or vector, or a null or non-finite entry, take no part.
    """
    fine = F.forall(A.as_double(vec), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.where(fine & F.col(label).isNotNull()).select(key, A.as_double(vec).alias("x"), F.col(label).cast("double").alias("y"))
    rows = cut_lineage(kfold(rows, key, folds, out="part").select("part", "x", "y"))
    if rows.isEmpty():
        raise ValueError("no rows to fit on")
    c = c_grid[0]
    if len(c_grid) > 1:
        parts = sorted(r["part"] for r in rows.select("part").distinct().collect())
        fits = newton(rows, candidates(rows, parts, c_grid))
        right = np.array(_hits(rows, fits)).reshape(len(c_grid), len(parts)).sum(axis=1)
        c = c_grid[int(right.argmax())]
    return newton(rows, candidates(rows, [None], [c]))[0]


def classify(df: DataFrame, fitted: Linear, keys: Sequence[str], vec: str) -> DataFrame:
    """Predicted class and class probabilities (in ascending order of classes) per row."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", pred int, probs array<double>"

    def run(batches):
        for b in batches:
            p = fitted.probabilities(list_matrix(b.column(len(keys)))) if b.num_rows else np.zeros((0, len(fitted.classes)))
            pred = pa.array(fitted.classes[p.argmax(axis=1)].astype(np.int32) if b.num_rows else [], pa.int32())
            probs = pa.array(p.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keys))], pred, probs], [*keys, "pred", "probs"])

    return df.select(*keys, A.as_double(vec).alias("_x")).mapInArrow(run, schema)
