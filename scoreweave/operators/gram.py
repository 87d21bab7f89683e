"""The moment pass: one distributed scan gives every sum a linear map needs, per part of the data.

Input rows carry a ``part`` label (fold, hold-out...), a feature vector ``x`` and a response vector
``y``.  The result has one row per (part, column): for column r of [x | y] it holds n, sum r,
sum r*r and the vector sum x*r.  Rows of x-columns together are X'X; the row of a y-column is that
target's X'y.  So **targets are rows**, and everything after the scan works on this small table:
a fold's training moments are the sum of the other folds' rows.

All columns are shifted by a constant estimated from a few rows.  Any shift gives exact results;
a shift near the mean keeps the later centring from losing digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.matrices import list_column, list_matrix

MAX_DIM = 4096  # largest feature count whose D x D Gram is solved in one task (128 MB)
TASK_BYTES = 96 * 2**20  # accumulator size a task may hold before it flushes partial sums
PILOT_ROWS = 256

SCHEMA = "part string, g int, n long, s double, ss double, xr array<double>"


@dataclass
class Moments:
    """The moment table with the sizes of both sides and the constant shift of every column."""

    df: DataFrame
    dim_x: int
    dim_y: int
    shift: np.ndarray

    def view(self, left: tuple[int, int], right: tuple[int, int]) -> "Moments":
        """Moments with other roles: ``left`` columns as features and ``right`` columns as targets.

        Both ranges must lie inside the x side of a joint pass.
        """
        (l0, l1), (r0, r1) = left, right
        g = F.col("g")
        new = F.when((g >= l0) & (g < l1), g - l0).when((g >= r0) & (g < r1), g - r0 + (l1 - l0))
        df = self.df.withColumn("g", new.cast("int")).where("g is not null").withColumn(
            "xr", F.slice("xr", l0 + 1, l1 - l0)
        )
        return Moments(df, l1 - l0, r1 - r0, np.concatenate([self.shift[l0:l1], self.shift[r0:r1]]))


def _pilot(df: DataFrame, x: str, y: str | None) -> tuple[int, int, np.ndarray]:
    cols = [A.as_double(x).alias("x")] + ([A.as_double(y).alias("y")] if y else [])
    rows = df.select(*cols).limit(PILOT_ROWS).collect()
    if not rows:
        raise ValueError("no rows to fit on")
    xs = np.array([r["x"] for r in rows])
    ys = np.array([r["y"] for r in rows]) if y else np.zeros((len(rows), 0))
    return xs.shape[1], ys.shape[1], np.concatenate([xs.mean(axis=0), ys.mean(axis=0)])


def _accumulate(dim: int, shift_x: np.ndarray, shift_r: np.ndarray, block: int):
    """Partial sums per (part, column block); flushed when they outgrow the task's allowance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        size = 0

        def emit():
            for (part, cb), (n, s, ss, xr) in held.items():
                w = s.size
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * w, pa.string()),
                        pa.array(cb * block + np.arange(w, dtype=np.int32)),
                        pa.array(np.full(w, n, dtype=np.int64)),
                        pa.array(s),
                        pa.array(ss),
                        list_column(xr),
                    ],
                    names=["part", "g", "n", "s", "ss", "xr"],
                )

        for b in batches:
            if b.num_rows == 0:
                continue
            parts = b.column(0).to_numpy(zero_copy_only=False)
            cbs = b.column(1).to_numpy(zero_copy_only=False)
            x = list_matrix(b.column(2)) - shift_x
            lists = b.column(3)
            order = np.lexsort((cbs, parts))
            keys = list(zip(parts[order], cbs[order]))
            start = 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[start]:
                    continue
                part, cb = str(keys[start][0]), int(keys[start][1])
                idx = order[start:i]
                r = list_matrix(lists.take(pa.array(idx)))
                r = r - shift_r[cb * block : cb * block + r.shape[1]]
                got = held.get((part, cb))
                if got is None:
                    w = r.shape[1]
                    if size + w * dim * 8 > TASK_BYTES and held:
                        yield from emit()
                        held.clear()
                        size = 0
                    got = held[(part, cb)] = [0, np.zeros(w), np.zeros(w), np.zeros((w, dim))]
                    size += w * dim * 8
                got[0] += len(idx)
                got[1] += r.sum(axis=0)
                got[2] += (r * r).sum(axis=0)
                got[3] += r.T @ x[idx]
                start = i
        yield from emit()

    return run


def moments(df: DataFrame, part: str, x: str, y: str | None = None, shift: np.ndarray | None = None, pilot: DataFrame | None = None, parts: int = 16) -> Moments:
    """Run the moment pass.  ``parts`` is the expected number of part labels (sizing only).

    Narrow data: every task keeps all sums and nothing but the sums is shuffled.  Wide data: the
    columns of [x | y] are cut into blocks as wide as x, and rows are spread by (part, block, salt),
    so each task multiplies one block; x is repeated per block, y is not.
    """
    d, t, est = _pilot(pilot if pilot is not None else df, x, y)
    if d > MAX_DIM:
        raise ValueError(f"{d} features exceed {MAX_DIM}; project them first (random_project, subsample_features)")
    shift = est if shift is None else shift
    width = d + t
    right = F.concat(A.as_double(x), A.as_double(y)) if y else A.as_double(x)
    base = df.select(F.col(part).cast("string").alias("part"), A.as_double(x).alias("x"), right.alias("r"))
    if parts * width * d * 8 <= TASK_BYTES:
        block = width
        rows = base.select("part", F.lit(0).alias("cb"), "x", "r")
    else:
        block = max(d, 256)
        nb = -(-width // block)
        cut = F.transform(F.sequence(F.lit(0), F.lit(nb - 1)), lambda b: F.slice(F.col("r"), b * block + 1, F.lit(block)))
        tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), nb)
        rows = (
            base.select("part", "x", F.posexplode(cut).alias("cb", "r"))
            .withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(tasks)))
            .repartition(tasks, "part", "cb", "salt")
            .sortWithinPartitions("part", "cb")
            .select("part", "cb", "x", "r")
        )
    partial = rows.mapInArrow(_accumulate(d, shift[:d], shift, block), SCHEMA)
    table = partial.groupBy("part", "g").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), A.vector_sum("xr").alias("xr")
    )
    return Moments(table, d, t, shift)


def cross_correlation(m: Moments) -> DataFrame:
    """Unit-by-unit Pearson r per part, one row per (part, target) with an array over features."""
    d = m.dim_x
    xs = m.df.where(F.col("g") < d)
    ordered = F.array_sort(F.collect_list(F.struct("g", "s", "ss")))
    stats = xs.groupBy("part").agg(ordered.alias("xs"))
    ys = m.df.where(F.col("g") >= d).select("part", (F.col("g") - d).alias("target"), "n", "s", "ss", "xr")
    joined = ys.join(stats, "part")
    n = F.col("n").cast("double")
    vy = F.col("ss") - F.col("s") * F.col("s") / n

    def r(xr, st):
        vx = st["ss"] - st["s"] * st["s"] / n
        return F.try_divide(xr - st["s"] * F.col("s") / n, F.sqrt(F.greatest(vx * vy, F.lit(0.0))))

    return joined.select("part", "target", F.zip_with("xr", "xs", r).alias("r"))
