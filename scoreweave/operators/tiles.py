"""Ridge for any number of features: the Gram as square tiles, solved by block elimination.

No task ever holds more than a few tiles.  One scan makes the tiles: every row's [x | y] is cut into blocks, narrow
ones are taken together in spans of at most TILE columns, and the rows of a pair of spans are multiplied in one place; rows of one span are
multiplied where they lie.  A run's training Gram is the sum of its parts' tiles.  The system (S + alpha I) W = X'Y is then eliminated
block row by block row, for all runs at once: factor the tile on the diagonal, scale its row, subtract the row's products from the tiles
below.  Substitution backwards gives the weights in blocks.
Test scores follow from the test tiles: the prediction variance is the sum of w_i' S_ij w_j over all tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.matrices import list_matrix
from ..session import cut_lineage
from .gram import TASK_BYTES, moments
from .linear import RIDGE_ALPHAS, loo_choice, loo_errors, nan_free, scores_from
from .prep import kept_features

TILE = 1024  # columns of a block: a tile is at most 8 MB
PILOT = 1 << 21  # numbers read to estimate the shift
TILES = "part string, i int, j int, n long, s array<double>, ss array<double>, m array<double>"
FIELDS = pa.schema([("part", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), *[(c, pa.list_(pa.float64())) for c in ("s", "ss", "m")]])
NONE = [0.0]  # stands where a tile has no sums or no products of its own


@dataclass
class TileMoments:
    """Sums per (part, block i, block j): products ``m`` of blocks i <= j, and of block (i, i) the column sums.

    Blocks 0 .. nx - 1 are features, nx .. nx + ny - 1 targets; target blocks have sums only.
    """

    df: DataFrame
    dim_x: int
    dim_y: int
    tile: int
    shift: np.ndarray

    @property
    def nx(self) -> int:
        return -(-self.dim_x // self.tile)

    @property
    def ny(self) -> int:
        return -(-self.dim_y // self.tile)

    def shift_of(self, block: int) -> np.ndarray:
        side, k = (self.shift[: self.dim_x], block) if block < self.nx else (self.shift[self.dim_x :], block - self.nx)
        return side[k * self.tile : (k + 1) * self.tile]


def _shift(df: DataFrame, x: str, y: str) -> tuple[int, int, np.ndarray]:
    """Both widths, and means of a few rows: any shift is exact, one near the means keeps digits."""
    both = df.select(A.as_double(x).alias("x"), A.as_double(y).alias("y")).where("x is not null and y is not null")
    size = both.select(F.size("x").alias("d"), F.size("y").alias("t")).first()
    if size is None:
        raise ValueError("no rows to fit on")
    rows = both.limit(max(1, min(256, PILOT // (size["d"] + size["t"])))).collect()
    means = np.concatenate([np.array([r[c] for r in rows], float).mean(axis=0) for c in ("x", "y")])
    return size["d"], size["t"], np.where(np.isfinite(means), means, 0.0)


def _held(tiles: TileMoments) -> tuple[int, list[int], list[tuple[int, int]]]:
    """Blocks that a task takes together on each side, the first column of every block, and the pairs of such spans that have products."""
    per = max(1, TILE // tiles.tile)
    nx, ny = tiles.nx, tiles.ny
    first = [k * tiles.tile for k in range(nx)] + [tiles.dim_x + k * tiles.tile for k in range(ny)] + [tiles.dim_x + tiles.dim_y]
    spans = -(-(nx + ny) // per)
    # targets meet features only; a span of targets alone meets itself, for its sums
    return per, first, [(i, j) for i in range(spans) for j in range(i, spans) if i == j or i * per < nx]


def _multiply(tiles: TileMoments, per: int, first: list[int], pairs: list[tuple[int, int]]) -> Callable:
    """Sums of the rows of every (part, pair of spans) of a task, cut into tiles; they are handed on early where many parts would outgrow the task."""
    nx, dim_x, shift, count = tiles.nx, tiles.dim_x, tiles.shift, tiles.nx + tiles.ny

    def cut(part: str, pair: int, n: int, s: np.ndarray, ss: np.ndarray, m: np.ndarray):
        i0, j0 = (k * per for k in pairs[pair])
        for i in range(i0, min(i0 + per, count)):
            own = slice(first[i] - first[i0], first[i + 1] - first[i0])
            for j in range(max(i, j0), min(j0 + per, count)) if i < nx else [i] if i0 == j0 else []:
                right = slice(first[j] - first[j0], first[j + 1] - first[j0])
                sums = (s[own], ss[own]) if i == j else (NONE, NONE)
                yield part, i, j, n, *sums, m[own, right].ravel() if i < nx else NONE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        size = 0

        def emit():
            for (part, pair), sums in held.items():
                for row in cut(part, pair, *sums):
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, FIELDS)], schema=FIELDS)

        for b in batches:
            if not b.num_rows:
                continue
            labels, which = b.column(0).dictionary_encode(), b.column(1).to_numpy()
            codes, names = labels.indices.to_numpy(), labels.dictionary.to_pylist()
            for p in np.unique(which):
                i, j = (k * per for k in pairs[p])
                left, right = (slice(first[k], first[min(k + per, count)]) for k in (i, j))
                of_pair = which == p
                a = _columns(b.column(2), of_pair, left, shift)
                c = a if i == j else _columns(b.column(3), of_pair, right, shift)
                code = codes[of_pair]
                if len(pairs) == 1:  # a whole row
                    fine = np.isfinite(a).all(1)
                    if not fine.all():
                        a, code = a[fine], code[fine]
                        c = a
                features = max(0, min(left.stop, dim_x) - left.start)
                for k in np.unique(code):
                    rows = code == k
                    x, y = a[rows], c[rows]
                    got = held.get((names[k], int(p)))
                    if got is None:
                        new = 8 * features * y.shape[1]
                        if held and size + new > TASK_BYTES:
                            yield from emit()
                            held.clear()
                            size = 0
                        got = held[names[k], int(p)] = [0, np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros((features, y.shape[1]))]
                        size += new
                    got[0] += len(x)
                    if i == j:
                        got[1] += x.sum(0)
                        got[2] += (x * x).sum(0)
                    if features:
                        got[3] += x[:, :features].T @ y
        yield from emit()

    return run


def _columns(lists: pa.Array, rows: np.ndarray, span: slice, shift: np.ndarray) -> np.ndarray:
    if not rows.all():
        lists = lists.take(pa.array(np.flatnonzero(rows)))
    m = list_matrix(lists)
    if m.shape[1] != span.stop - span.start:
        raise ValueError("vectors differ in length")
    return m - shift[span]


def gram_tiles(df: DataFrame, part: str, x: str, y: str, tile: int = TILE) -> TileMoments:
    """One scan of the rows.  A row with a null vector, or a null or non-finite entry, takes no part."""
    d, t, shift = _shift(df, x, y)
    out = TileMoments(df, d, t, tile, shift)
    per, first, pairs = _held(out)
    whole = F.concat(A.as_double(x), A.as_double(y))
    rows = df.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole.alias("w")).where("w is not null")
    if len(pairs) == 1:  # nothing but sums is shuffled; entries are tested where the rows are whole
        rows = rows.select("part", F.lit(0).alias("pair"), F.col("w").alias("a"), F.lit(None).cast("array<double>").alias("b"))
    else:

        def columns(side: int) -> Column:
            span = F.get(F.array(*[F.lit(p[side]) for p in pairs]), F.col("pair")) * per
            starts = F.array(*[F.lit(c) for c in first])
            return F.slice("w", F.get(starts, span) + 1, F.get(starts, F.least(span + per, F.lit(len(first) - 1))) - F.get(starts, span))

        rows = rows.where(F.forall("w", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
        same = F.get(F.array(*[F.lit(i == j) for i, j in pairs]), F.col("pair"))
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salts = max(1, -(-tasks // len(pairs)))
        salt = F.pmod(F.xxhash64("w") + F.spark_partition_id(), F.lit(salts))
        rows = rows.withColumn("salt", salt).withColumn("pair", F.explode(F.sequence(F.lit(0), F.lit(len(pairs) - 1))))
        rows = rows.select("part", "pair", "salt", columns(0).alias("a"), F.when(~same, columns(1)).alias("b"))
        rows = rows.repartition(tasks, "pair", "salt").sortWithinPartitions("pair", "part").drop("salt")
    partial = rows.mapInArrow(_multiply(out, per, first, pairs), TILES)
    sums = [A.vector_sum(c).alias(c) for c in ("s", "ss", "m")]
    out.df = cut_lineage(partial.groupBy("part", "i", "j").agg(F.sum("n").alias("n"), *sums))
    return out


def _matrix(flat: np.ndarray, rows: int) -> np.ndarray:
    return np.asarray(flat, float).reshape(rows, -1)


def run_tiles(tiles: TileMoments, plan: DataFrame) -> DataFrame:
    """Tiles per (run, role): fit (with the validation share) and test.  A pair's parts are added where they lie."""
    roles: dict[tuple[str, str], set[str]] = {}
    for r in plan.collect():  # labels: runs times parts
        roles.setdefault((r["run"], "test" if r["role"] == "test" else "fit"), set()).add(r["part"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (run, role), parts in sorted(roles.items()):
            rows = pdf[pdf["part"].isin(parts)]
            if len(rows):
                out.append((run, role, int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]), int(rows["n"].sum()), *[sum(rows[c].to_numpy()) for c in ("s", "ss", "m")]))
        return pd.DataFrame(out, columns=["run", "role", "i", "j", "n", "s", "ss", "m"])

    return tiles.df.groupBy("i", "j").applyInPandas(add, TILES.replace("part string", "run string, role string"))


def _each(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Apply ``fn`` to every row (a named tuple); it gives the row's result or a list of them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                got = fn(r)
                out += got if isinstance(got, list) else [got]
            yield pd.DataFrame(out, columns=names)

    return df.mapInPandas(run, schema)


def _centred(tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products around the means, (run, i, j, m), and the sums they come from, (run, i, n, s, ss)."""
    sums = tiles.where("i = j").select("run", "i", "n", "s", "ss")
    si, sj = sums.select("run", "i", F.col("s").alias("si")), sums.select("run", F.col("i").alias("j"), F.col("s").alias("sj"))

    def centre(r):
        return r.run, r.i, r.j, np.asarray(r.m) - (np.outer(r.si, r.sj) / r.n).ravel()

    return _each(tiles.join(si, ["run", "i"]).join(sj, ["run", "j"]).select("run", "i", "j", "n", "m", "si", "sj"), centre, "run string, i int, j int, m array<double>"), sums


def _factor(a: np.ndarray) -> np.ndarray:
    """F with F a F' = I; directions without extent are left out."""
    try:
        return np.linalg.inv(np.linalg.cholesky(a))
    except np.linalg.LinAlgError:
        lam, vec = np.linalg.eigh(a)
        scale = np.where(lam > 1e-13 * max(lam[-1], 1e-300), lam, np.inf)
        return vec.T / np.sqrt(scale)[:, None]


def solve_tiles(system: DataFrame, nx: int) -> DataFrame:
    """(run, i, r, w): weight blocks of every run's system (run, i, j, m), i <= j, whose blocks j >= nx are right-hand sides."""
    schema = "run string, i int, j int, m array<double>"
    now, rows, factors = cut_lineage(system), [], []
    for k in range(nx):
        diagonal = _each(now.where((F.col("i") == k) & (F.col("j") == k)), lambda r: (r.run, _factor(_matrix(r.m, int(len(r.m) ** 0.5))).ravel()), "run string, f array<double>")
        factors.append(cut_lineage(diagonal))

        def scale(r):
            f = _matrix(r.f, int(len(r.f) ** 0.5))
            return r.run, r.i, r.j, (f @ _matrix(r.m, len(f))).ravel(), len(f)

        row = now.where((F.col("i") == k) & (F.col("j") > k)).join(factors[k], "run")
        row = cut_lineage(_each(row, scale, schema + ", h int"))
        rows.append(row)
        if k + 1 == nx:
            break

        def subtract(r):
            a, b = _matrix(r.a, r.h), _matrix(r.b, r.h)
            return r.run, r.i, r.j, np.asarray(r.m) - (a.T @ b).ravel()

        a = row.where(F.col("j") < nx).select("run", F.col("j").alias("i"), F.col("m").alias("a"), "h")
        b = row.select("run", "j", F.col("m").alias("b"))
        below = now.where(F.col("i") > k).join(a, ["run", "i"]).join(b, ["run", "j"])
        now = cut_lineage(_each(below, subtract, schema))
    done = None
    for k in reversed(range(nx)):

        def back(r):
            f = _matrix(r.f, int(len(r.f) ** 0.5))
            z = _matrix(r.z, len(f))
            return r.run, k, r.r, (f.T @ (z if r.u is None else z - _matrix(r.u, len(f)))).ravel()

        z = rows[k].where(F.col("j") >= nx).select("run", (F.col("j") - nx).alias("r"), F.col("m").alias("z")).join(factors[k], "run")
        if done is None:
            z = z.withColumn("u", F.lit(None).cast("array<double>"))
        else:
            later = rows[k].where(F.col("j") < nx).select("run", F.col("j").alias("i"), "m", "h").join(done, ["run", "i"])
            later = _each(later, lambda r: (r.run, r.r, (_matrix(r.m, r.h) @ _matrix(r.w, len(r.m) // r.h)).ravel()), "run string, r int, u array<double>")
            z = z.join(later.groupBy("run", "r").agg(A.vector_sum("u").alias("u")), ["run", "r"])
        found = _each(z, back, "run string, i int, r int, w array<double>")
        done = cut_lineage(found if done is None else done.unionByName(found))
    return done


def ridge_tiles(tiles: TileMoments, plan: DataFrame, alpha: float | DataFrame) -> DataFrame:
    """Ridge with an unpenalised intercept and its test scores per (run, target), as ``linear.ridge`` gives them, at any width.

    ``alpha`` is a number or rows (run, alpha).
    """
    nx, tile, shift = tiles.nx, tiles.tile, tiles.shift
    by_run = cut_lineage(run_tiles(tiles, plan))
    system, fit = _centred(by_run.where("role = 'fit'"))
    per = plan.select("run").distinct().withColumn("alpha", F.lit(float(alpha))) if not isinstance(alpha, DataFrame) else alpha.select("run", "alpha")
    per = cut_lineage(per)

    def penalise(r):
        m = np.array(r.m)
        m[:: int(len(m) ** 0.5) + 1] += r.alpha
        return r.run, r.i, r.j, m

    schema = "run string, i int, j int, m array<double>"
    system = system.where(F.col("i") < nx)
    ridge = _each(system.where("i = j").join(per, "run"), penalise, schema)
    w = solve_tiles(system.where("i <> j").unionByName(ridge), nx)
    test, held = _centred(by_run.where("role = 'test'"))

    # per (run, block of targets): sums of w against everything a score needs
    kinds = "run string, r int, kind string, v array<double>"
    wi = w.select("run", "i", "r", F.col("w").alias("wi"))
    wj = w.select("run", F.col("i").alias("j"), "r", F.col("w").alias("wj"))

    def spread(r):
        t = _width(r.r)
        a, b = _matrix(r.wi, len(r.wi) // t), _matrix(r.wj, len(r.wj) // t)
        return r.run, r.r, "pp", ((a * (_matrix(r.m, len(a)) @ b)).sum(0)) * (1 if r.i == r.j else 2)

    def _width(r: int) -> int:
        return min(tile, tiles_dim_y - r * tile)

    tiles_dim_y, shifts = tiles.dim_y, {k: tiles.shift_of(k) for k in range(nx + tiles.ny)}

    def shared(r):
        t = _width(r.r)
        a = _matrix(r.wi, len(r.wi) // t)
        return r.run, r.r, "cov", (a * _matrix(r.m, len(a))).sum(0)

    def dots(kind: str):
        def run(r):
            a = _matrix(r.wi, len(r.wi) // _width(r.r))
            out = [(r.run, r.r, kind, (np.asarray(r.s) / r.n) @ a)]
            return out + [(r.run, r.r, "sx", shifts[r.i] @ a)] if kind == "fx" else out

        return run

    def targets(kind: str):
        def run(r):
            t = len(r.s)
            return [(r.run, r.i - nx, c, np.asarray(v, float)) for c, v in ((kind + "s", r.s), (kind + "ss", r.ss), (kind + "n", np.full(t, r.n)))]

        return run

    parts = [
        _each(test.where(F.col("j") < nx).join(wi, ["run", "i"]).join(wj, ["run", "j", "r"]), spread, kinds),
        _each(test.where((F.col("i") < nx) & (F.col("j") >= nx)).withColumn("r", F.col("j") - nx).join(wi, ["run", "i", "r"]), shared, kinds),
        _each(fit.where(F.col("i") < nx).join(wi, ["run", "i"]), dots("fx"), kinds),
        _each(held.where(F.col("i") < nx).join(wi, ["run", "i"]), dots("tx"), kinds),
        _each(fit.where(F.col("i") >= nx), targets("f"), kinds),
        _each(held.where(F.col("i") >= nx), targets("t"), kinds),
    ]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    both = both.groupBy("run", "r", "kind").agg(A.vector_sum("v").alias("v"))
    both = both.groupBy("run", "r").agg(F.map_from_entries(F.collect_list(F.struct("kind", "v"))).alias("v")).join(per, "run")

    def score(r):
        v = {k: np.asarray(x, float) for k, x in (r.v.items() if isinstance(r.v, dict) else r.v)}
        b = v["fs"] / v["fn"] - v["fx"]
        t = len(b)
        first = tiles_dim_x + r.r * tile
        pearson = r2 = np.full(t, np.nan)
        n = 0
        if "tn" in v:
            n = v["tn"][0]
            my = v["ts"] / n
            pearson, r2 = scores_from(n, my, v["tx"] + b, np.maximum(v["pp"], 0.0), v["cov"], np.maximum(v["tss"] - v["ts"] ** 2 / n, 0.0))
        b = b + shift[first : first + t] - v["sx"]
        return [(r.run, r.r * tile + k, r.alpha, b[k], pearson[k], r2[k], int(n)) for k in range(t)]

    tiles_dim_x = tiles.dim_x
    scored = _each(both, score, "run string, target int, alpha double, b double, pearson double, r2 double, n_test long")

    def per_target(r):
        a = _matrix(r.w, len(r.w) // _width(r.r))
        return [(r.run, r.r * tile + k, r.i, np.ascontiguousarray(a[:, k])) for k in range(a.shape[1])]

    blocks = _each(w, per_target, "run string, target int, i int, w array<double>")
    ordered = F.array_sort(F.collect_list(F.struct("i", "w")))
    weights = blocks.groupBy("run", "target").agg(F.flatten(F.transform(ordered, lambda x: x["w"])).alias("w"))
    return nan_free(scored.join(weights, ["run", "target"]).select("run", "target", "alpha", "w", "b", "pearson", "r2", "n_test"))


def ridge_subsampled(
    df: DataFrame, part: str, x: str, y: str, plan: DataFrame, k: int, alphas: Sequence[float] = RIDGE_ALPHAS, seed: int = 42, tile: int = TILE
) -> DataFrame:
    """One alpha per run searched by leave-one-out on ``k`` features, then the fit on all of them, however many they are."""
    tiles = gram_tiles(df, part, x, y, tile)
    keep = kept_features(tiles.dim_x, min(k, tiles.dim_x), seed)
    places = F.array(*[F.lit(i) for i in keep])
    small = df.withColumn("_xs", F.transform(places, lambda i: F.element_at(A.as_double(x), i + 1)))
    m = moments(small, part, "_xs", y, shift=np.concatenate([tiles.shift[keep], tiles.shift[tiles.dim_x :]]))
    return ridge_tiles(tiles, plan, loo_choice(loo_errors(small, part, "_xs", y, m, plan, alphas), alphas, True))
