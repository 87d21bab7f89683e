"""Feature-vector transforms on ARRAY<DOUBLE> columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..functions.columns import MAD_TO_SD, finite_or_zero
from ..functions.matrices import list_column, list_matrix
from ..functions.ordering import grouped_median, range_running_sum, stable_hash
from ..session import cut_lineage

EPS = 1e-8  # fixed value: guard of every normaliser


def clean_vector(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.transform(v.cast("array<double>"), lambda x: finite_or_zero(x))


def cosine_norm(v: str) -> Column:
    """Divide by the L2 norm, held above 1e-8."""
    return A.let(clean_vector(v), lambda c: A.scale(c, 1 / F.greatest(F.sqrt(A.sum_squares(c)), F.lit(EPS))))


def unit_norm(v: str) -> Column:
    """Divide by (L2 norm + 1e-8)."""
    return A.let(clean_vector(v), lambda c: A.scale(c, 1 / (F.sqrt(A.sum_squares(c)) + EPS)))


def layer_norm(v: str) -> Column:
    """Zero mean and unit population variance within the vector."""
    return A.let(A.centre(clean_vector(v)), lambda c: A.scale(c, 1 / F.sqrt(A.sum_squares(c) / F.size(c) + EPS)))


def normalise(df: DataFrame, vec: str, kind: str, out: str | None = None) -> DataFrame:
    """Normalise every vector.  Row-wise kinds are pure projections; z-scores need one statistics
    pass, whose result (one row of arrays) enters as a scalar subquery."""
    out = out or vec
    if kind in ("cosine", "unit_norm", "layer_norm"):
        f = {"cosine": cosine_norm, "unit_norm": unit_norm, "layer_norm": layer_norm}[kind]
        return df.withColumn(out, f(vec))
    clean = df.withColumn(out, clean_vector(vec))
    if kind in ("batch_zscore", "running_stats", "global_zscore"):
        std = A.vector_std(out)
        stats = clean.agg(F.struct(A.vector_mean(out).alias("m"), std.alias("s"), F.count(F.lit(1)).alias("n")).alias("st"))
        st = stats.scalar()
        # running statistics use the population spread, the batch z-score the n-1 spread; the global
        # z-score floors the n-1 spread instead of adding to it.
        factor = F.sqrt((F.col("_st.n") - 1) / F.col("_st.n")) if kind == "running_stats" else F.lit(1.0)

        def spread(s: Column) -> Column:
            return F.greatest(s, F.lit(1e-12)) if kind == "global_zscore" else s * factor + EPS

        centred = F.zip_with(F.col(out), F.col("_st.m"), lambda x, m: x - m)
        z = F.zip_with(centred, F.col("_st.s"), lambda x, s: x / spread(s))
        return clean.withColumn("_st", st).withColumn(out, z).drop("_st")
    if kind == "robust_zscore":
        long = clean.select(F.posexplode(out).alias("unit", "value"))
        med = grouped_median(long, ["unit"], "value", "median")
        dev = long.join(med, "unit").withColumn("d", F.abs(F.col("value") - F.col("median")))
        stats = med.join(grouped_median(dev, ["unit"], "d", "mad"), "unit")
        packed = stats.agg(F.array_sort(F.collect_list(F.struct("unit", "median", "mad"))).alias("st")).scalar()
        z = F.zip_with(F.col(out), F.col("_st"), lambda x, s: (x - s["median"]) / (s["mad"] * MAD_TO_SD + EPS))
        return clean.withColumn("_st", packed).withColumn(out, z).drop("_st")
    raise ValueError(f"Unknown normalization_type: {kind}")


def zlabel(df: DataFrame, stats: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return df.join(stats.select(*keys, "mean", "std"), list(keys)).withColumn(
        out, (F.col(value) - F.col("mean")) / F.col("std")
    ).drop("mean", "std")


def unzlabel(df: DataFrame, stats: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return df.join(stats.select(*keys, "mean", "std"), list(keys)).withColumn(
        out, F.col(value) * F.col("std") + F.col("mean")
    ).drop("mean", "std")


# ---------------------------------------------------------------- random projection


def projection_density(dim: int) -> float:
    return min(1.0, max(0.001, dim**-0.5))


def projection_entries(spark, dim: int, k: int, kind: str = "sparse", seed: int = 42) -> DataFrame:
    """The projection matrix as rows (unit, out, weight), generated on executors from a hash.

    Sparse: +-sqrt(s) with density 1/s; dense: standard normal / sqrt(k) by Box-Muller on two hash
    uniforms.  No matrix is held by the driver.
    """
    grid = spark.range(dim).select(F.col("id").cast("int").alias("unit")).withColumn(
        "out", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    )
    h = stable_hash(F.concat_ws(":", F.col("unit").cast("string"), F.col("out").cast("string")), seed)
    two32 = float(2**32)

    def uniform(start: int) -> Column:
        return (F.conv(F.substring(h, start, 8), 16, 10).cast("double") + 0.5) / two32

    if kind == "sparse":
        density = projection_density(dim)
        sign = F.when(uniform(9) < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0))
        w = F.when(uniform(1) < density, sign * (density**-0.5))
        return grid.withColumn("weight", w).where(F.col("weight").isNotNull())
    if kind == "dense":
        normal = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * F.pi() * uniform(9))
        return grid.withColumn("weight", normal / (k**0.5))
    raise ValueError(f"unknown projection {kind!r}")


MATRIX_WEIGHTS = 20_000_000  # largest projection matrix sent to tasks (160 MB)


def random_project(
    df: DataFrame, keys: Sequence[str], vec: str, dim: int, k: int, kind: str = "sparse", seed: int = 42,
    always: bool = False,
) -> DataFrame:
    """Project each vector to k dimensions; skipped when k >= dim unless ``always`` (stacking).

    A matrix within the checked size is sent to the tasks and applied to Arrow batches, so the data
    is not shuffled; a larger one is joined.
    """
    if k >= dim and not always:
        return df
    if dim * k > MATRIX_WEIGHTS:
        return _random_project_join(df, keys, vec, dim, k, kind, seed)
    entries = projection_entries(df.sparkSession, dim, k, kind, seed).toPandas()
    matrix = np.zeros((dim, k))
    matrix[entries["unit"].to_numpy(), entries["out"].to_numpy()] = entries["weight"].to_numpy()
    shared = df.sparkSession.sparkContext.broadcast(matrix)
    rest = [c for c in df.columns if c != vec]
    fields = [f for f in df.schema.fields if f.name != vec]
    schema = T.StructType([*fields, T.StructField(vec, T.ArrayType(T.DoubleType()))])
    n_rest = len(rest)

    def apply(batches):
        for b in batches:
            if b.num_rows:
                cols = [b.column(i) for i in range(n_rest)]
                yield pa.RecordBatch.from_arrays(
                    [*cols, list_column(list_matrix(b.column(n_rest)) @ shared.value)], names=[*b.schema.names[:n_rest], vec]
                )

    return df.select(*rest, A.as_double(vec).alias(vec)).mapInArrow(apply, schema)


def _random_project_join(df: DataFrame, keys: Sequence[str], vec: str, dim: int, k: int, kind: str, seed: int) -> DataFrame:
    """The same projection as a join for matrices too large to hold per task; every row has its own, whatever its keys."""
    df = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    long = df.select("_row", F.posexplode(F.col(vec).cast("array<double>")).alias("unit", "v"))
    entries = projection_entries(df.sparkSession, dim, k, kind, seed)
    sums = long.join(entries, "unit").groupBy("_row", "out").agg(F.sum(F.col("v") * F.col("weight")).alias("s"))
    pairs = sums.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("out", "s"))).alias("_p"))
    fill = F.sequence(F.lit(0), F.lit(k - 1))
    projected = F.transform(fill, lambda o: F.coalesce(F.element_at(F.col("_p"), o), F.lit(0.0)))
    return df.drop(vec).join(pairs, "_row", "left").withColumn(vec, projected).drop("_p", "_row")


# ---------------------------------------------------------------- layers, sequences, words


def combine_layers(df: DataFrame, keys: Sequence[str], layers: Sequence[str], vec: str = "vec", mode: str = "concatenate") -> DataFrame:
    """Concatenate or stack the listed layers per stimulus, in list order; rows missing a layer drop."""
    position = F.array_position(F.array(*[F.lit(x) for x in layers]), F.col("layer"))
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct(position.alias("p"), F.col(vec).alias("v")))), lambda s: s["v"]
    )
    g = df.where(F.col("layer").isin(list(layers))).groupBy(*keys).agg(ordered.alias(vec))
    g = g.where(F.size(vec) == len(layers))
    if mode == "concatenate":
        return g.withColumn(vec, F.flatten(vec))
    if mode == "stack":
        return g
    raise ValueError(f"unknown mode {mode!r}")


def pool_sequence(df: DataFrame, keys: Sequence[str], t: str, vec: str, mode: str) -> DataFrame:
    """Collapse the time axis: last, mean, concatenate, or all (stacked, trimmed to the shortest)."""
    if mode == "last":
        return df.groupBy(*keys).agg(F.max_by(vec, t).alias(vec))
    if mode == "mean":
        return df.groupBy(*keys).agg(A.vector_mean(vec).alias(vec))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(vec).alias("v")))), lambda s: s["v"])
    g = df.groupBy(*keys).agg(ordered.alias(vec))
    if mode == "concatenate":
        return g.withColumn(vec, F.flatten(vec))
    if mode == "all":
        shortest = F.array_min(F.transform(vec, lambda v: F.size(v)))
        return g.withColumn(vec, F.transform(vec, lambda v: F.slice(v, F.lit(1), shortest)))
    raise ValueError(f"Unknown sequence_mode: {mode}")


def strip_piece(token: Column | str) -> Column:
    """Sub-token text without its word-start or continuation mark."""
    token = F.col(token) if isinstance(token, str) else token
    return F.regexp_replace(token, "^(Ġ|##)", "")


def word_index(tokens: DataFrame, key: str, order: str, is_start: Column, bucket: int = 1024) -> DataFrame:
    """Number the word of every token: a running count of word starts (bucketed per text)."""
    return range_running_sum(tokens, [key], order, F.when(is_start, 1).otherwise(0), bucket, "word_idx")


def pool_words(tokens: DataFrame, key: str, order: str, vec: str, is_start: Column) -> DataFrame:
    """Mean vector of each word's pieces."""
    indexed = word_index(tokens, key, order, is_start)
    return indexed.groupBy(key, "word_idx").agg(
        A.vector_mean(vec).alias(vec), F.count(F.lit(1)).alias("n_pieces")
    )


TEXTS = 500  # texts whose pieces are held at once


def pool_texts(texts: DataFrame, key: str, vecs: Column, starts: Column, last: bool = False) -> DataFrame:
    """``pool_words`` for texts that hold their pieces in arrays, (key, word_idx, vec, n_pieces): no piece is a row and nothing is shuffled.

    Every row is a text of its own, so ``key`` must be unique.  ``last`` gives the last word only.  A null or empty text has no words.
    """
    rows = texts.select(F.col(key), vecs.alias("v"), F.transform(starts, lambda s: F.coalesce(s, F.lit(False))).alias("s")).where(F.size("v") > 0)

    def pool(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                b = whole.slice(at, TEXTS)
                opens = b.column(2).flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(b.column(2).value_lengths().to_numpy())
                begin = np.concatenate([[0], ends[:-1]])
                m = list_matrix(b.column(1).flatten())
                if len(m) != len(opens):
                    raise ValueError("as many starts as pieces are needed")
                cut = opens.copy()
                cut[begin] = True
                first = np.flatnonzero(cut)
                n = np.diff(np.append(first, len(opens)))
                mean = np.add.reduceat(m, first, axis=0) / n[:, None]
                text = np.searchsorted(ends, first, "right")
                seen = np.cumsum(opens)
                index = seen[first] - (seen[begin] - opens[begin])[text]
                if last:
                    keep = np.flatnonzero(np.append(text[1:] != text[:-1], True))
                    text, index, mean, n = text[keep], index[keep], mean[keep], n[keep]
                own = b.column(0).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([own, pa.array(index.astype(np.int64)), list_column(mean), pa.array(n.astype(np.int64))], [key, "word_idx", "vec", "n_pieces"])

    kind = texts.schema[key].dataType.simpleString()
    return rows.mapInArrow(pool, f"`{key}` {kind}, word_idx long, vec array<double>, n_pieces long")


def last_word(words: DataFrame, key: str, vec: str) -> DataFrame:
    """The last word represents the text."""
    return words.groupBy(key).agg(F.max_by(vec, "word_idx").alias(vec), F.max("word_idx").alias("word_idx"))


def flatten_vec(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn(vec, F.flatten(vec))

