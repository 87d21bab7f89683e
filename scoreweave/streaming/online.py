"""Running statistics, time bins, context and incremental moments over streams.

Sums per micro-batch are merged in a ``StreamTable``: nothing waits for a watermark, so every event counts whenever it
comes, and what is kept grows with the keys and not with the events.  Each ``partial_*`` function makes a batch's rows, each
``merge_*`` adds such rows up, each ``finish_*`` reports; on one whole batch they are the batch twin of the stream.
Context of words is kept by a stateful operator instead, whose state per story is the last few words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import arrays as A
from ..operators.gram import Moments, moments
from .tables import StreamTable


def into(df: DataFrame, table: StreamTable, partial: Callable[[DataFrame], DataFrame] = lambda batch: batch, mode: str = "append") -> DataStreamWriter:
    """A writer that commits every micro-batch's partial rows under its batch id."""
    return df.writeStream.outputMode(mode).foreachBatch(lambda batch, i: table.commit(i, partial(batch)) and None)


def _added(*sums: str, keys: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], F.max("batch").alias("batch"))


# ---------------------------------------------------------------- count, mean and deviation per key


def partial_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, mean, m2): values counted, their mean and their squared distances from it."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))


def merge_stats(keys: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Pairwise merging of means and squared distances, in the order of batches; a key has one row per piece at most."""

    def merge(rows: DataFrame) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct("batch", "n", "mean", "m2")))
        none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

        def add(a, b):
            n = a["n"] + b["n"]
            apart = b["mean"] - a["mean"]
            joined = F.struct(n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n).alias("m2"))
            return F.when(b["n"] == 0, a).otherwise(joined)

        out = rows.groupBy(*keys).agg(F.aggregate(parts, none, add).alias("_s"), F.max("batch").alias("batch"))
        return out.select(*keys, F.col("_s.n").alias("n"), F.col("_s.mean").alias("mean"), F.col("_s.m2").alias("m2"), "batch")

    return merge


def finish_stats(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, mean and n-1 standard deviation; undefined ones are NULL."""
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return rows.select(*keys, "n", F.when(F.col("n") > 0, F.col("mean")).alias("mean"), std.alias("std"))


# ---------------------------------------------------------------- time bins and overlapping contexts


def partial_windows(df: DataFrame, ts: str, width: str, keys: Sequence[str], value: str, step: str | None = None) -> DataFrame:
    """(win_start, win_end, keys, n, n_value, total) of tumbling bins, or of contexts that begin every ``step``.

    An event counts in width / step contexts.  Events without a time are in none.
    """
    window = F.window(ts, width, step) if step else F.window(ts, width)
    out = df.groupBy(window.alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("n_value"), F.sum(value).alias("total"))
    return out.select(F.col("_w.start").alias("win_start"), F.col("_w.end").alias("win_end"), *keys, "n", "n_value", "total")


def merge_windows(keys: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    return _added("n", "n_value", "total", keys=["win_start", "win_end", *keys])


def finish_windows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("mean", F.try_divide("total", "n_value")).drop("n_value")


# ---------------------------------------------------------------- the last words up to every bin

CONTEXT = "bin int, words array<string>"
CONTEXT_STATE = "words array<string>, last_bin int, last_seq long, word_bin int"


def word_context(df: DataFrame, key: str, width: float, max_words: int) -> DataFrame:
    """For every story and time bin the last ``max_words`` words up to it: rows (key, bin, words), put out in update mode.

    ``df`` streams (key, seq, word, t0, t1); a word belongs to the bin of its midpoint, empty bins repeat the words before,
    and there are ceil(max t1 / width) bins.  A bin comes again when a later batch brings words for it: the newest row holds (``latest``),
    so the last bins are out without waiting for a watermark.  A story's words come in the order of seq from batch to batch, in any order within
    one, and their midpoints do not go back; words that break this raise, since the bins they change cannot be told from the words kept.
    The state of a story is ``max_words`` words; NULL keys are a story.
    """
    kept = df.select(F.col(key).alias(key), F.col("seq").cast("long").alias("seq"), "word", F.col("t0").cast("double").alias("t0"), F.col("t1").cast("double").alias("t1"))

    def run(story: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(frames)).sort_values("seq")
        words, last_bin, last_seq, word_bin = state.get if state.exists else ([], -1, None, -1)
        seq = new["seq"].to_numpy()
        if last_seq is not None and seq[0] <= last_seq:
            raise ValueError(f"story {story[0]!r}: word {seq[0]} comes after word {last_seq}")
        bins = np.maximum(np.floor((new["t0"].to_numpy() + new["t1"].to_numpy()) / 2 / width).astype(int), 0)
        if (np.diff(bins, prepend=word_bin) < 0).any():
            raise ValueError(f"story {story[0]!r}: the midpoints of its words go back")
        most = max(last_bin, int(np.ceil(new["t1"].max() / width)) - 1)
        first = min(int(bins[0]), last_bin + 1)
        ends = np.searchsorted(bins, np.arange(first, most + 1), "right")  # words of this batch up to every bin
        every = [*words, *new["word"]]
        out = [(story[0], b, every[max(0, len(words) + e - max_words) : len(words) + e]) for b, e in zip(range(first, most + 1), ends)]
        state.update((every[-max_words:], most, int(seq[-1]), int(bins[-1])))
        yield pd.DataFrame(out, columns=[key, "bin", "words"])

    kind = df.schema[key].dataType.simpleString()
    return kept.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, {CONTEXT}", CONTEXT_STATE, "update", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- incremental moments


def partial_moments(x: str, y: str, dims: tuple[int, int], part: str = "part") -> Callable[[DataFrame], DataFrame]:
    """A batch's moment rows around zero, which add up whatever the batches are."""
    zero = np.zeros(sum(dims))

    def run(batch: DataFrame) -> DataFrame:
        if batch.isEmpty():
            return batch.sparkSession.createDataFrame([], "part string, g int, n long, s double, ss double, xr array<double>")
        return moments(batch, part, x, y, shift=zero).df

    return run


def merge_moments(rows: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("n", "s", "ss")]
    return rows.groupBy("part", "g").agg(*sums, A.vector_sum("xr").alias("xr"), F.max("batch").alias("batch"))


def read_moments(table: StreamTable, dims: tuple[int, int]) -> Moments:
    """Total moments of everything committed so far, ready for any fit or score."""
    return Moments(table.read(), dims[0], dims[1], np.zeros(sum(dims)))
