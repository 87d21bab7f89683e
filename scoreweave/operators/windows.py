"""Time bins, cumulative and sliding context, segments, and hyper-parameter picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.ordering import ordered_row_number

TEXT_BUCKET = 64  # bins per bucket when cumulative text is built in two levels


def midpoint_bin(t0: Column | str, t1: Column | str, width: float) -> Column:
    """Bin of an interval's midpoint; a midpoint on an edge belongs to the later bin."""
    return F.floor(((col(t0) + col(t1)) / 2) / width).cast("int")


def bin_frame(intervals: DataFrame, key: str, width: float, t1: str = "t1") -> DataFrame:
    """Every bin of every story, empty ones included: ceil(max t1 / width) of them."""
    n = intervals.groupBy(key).agg(F.ceil(F.max(t1) / width).cast("int").alias("n_bins"))
    return n.where(F.col("n_bins") > 0).select(key, F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin"))


def bin_intervals(intervals: DataFrame, key: str, width: float) -> DataFrame:
    """Word count and words (in order) of every bin; empty bins have none."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("seq", "word"))), lambda s: s["word"])
    filled = (
        intervals.withColumn("bin", midpoint_bin("t0", "t1", width)).groupBy(key, "bin").agg(words.alias("words"))
    )
    out = bin_frame(intervals, key, width).join(filled, [key, "bin"], "left")
    return out.withColumn("words", F.coalesce("words", F.array().cast("array<string>"))).withColumn(
        "n_words", F.size("words")
    )


def cumulative_text(intervals: DataFrame, key: str, width: float, max_words: int | None = None) -> DataFrame:
    """All words up to and including each bin, as one string per bin.

    The result repeats earlier words by definition.  It is built in two levels so that a long story
    is spread over tasks: text of whole earlier buckets of bins, plus a running window inside the
    bucket.  ``max_words`` keeps only the tail a bounded-context model can read.
    """
    bins = bin_intervals(intervals, key, width).withColumn("_b", F.floor(F.col("bin") / TEXT_BUCKET))

    def tail(words: Column) -> Column:
        if max_words is None:
            return words
        return F.when(F.size(words) > max_words, F.slice(words, -max_words, max_words)).otherwise(words)

    def ordered(c: Column) -> Column:
        return F.flatten(F.transform(F.array_sort(c), lambda s: s["words"]))

    per_bucket = bins.groupBy(key, "_b").agg(tail(ordered(F.collect_list(F.struct("bin", "words")))).alias("words"))
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    prefix = per_bucket.select(
        key, "_b", tail(F.flatten(F.collect_list("words").over(earlier))).alias("_prefix")
    )
    inside = Window.partitionBy(key, "_b").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    own = bins.withColumn("_own", F.flatten(F.collect_list("words").over(inside)))
    joined = own.join(prefix, [key, "_b"])
    return joined.select(key, "bin", F.array_join(tail(F.concat("_prefix", "_own")), " ").alias("text"))


def segments(df: DataFrame, key: str, i: str, value: str, size: int) -> DataFrame:
    """Fixed-length pieces of a sampled signal; a final part over half a piece is kept and zero-padded.

    ``i`` is the 0-based sample index.  The group is one segment, so its size is fixed.
    """
    seg = df.withColumn("segment", F.floor(F.col(i) / size).cast("int"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(i), F.col(value)))), lambda s: s[value].cast("double"))
    pieces = seg.groupBy(key, "segment").agg(ordered.alias("samples"))
    n = F.size("samples")
    kept = pieces.where((n == size) | ((F.col("segment") > 0) & (n > size // 2)))
    return kept.withColumn("samples", F.concat("samples", F.array_repeat(F.lit(0.0), size - n)))


def context_windows(df: DataFrame, key: str, i: str, value: str, size: int, context: int) -> DataFrame:
    """For every segment end: the last ``context`` samples up to it, zero-padded on the left.

    Segments (not samples) are the unit of work: each one is sent to the few later segments whose
    context covers it (``ceil(context / size)`` copies), so no window spans a whole story.
    """
    n_total = df.groupBy(key).agg((F.max(i) + 1).alias("_n"))
    seg = df.withColumn("segment", F.floor(F.col(i) / size).cast("int"))
    packed = seg.groupBy(key, "segment").agg(
        F.array_sort(F.collect_list(F.struct(F.col(i).alias("i"), F.col(value).cast("double").alias("v")))).alias("part")
    )
    full, rest = F.floor(F.col("_n") / size), F.col("_n") % size
    last = F.when((full > 0) & (rest > size // 2), full).otherwise(full - 1)
    reach = -(-context // size) + 1
    sent = packed.join(n_total, key).withColumn("_last", last.cast("int")).withColumn(
        "target", F.explode(F.sequence(F.col("segment"), F.col("segment") + reach))
    ).where(F.col("target") <= F.col("_last"))
    end = F.least((F.col("target") + 1) * size, F.col("_n"))
    got = sent.groupBy(key, F.col("target").alias("segment"), end.alias("_end")).agg(
        F.array_sort(F.flatten(F.collect_list("part"))).alias("part")
    )
    values = F.transform(
        F.filter("part", lambda s: (s["i"] < F.col("_end")) & (s["i"] >= F.col("_end") - context)), lambda s: s["v"]
    )
    out = got.withColumn("_v", values)
    return out.select(
        key, "segment", F.concat(F.array_repeat(F.lit(0.0), context - F.size("_v")), "_v").alias("samples")
    )


def head_per_key(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each key in ``order`` (later columns settle ties); numbering is bucketed, so long keys are spread."""
    return ordered_row_number(df, [key], order, "_pos").where(F.col("_pos") <= n).drop("_pos")


def time_bins(df: DataFrame, start: int = 25, stop: int = 200, step: int = 25) -> DataFrame:
    """Repeat each row for every time bin of ``range(start, stop, step)``."""
    last = start + ((stop - start - 1) // step) * step
    return df.withColumn("t_ms", F.explode(F.sequence(F.lit(start), F.lit(last), F.lit(step)))).withColumn(
        "t", ((F.col("t_ms") - start) / step).cast("int")
    )


def flatten_time(df: DataFrame, key: str, t: str, n_times: int) -> DataFrame:
    """(stimulus, time) as one row axis: row = stimulus * n_times + t."""
    return df.withColumn("row", F.col(key).cast("long") * n_times + F.col(t))


def pick_best(grid: DataFrame, keys: Sequence[str], score: str, position: str, maximise: bool = True) -> DataFrame:
    """Grid entry with the best score per key; the earliest position wins a tie, NaN never wins.

    A combinable max of (score, -position), not a sort.
    """
    s = F.col(score) if maximise else -F.col(score)
    rest = [c for c in grid.columns if c not in keys]
    usable = grid.where(F.col(score).isNotNull() & ~F.isnan(score))
    best = F.max_by(F.struct(*rest), F.struct(s.alias("s"), (-F.col(position)).alias("p")))
    return usable.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def best_run(grid: DataFrame, keys: Sequence[str], score: str, position: str) -> DataFrame:
    """Best run of a grid: accuracy for classification and r for regression are both maximised."""
    return pick_best(grid, keys, score, position, maximise=True)
