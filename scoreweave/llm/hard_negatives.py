"""Hard-negative mining by slots of the score axis.

An anchor's positives are its best rows of the same label.  A positive with score p asks for the best rows of other labels
with scores between ``low`` and ``high`` percent of p; these windows overlap.  The upper limits of all positives, descending,
cut the score axis into disjoint slots, and a row falls into one slot only.  Every task keeps the k best rows per (anchor, slot),
the merge keeps k again, and the answer of a window is the merge of its slot with all lower ones, cut at its lower limit:
no row is kept once per window.

Anchors are the stated query set; they meet all rows in blocks of (anchors, rows), one task each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, settle
from .topk import quantised

SHARD = 65_536  # rows in a task
BLOCK = 16_384  # anchors in a task


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, best first, ties to the earlier place."""
    if len(score) > k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        over, at = np.flatnonzero(score > cut), np.flatnonzero(score == cut)
        keep = np.concatenate([over, at[: k - len(over)]])
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((keep, -score[keep]))]


def _matrix(lists: list, dims: int) -> np.ndarray:
    return np.array([v + [0] * (dims - len(v)) for v in lists], np.int64).reshape(len(lists), dims)


def _scores(anchors: pa.Table, rows: pa.Table):
    """The rows in ascending ids, and for every anchor its place in the block and its scores with them."""
    rows = rows.sort_by("vec_id")
    lists = [anchors.column("v").to_pylist(), rows.column("v").to_pylist()]
    dims = max((len(v) for part in lists for v in part), default=0)
    a, b = (_matrix(part, dims) for part in lists)
    peak = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(dims, 1)
    if peak < 2**53:  # whole numbers of this size are exact as doubles, and products of doubles are fast
        a, b = a.astype(np.float64), b.astype(np.float64)

    def each():
        for start in range(0, len(a), 64):
            block = (a[start : start + 64] @ b.T).astype(np.int64)
            for i, score in enumerate(block):
                yield start + i, score

    return rows, each


def _table(found: list, names: tuple) -> pa.Table:
    columns = [np.concatenate([f[i] for f in found]) if found else np.array([], np.int64) for i in range(len(names))]
    return pa.table(dict(zip(names, map(pa.array, columns))))


def _positives(k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows, each = _scores(anchors, rows)
        ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        own, kind = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
        same = {x: np.flatnonzero(labels == x) for x in np.unique(kind)}
        found = []
        for i, score in each():
            places = same[kind[i]]
            places = places[ids[places] != own[i]]
            top = places[best(score[places], k)]
            found.append((np.full(len(top), own[i]), ids[top], score[top]))
        return _table(found, ("anchor_id", "positive_id", "positive_score"))

    return run


def limits(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest whole score s with low * p <= 100 * s <= high * p for every positive score p."""
    return -((-low * scores) // 100), (high * scores) // 100


def _slots(k: int, low: int, high: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows, each = _scores(anchors, rows)
        ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        own, kind = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
        asked = anchors.column("p").to_pylist()
        found = []
        for i, score in each():
            floor, top = limits(np.array(asked[i], np.int64), low, high)  # both descending
            places = np.flatnonzero((score <= top[0]) & (score >= floor[-1]) & (labels != kind[i]))
            slot = len(top) - 1 - np.searchsorted(top[::-1], score[places])  # the last limit that is not exceeded
            fit = score[places] >= floor[slot]  # lower windows reach no further down than the slot's own
            places, slot = places[fit], slot[fit]
            for j in np.unique(slot):
                there = places[slot == j]
                keep = there[best(score[there], k)]
                found.append((np.full(len(keep), own[i]), np.full(len(keep), j), ids[keep], score[keep]))
        return _table(found, ("anchor_id", "slot", "negative_id", "negative_score"))

    return run


def mine(
    vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, every: int = 50,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every window that is not empty.

    Anchors are the rows whose id is divisible by ``every``, positives their ``positives`` best other rows of the same
    label, negatives the best ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high *
    positive_score.  Scores are inner products of floor(256 x) and must fit 64 bits; ties go to the smaller id.  Rows
    with a null id, label or vector, or null or non-finite components, take no part; an empty vector scores 0 with all; shorter
    vectors are filled with zeros; rows that share an id count once, with their smallest (label, vector).  Ids and labels are cast
    to long, other columns are ignored.  An empty table gives an empty table.
    """
    rows = vectors.select(col(id_col).cast("long").alias("vec_id"), col(label_col).cast("long").alias("label"), quantised(vector_col).alias("v"))
    rows = rows.where("vec_id is not null and label is not null and v is not null")
    rows = settle(rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("_r")).select("vec_id", "_r.label", "_r.v"))
    asked = rows.where(F.col("vec_id") % every == 0)
    n, n_asked = rows.count(), asked.count()
    wide = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n_asked // BLOCK))
    shards = max(1, -(-n // SHARD), min(-(-wide // blocks), -(-n // 4096)))
    place = F.xxhash64("vec_id")

    def numbers(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    dealt = rows.select("*", F.pmod(place, F.lit(shards)).cast("int").alias("s"), numbers(blocks).alias("b"))

    def meet(anchors: DataFrame, run, schema: str) -> DataFrame:
        anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns], numbers(shards).alias("s"), F.pmod(place, F.lit(blocks)).cast("int").alias("b"))
        return anchors.groupBy("s", "b").cogroup(dealt.groupBy("s", "b")).applyInArrow(run, schema)

    found = meet(asked, _positives(positives), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    found = found.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < positives)
    listed = F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score")))
    found = settle(found.groupBy("anchor_id").agg(listed.alias("p")))
    limited = asked.join(found.select(F.col("anchor_id").alias("vec_id"), F.col("p.positive_score").alias("p")), "vec_id")
    kept = meet(limited, _slots(negatives, low, high), "anchor_id long, slot long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.col("negative_score").desc(), "negative_id")
    kept = kept.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= negatives)
    # descending scores, so a window is a run of the list: slots not above its own, the best k, not below its lower limit
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("negative_score")).alias("s"), F.col("negative_id").alias("i"), "slot")))
    answers = kept.groupBy("anchor_id").agg(ranked.alias("_all")).join(found, "anchor_id")
    answers = answers.select("anchor_id", "_all", F.explode("p").alias("p"))
    below = F.filter("_all", lambda x: x["slot"] >= F.col("p.place"))
    window = F.filter(F.slice(below, 1, negatives), lambda x: F.col("p.positive_score") * low <= x["s"] * -100)
    answers = answers.select("anchor_id", "p.positive_id", "p.positive_score", F.posexplode(window).alias("rank", "n"))
    return answers.select(
        "anchor_id", "positive_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("n.i").alias("negative_id"), "positive_score", (-F.col("n.s")).alias("negative_score")
    )
