"""Exact top-k by inner product with MaxScore.

Every component is a term.  A shard of candidates holds one posting array per (term, sign of the
query's weight) with a score bound.  Per query the terms are ordered by bound and split: the terms whose bounds together cannot reach
the current k-th best score are non-essential.  Essential postings are traversed; candidates that can still reach the
threshold are probed in the remaining terms, bound by bound, while they stay competitive.
Shards run in parallel, each against blocks of queries; their winners are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, settle

SHARD = 8192  # candidates in a task
BLOCK = 512  # queries in a task


def quantised(vector: str) -> F.Column:
    """floor(256 x) of every component; null where the vector is null or holds a null or non-finite component."""
    whole = F.transform(col(vector), lambda x: F.floor(x.cast("double") * 256))
    fine = F.forall(col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, whole)


def max_score(query: np.ndarray, postings: np.ndarray, high: np.ndarray, low: np.ndarray, ids: np.ndarray, own: int, k: int, probe: np.ndarray) -> np.ndarray:
    """Positions of the k best candidates of a shard (ties to smaller ids), best first.

    ``postings``: (terms, candidates) in ascending ids; ``high``, ``low``: largest and smallest posting of each term;
    ``probe``: positions whose exact scores give the first threshold.
    """
    bound = np.where(query > 0, query * high, query * low)
    bound[query == 0] = 0
    terms = np.argsort(-np.abs(bound), kind="stable")
    terms = terms[query[terms] != 0]
    rest = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)  # most that terms i.. can still add
    first = query @ postings[:, probe]
    first = np.sort(first[ids[probe] != own])
    threshold = first[-k] if len(first) >= k else None
    if threshold is None:
        essential = len(terms)
    else:
        essential = int(np.argmax(rest < threshold)) if (rest < threshold).any() else len(terms)
    head = terms[:essential]
    score = query[head] @ postings[head] if len(head) else np.zeros(len(ids), np.int64)
    alive = np.flatnonzero(ids != own)
    score = score[alive]
    for i in range(essential, len(terms)):  # probe the others while competitive
        if threshold is not None:
            fit = score + rest[i] >= threshold
            if not fit.all():
                alive, score = alive[fit], score[fit]
        score = score + query[terms[i]] * postings[terms[i], alive]
    if len(score) > k:
        cut = -np.partition(-score, k - 1)[k - 1]
        keep = score >= cut
        alive, score = alive[keep], score[keep]
    best = np.lexsort((ids[alive], -score))[:k]
    return np.stack([ids[alive[best]], score[best]])


def _shard(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        cand = candidates.sort_by("vec_id")
        lists = [queries.column("v").to_pylist(), cand.column("v").to_pylist()]
        dims = max((len(v) for part in lists for v in part), default=0)
        q, c = (np.array([v + [0] * (dims - len(v)) for v in part], np.int64).reshape(len(part), dims) for part in lists)
        ids = cand.column("vec_id").to_numpy()
        names = queries.column("vec_id").to_numpy()
        out = []
        if len(ids):
            postings = np.ascontiguousarray(c.T)
            peak = int(max(np.abs(q).max(initial=0), 1)) * int(max(np.abs(c).max(initial=0), 1)) * max(dims, 1)
            if peak < 2**53:  # whole numbers of this size are exact as doubles, and products of doubles are fast
                q, postings = q.astype(np.float64), postings.astype(np.float64)
            high, low = postings.max(1), postings.min(1)
            probe = np.unique(np.linspace(0, len(ids) - 1, min(len(ids), 512)).astype(int))
            for own, vector in zip(names, q):
                found = max_score(vector, postings, high, low, ids, own, k, probe)
                out.append((np.full(found.shape[1], own), found[0].astype(np.int64), found[1].astype(np.int64)))
        cols = [np.concatenate([o[i] for o in out]) if out else np.array([], np.int64) for i in range(3)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, cols))))

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products of every query with all other rows.

    Components become floor(256 x).  Queries are the rows whose id is divisible by ``every``.  Ties go to the smaller id.  Rows with a null
    id, a null vector or null or non-finite components take no part; an empty vector scores 0 with all; shorter
    vectors are filled with zeros; rows that share an id count once, with their smallest vector.  Other
    columns are ignored.  An empty table gives an empty table.
    """
    rows = vectors.select(col(id_col).cast("long").alias("vec_id"), quantised(vector_col).alias("v")).where("vec_id is not null and v is not null")
    rows = settle(rows.groupBy("vec_id").agg(F.min("v").alias("v")))
    asked = rows.where(F.col("vec_id") % every == 0)
    n, n_asked = rows.count(), asked.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-n_asked // BLOCK))
    place = F.xxhash64("vec_id")
    numbers = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    cand = rows.select("*", F.pmod(place, F.lit(shards)).cast("int").alias("s"), numbers(blocks).alias("b"))
    asked = asked.select("*", numbers(shards).alias("s"), F.pmod(place, F.lit(blocks)).cast("int").alias("b"))
    found = asked.groupBy("s", "b").cogroup(cand.groupBy("s", "b")).applyInArrow(_shard(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
