"""Large groups of look-alikes in near_dedup: few rows for their nodes, bounded lists of pairs."""

import random

import numpy as np
import pyarrow as pa

from scoreweave.llm import near_dedup


def test_group_of_hundreds_does_not_branch(spark):
    """A group of 600 classes below the threshold is compared at the roots: no row of it is dealt again."""
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 2**32, (600, near_dedup.FUNCTIONS), dtype=np.uint32)
    sig[:, rng.random(near_dedup.FUNCTIONS) < 0.6] = 7
    rows = [(i, 100, bytearray(s.astype("<u4").tobytes())) for i, s in enumerate(sig)]
    sets = spark.createDataFrame(rows, "rep long, n long, sig binary")
    _, nodes, depth = near_dedup._candidates(sets, 0.75, range(14), near_dedup.SURE)
    assert depth == 0 and 600 <= nodes.count() <= 14 * 600


def test_chain_of_thousands_meets_once(spark, monkeypatch):
    """Members in doubt of one chain larger than a leaf bring their full sets once, not once for every node they share."""
    monkeypatch.setattr(near_dedup, "LEAF_MOST", 16)
    met = []
    settle = near_dedup.settle

    def watched(df):
        out = settle(df)
        if df.columns == ["node", "rep", "comp", "n", "sketch"]:
            met.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "settle", watched)
    rnd = random.Random(5)
    base, texts = [f"w{i}" for i in range(150)], []
    for i in range(60):
        w = list(base)
        for _ in range(4):
            w[rnd.randrange(len(w))] = f"e{rnd.random()}"
        texts.append(" ".join(w).encode())
    full = [near_dedup.shingles(t) for t in texts]
    sets = spark.createDataFrame([(i, len(s), bytearray(near_dedup.signature(s).tobytes())) for i, s in enumerate(full)], "rep long, n long, sig binary")
    nodes = spark.createDataFrame([(k, i) for k in range(3) for i in range(60)], "node long, rep long")
    none = spark.createDataFrame([], "node long, component long")
    groups = near_dedup._second_look(nodes, sets, none, spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(full)], "rep long, full binary"), 0.75)
    comp = list(range(60))
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(full[i], full[j]))
            if comp[i] != comp[j] and 100 * both >= 75 * (len(full[i]) + len(full[j]) - both):
                low, high = sorted((comp[i], comp[j]))
                comp = [low if c == high else c for c in comp]
    assert dict(enumerate(range(60))) | {r["node"]: r["component"] for r in groups.collect()} == dict(enumerate(comp))
    assert met and max(met) <= 60


def test_equal_bytes():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 3, (500, near_dedup.FUNCTIONS), dtype=np.uint8)
    b = rng.integers(0, 3, (500, near_dedup.FUNCTIONS), dtype=np.uint8)
    b[0] = a[0]
    assert (near_dedup._equal(a, b) == (a == b).sum(1)).all() and near_dedup._equal(a[:0], b[:0]).shape == (0,)


def test_leaf_keeps_a_forest_while_it_compares(monkeypatch):
    """A node of 700 like members never holds all their pairs, and gives a spanning forest of them."""
    n, most = 700, []
    spanning = near_dedup.spanning

    def watched(pairs, *rest):
        most.append(pairs.shape[1])
        return spanning(pairs, *rest)

    monkeypatch.setattr(near_dedup, "spanning", watched)
    member = [{"rep": i, "comp": i, "n": 50, "sketch": bytes(near_dedup.FUNCTIONS)} for i in range(n)]
    kind = pa.list_(pa.struct([("rep", pa.int64()), ("comp", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array([member], kind), pa.array([False])], ["members", "star"])
    (out,) = near_dedup._leaf_pairs(0.75, 74, near_dedup.SURE)([batch])
    assert out.num_rows == n - 1 and max(most) <= 64 * n + n
