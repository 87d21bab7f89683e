"""Tiled ridge against numpy: any width, any tile, several runs, odd rows."""

import numpy as np
import pytest

from scoreweave.operators import linear as L
from scoreweave.operators import tiles as T
from scoreweave.operators.gram import moments
from scoreweave.operators.tiles import gram_tiles, ridge_subsampled, ridge_tiles
from scoreweave.session import cut_lineage


def frame(spark, x, y, part):
    rows = [(i, str(p), a.tolist(), b.tolist()) for i, (a, b, p) in enumerate(zip(x, y, part))]
    return spark.createDataFrame(rows, "id long, part string, x array<double>, y array<double>").repartition(4)


def numpy_ridge(x, y, alpha):
    mx, my = x.mean(0), y.mean(0)
    xc, yc = x - mx, y - my
    w = xc.T @ np.linalg.solve(xc @ xc.T + alpha * np.eye(len(x)), yc)  # stimulus side: the same weights
    return w, my - mx @ w


@pytest.mark.parametrize("tile", [3, 100])
def test_tiles_equal_moments(spark, tile):
    """Every tile size gives the weights and scores of the one-Gram path, for all runs of a cross-validation."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 7)) + 5.0
    y = x @ rng.normal(size=(7, 5)) + rng.normal(size=(90, 5))
    rows = frame(spark, x, y, np.arange(90) % 3)
    plan = L.cv_design(spark, 3)
    want = {(r["run"], r["target"]): r for r in L.ridge(moments(rows, "part", "x", "y"), plan, 2.0).collect()}
    got = {(r["run"], r["target"]): r for r in ridge_tiles(gram_tiles(rows, "part", "x", "y", tile), plan, 2.0).collect()}
    assert got.keys() == want.keys() and len(got) == 15
    for k, r in got.items():
        np.testing.assert_allclose(r["w"], want[k]["w"], atol=1e-9)
        assert [r["b"], r["pearson"], r["r2"], r["n_test"]] == pytest.approx([want[k][c] for c in ("b", "pearson", "r2", "n_test")], abs=1e-9)


def test_six_thousand_features(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 6000)) + 1.0
    y = x[:, :40] @ rng.normal(size=(40, 3)) + rng.normal(size=(200, 3))
    part = np.where(np.arange(200) % 5 == 0, "test", "train")
    rows = frame(spark, x, y, part)
    got = sorted(ridge_tiles(gram_tiles(rows, "part", "x", "y"), L.train_test_design(spark), 50.0).collect(), key=lambda r: r["target"])
    w, b = numpy_ridge(x[part == "train"], y[part == "train"], 50.0)
    np.testing.assert_allclose(np.array([r["w"] for r in got]).T, w, atol=1e-6)
    np.testing.assert_allclose([r["b"] for r in got], b, atol=1e-6)
    p, t = x[part == "test"] @ w + b, y[part == "test"]
    r2 = 1 - ((t - p) ** 2).sum(0) / ((t - t.mean(0)) ** 2).sum(0)
    np.testing.assert_allclose([r["r2"] for r in got], r2, atol=1e-6)


def test_odd_rows_and_missing_test_share(spark):
    """Rows with NULL, NaN or infinite entries take no part; without test rows the scores are NULL; a flat feature has weight 0."""
    rng = np.random.default_rng(7)
    x = np.hstack([rng.normal(size=(40, 3)), np.ones((40, 1))])
    y = x @ rng.normal(size=(4, 2)) + rng.normal(size=(40, 2))
    clean = frame(spark, x, y, np.full(40, "train"))
    odd = spark.createDataFrame(
        [(100, "train", None, [1.0, 2.0]), (101, "train", [1.0, None, 1.0, 1.0], [1.0, 2.0]), (102, "train", [1.0] * 4, [float("nan"), 2.0]), (103, "train", [float("inf")] * 4, [1.0, 2.0])],
        clean.schema,
    )
    plan = L.design(spark, [("0", "fit", "train")])
    got = sorted(ridge_tiles(gram_tiles(clean.unionByName(odd), "part", "x", "y", 2), plan, 0.5).collect(), key=lambda r: r["target"])
    w, b = numpy_ridge(x, y, 0.5)
    np.testing.assert_allclose(np.array([r["w"] for r in got]).T, w, atol=1e-9)
    np.testing.assert_allclose([r["b"] for r in got], b, atol=1e-9)
    assert all(r["pearson"] is None and r["r2"] is None and r["n_test"] == 0 for r in got) and abs(got[0]["w"][3]) < 1e-12
    with pytest.raises(ValueError, match="no rows"):
        gram_tiles(clean.limit(0), "part", "x", "y")


def test_subsampled_search_takes_the_best_alpha(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 30))
    y = x @ rng.normal(size=(30, 2)) * 0.2 + rng.normal(size=(60, 2))
    rows = frame(spark, x, y, np.where(np.arange(60) % 4 == 0, "test", "train"))
    plan, alphas = L.train_test_design(spark), (0.1, 10.0, 1000.0)
    m = moments(rows, "part", "x", "y")
    want = {r["target"]: r for r in L.ridge_loo(rows, "part", "x", "y", m, plan, alphas, shared=True).collect()}
    got = {r["target"]: r for r in ridge_subsampled(rows, "part", "x", "y", plan, 30, alphas, tile=8).collect()}
    for t, r in got.items():
        assert r["alpha"] == want[t]["alpha"]
        np.testing.assert_allclose(r["w"], want[t]["w"], atol=1e-9)


def test_rows_of_narrow_blocks_stay_where_they_lie(spark, monkeypatch):
    """Blocks that fit one span are summed before the shuffle: no row travels by block."""
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(50, 3)) + 4.0, rng.normal(size=(50, 2))
    rows = frame(spark, x, y, np.arange(50) % 5)
    plans = []
    monkeypatch.setattr(T, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut_lineage(df))
    tiles = gram_tiles(rows, "part", "x", "y", 1)
    assert len(plans) == 1 and "salt" not in plans[0]
    got = {(r["part"], r["i"], r["j"]): r for r in tiles.df.collect()}
    both = np.hstack([x, y]) - tiles.shift
    for p in range(5):
        own = both[np.arange(50) % 5 == p]
        for i in range(3):
            for j in range(i, 5):
                assert got[str(p), i, j]["m"] == pytest.approx([own[:, i] @ own[:, j]]) and got[str(p), i, j]["n"] == 10
        assert got[str(p), 4, 4]["s"] == pytest.approx([own[:, 4].sum()]) and got[str(p), 4, 4]["ss"] == pytest.approx([(own[:, 4] ** 2).sum()])
    assert len(got) == 5 * (3 + 2 + 1 + 3 * 2 + 2)
