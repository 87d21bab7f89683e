"""Linear maps against closed forms in numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoreweave.functions.registry import MetricInput, get_metric
from scoreweave.operators import gram, linear as L, matching as M, similarity as S

rng = np.random.default_rng(0)
N, D, T = 120, 6, 5
X = rng.normal(size=(N, D)) + 3.0
Y = X @ rng.normal(size=(D, T)) + rng.normal(size=(N, T)) * np.linspace(0.5, 4, T) + 1.0
PART = np.array(["test" if i % 4 == 0 else ("val" if i % 4 == 1 else "fit") for i in range(N)])


@pytest.fixture(scope="module")
def rows(spark):
    data = [(int(i), PART[i], "test" if PART[i] == "test" else "train", X[i].tolist(), Y[i].tolist()) for i in range(N)]
    return spark.createDataFrame(data, "id long, part string, split string, x array<double>, y array<double>").repartition(4)


def solve(x, y, alpha):
    mx, my = x.mean(0), y.mean(0)
    xc, yc = x - mx, y - my
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return w, my - mx @ w


def weights(df):
    got = sorted(df.collect(), key=lambda r: r["target"])
    return np.array([r["w"] for r in got]).T, np.array([r["b"] for r in got]), got


def corrected(y, p):
    r = np.corrcoef(y, p)[0, 1]
    return 2 * r / (1 + r)


def test_ridge_and_scores(rows, spark):
    m = gram.moments(rows, "split", "x", "y")
    w, b, got = weights(L.ridge(m, L.train_test_design(spark), 7.0))
    train, test = PART != "test", PART == "test"
    w0, b0 = solve(X[train], Y[train], 7.0)
    np.testing.assert_allclose(w, w0, atol=1e-8)
    np.testing.assert_allclose(b, b0, atol=1e-8)
    p = X[test] @ w0 + b0
    for j, r in enumerate(got):
        assert r["pearson"] == pytest.approx(corrected(Y[test][:, j], p[:, j]), abs=1e-8)
        res = ((Y[test][:, j] - p[:, j]) ** 2).sum() / ((Y[test][:, j] - Y[test][:, j].mean()) ** 2).sum()
        assert r["r2"] == pytest.approx(1 - res, abs=1e-8)


def test_wide_path_equals_narrow_path(rows, spark, monkeypatch):
    narrow = gram.moments(rows, "split", "x", "y")
    monkeypatch.setattr(gram, "TASK_BYTES", 1)
    wide = gram.moments(rows, "split", "x", "y", shift=narrow.shift)
    a = {(r["part"], r["g"]): r for r in narrow.df.collect()}
    b = {(r["part"], r["g"]): r for r in wide.df.collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k]["n"] == b[k]["n"]
        np.testing.assert_allclose(a[k]["xr"], b[k]["xr"], atol=1e-8)


def test_leave_one_out_choice_is_brute_force(rows, spark):
    alphas = (0.1, 10.0, 1000.0)
    m = gram.moments(rows, "split", "x", "y")
    plan = L.train_test_design(spark)
    errors = {r["target"]: np.array(r["err"]) for r in L.loo_errors(rows, "split", "x", "y", m, plan, alphas).collect()}
    xt, yt = X[PART != "test"], Y[PART != "test"]
    for k, a in enumerate(alphas):
        e = np.zeros(T)
        for i in range(len(xt)):
            keep = np.arange(len(xt)) != i
            w, b = solve(xt[keep], yt[keep], a)
            e += (yt[i] - xt[i] @ w - b) ** 2
        np.testing.assert_allclose([errors[j][k] for j in range(T)], e, rtol=1e-6)
    _, _, got = weights(L.ridge_loo(rows, "split", "x", "y", m, plan, alphas))
    assert [r["alpha"] for r in got] == [alphas[int(np.argmin(errors[j]))] for j in range(T)]


def test_blocks_of_targets_and_runs_give_the_same_errors(rows, spark, monkeypatch):
    m = gram.moments(rows, "split", "x", "y")
    plan = L.train_test_design(spark)
    one = {r["target"]: r["err"] for r in L.loo_errors(rows, "split", "x", "y", m, plan, (1.0, 5.0)).collect()}
    monkeypatch.setattr(L, "MODEL_BYTES", 2 * D * 8 * 2)
    monkeypatch.setattr(L, "TARGET_BLOCK", 2)
    two = {r["target"]: r["err"] for r in L.loo_errors(rows, "split", "x", "y", m, plan, (1.0, 5.0)).collect()}
    for j in range(T):
        np.testing.assert_allclose(one[j], two[j], rtol=1e-9)


def test_lasso_satisfies_optimality_and_rescaling(rows, spark):
    m = gram.moments(rows, "part", "x", "y")
    w, b, got = weights(L.elastic_net(m, L.holdout_design(spark), [0.5], 1.0))
    xt, yt = X[PART != "test"], Y[PART != "test"]
    xc, yc = xt - xt.mean(0), yt - yt.mean(0)
    for j in range(T):
        assert (w[:, j] @ xc.T @ yc[:, j]) == pytest.approx(w[:, j] @ xc.T @ xc @ w[:, j], rel=1e-6)
    block = L.Block(len(xt), xt.sum(0), xt.T @ xt, yt.sum(0), (yt * yt).sum(0), xt.T @ yt)
    raw = L.sparse_fit(block, 0.5, 1.0, np.zeros((D, T)))
    assert (L.sparse_gap(block, raw, 0.5, 1.0) <= 1e-11 * block.syy).all()
    grad = (xc.T @ xc @ raw - xc.T @ yc) / len(xc)
    active = np.abs(raw) > 1e-9
    np.testing.assert_allclose(grad[active], -0.5 * np.sign(raw[active]), atol=1e-6)
    assert (np.abs(grad[~active]) <= 0.5 + 1e-6).all()


@pytest.mark.parametrize("l1", [1.0, 0.5])
def test_sparse_weights_do_not_depend_on_the_block(rows, spark, monkeypatch, l1):
    """All 21 alphas; alone in a block or with all others a target has the same weights."""
    m = gram.moments(rows, "part", "x", "y")
    whole = weights(L.elastic_net(m, L.holdout_design(spark), L.RIDGE_ALPHAS, l1))
    monkeypatch.setattr(L, "TARGET_BLOCK", 1)
    alone = weights(L.elastic_net(m, L.holdout_design(spark), L.RIDGE_ALPHAS, l1))
    np.testing.assert_allclose(whole[0], alone[0], rtol=1e-9, atol=1e-12)
    assert [r["alpha"] for r in whole[2]] == [r["alpha"] for r in alone[2]]


def test_elastic_net_optimality_on_correlated_features():
    """Also with nearly equal features, where plain steps are slow; the gap is a bound, and zero weights stay zero above the largest correlation."""
    g = np.random.default_rng(1)
    base = g.normal(size=(80, 3))
    x = np.hstack([base, base + 1e-3 * g.normal(size=(80, 3))])
    y = x @ g.normal(size=(6, 4)) + g.normal(size=(80, 4))
    f = L.Block(80, x.sum(0), x.T @ x, y.sum(0), (y * y).sum(0), x.T @ y)
    xc, yc = x - x.mean(0), y - y.mean(0)
    for alpha in (1e-4, 0.1):
        w = L.sparse_fit(f, alpha, 0.5, np.zeros((6, 4)))
        grad = (xc.T @ (xc @ w - yc)) / 80 + alpha * 0.5 * w
        on = w != 0
        np.testing.assert_allclose(grad[on], -alpha * 0.5 * np.sign(w[on]), atol=1e-6)
        assert (np.abs(grad[~on]) <= alpha * 0.5 + 1e-6).all()
    top = np.abs(xc.T @ yc).max() / 80
    assert (L.sparse_fit(f, top * 1.001, 1.0, np.zeros((6, 4))) == 0).all()


def test_constrained_and_block_ridge(rows, spark):
    sub = rows.withColumn("y", F.slice("y", 1, 3))
    m = gram.moments(sub, "part", "x", "y")
    w, _, got = weights(L.constrained_ridge(m, L.holdout_design(spark), [2.0], block_size=3))
    xt, yt = X[PART != "test"], Y[PART != "test"][:, :3]
    for i in range(3):
        keep = np.array([f for f in range(D) if f % 3 != i])
        np.testing.assert_allclose(w[keep, i], solve(xt[:, keep], yt[:, [i]], 2.0)[0][:, 0], atol=1e-8)
        assert w[i, i] == 0 and w[3 + i, i] == 0
    regions = {"a": (0, 1), "b": (1, 3)}
    w, _, _ = weights(L.block_ridge(m, L.holdout_design(spark), regions, 3, "selection", [2.0]))
    np.testing.assert_allclose(w[[0, 3], 0], solve(xt[:, [0, 3]], yt[:, [0]], 2.0)[0][:, 0], atol=1e-8)
    assert np.all(w[[1, 2, 4, 5], 0] == 0)


def nipals(x, y, comps):
    """Plain two-block PLS with deflation, the textbook algorithm."""
    sx, sy = x.std(0, ddof=1), y.std(0, ddof=1)
    e, f = (x - x.mean(0)) / sx, (y - y.mean(0)) / sy
    e0, rot, q = e.copy(), [], []
    ws, ps = [], []
    for _ in range(comps):
        u, s, vt = np.linalg.svd(e.T @ f, full_matrices=False)
        w = u[:, 0]
        t = e @ w
        p = e.T @ t / (t @ t)
        q.append(f.T @ t / (t @ t))
        e, f = e - np.outer(t, p), f - np.outer(t, q[-1])
        ws.append(w), ps.append(p)
    ws, ps, q = np.array(ws).T, np.array(ps).T, np.array(q).T
    r = ws @ np.linalg.inv(ps.T @ ws)
    return (r @ q.T) * sy[None, :] / sx[:, None]


def test_pls_matches_deflation(rows, spark):
    m = gram.moments(rows, "part", "x", "y")
    w, _, got = weights(L.pls(m, L.holdout_design(spark), [3]))
    np.testing.assert_allclose(w, nipals(X[PART != "test"], Y[PART != "test"], 3), atol=1e-6)


def test_losses_minimise(rows, spark):
    m = gram.moments(rows, "part", "x", "y")
    w, b, _ = weights(L.loss_regressor(m, L.holdout_design(spark), "mse", l2_grid=[0.0]))
    w0, b0 = solve(X[PART != "test"], Y[PART != "test"], 0.0)
    np.testing.assert_allclose(w, w0, atol=1e-3)
    f = L.Block(50.0, np.zeros(2), np.array([[60.0, 5], [5, 40]]), np.array([10.0]), np.array([90.0]), np.array([[30.0], [12]]))
    for kind in ("mse", "correlation", "combined", "ccc", "ccc_mse"):
        z = np.array([0.3, -0.2, 0.4])

        def val(v):
            return L.loss_value(kind, 0.4, f, v[:2], v[2], 0, f.sxx, f.sxy[:, 0], f.syy[0])

        _, gw, gb = val(z)
        num = [(val(z + h)[0] - val(z - h)[0]) / 2e-6 for h in 1e-6 * np.eye(3)]
        np.testing.assert_allclose(np.append(gw, gb), num, atol=1e-6)


def test_bidirectional_equals_two_single_maps(rows):
    inp = MetricInput(rows.select("id", "x", "y"), key="id", folds=4)
    both = get_metric("bidirectional")(inp, alphas=(1.0, 100.0))
    one = {(r["run"], r["target"]): r["r2"] for r in get_metric("inverse_ridge")(inp, alphas=(1.0, 100.0)).collect()}
    for r in both.where("direction = 'target_to_source'").collect():
        assert r["r2"] == pytest.approx(one[(r["run"], r["target"])], abs=1e-8)


def test_kernel_side_equals_feature_side(rows, spark, monkeypatch):
    from scoreweave.operators import dual

    monkeypatch.setattr(dual, "FEATURE_BLOCK", 4)
    inp = MetricInput(rows.select("id", "x", "y"), key="id", folds=4)
    from scoreweave.plans import metrics

    parts, plan = metrics.parted(inp)
    for shared in (False, True):
        m = gram.moments(parts, "part", "x", "y")
        a = L.ridge_loo(parts, "part", "x", "y", m, plan, (0.5, 20.0, 500.0), shared=shared)
        b = dual.ridge_dual(parts, "id", "part", "x", "y", plan, (0.5, 20.0, 500.0), shared=shared)
        one = {(r["run"], r["target"]): (r["alpha"], r["pearson"], r["r2"]) for r in a.collect()}
        two = {(r["run"], r["target"]): (r["alpha"], r["pearson"], r["r2"]) for r in b.collect()}
        assert one.keys() == two.keys()
        for k in one:
            assert one[k] == pytest.approx(two[k], abs=1e-8)


def test_predictions_reproduce_scores(rows, spark):
    m = gram.moments(rows, "split", "x", "y")
    weights_df = L.ridge(m, L.train_test_design(spark), 3.0)
    test = rows.where("split = 'test'")
    pred = L.predict(test, ["id"], "x", weights_df, D, T, run="0")
    long = L.long_predictions(pred, ["id"], test, "y").toPandas()
    for r in weights_df.collect():
        g = long[long["target"] == r["target"]]
        assert corrected(g["y"], g["p"]) == pytest.approx(r["pearson"], abs=1e-8)


def test_assignment_is_optimal():
    from itertools import permutations

    for seed in range(20):
        r = np.random.default_rng(seed).normal(size=(6, 6))
        best = max(sum(r[i, p[i]] for i in range(6)) for p in permutations(range(6)))
        assert r[np.arange(6), M.assign(r)].sum() == pytest.approx(best)
    assert sorted(M.assign(np.array([[0.9, 0.8], [0.85, 0.1]]))) == [0, 1]
    assert list(M.assign(np.array([[0.9, 0.8], [0.85, 0.1]]))) == [1, 0]
    wide = np.random.default_rng(1).normal(size=(3, 7))
    best = max(sum(wide[i, p[i]] for i in range(3)) for p in permutations(range(7), 3))
    assert wide[np.arange(3), M.assign(wide)].sum() == pytest.approx(best)


def test_transport_margins_and_limit():
    cost = np.random.default_rng(2).uniform(0, 2, size=(5, 8))
    p = M.transport(cost, 0.05, 5000)
    np.testing.assert_allclose(p.sum(1), 1 / 5, atol=1e-6)
    np.testing.assert_allclose(p.sum(0), 1 / 8, atol=1e-9)
    flat = M.transport(cost, 1e4)
    np.testing.assert_allclose(flat, 1 / 40, atol=1e-4)


def rdm(v):
    return 1 - np.corrcoef(v)


@pytest.fixture(scope="module")
def paired(rows):
    a = S.correlation_rows(rows, [], "id", "x")
    b = S.correlation_rows(rows, [], "id", "y")
    return S.pair_up(a, b, [])


def upper():
    iu = np.triu_indices(N, 1)
    return rdm(X)[iu], rdm(Y)[iu]


def test_similarity_without_pairs(paired, spark):
    a, b = upper()
    for got in (S.rdm_similarity(paired, []).first(), S.rdm_similarity_tiled(paired, [], tile=17).first()):
        assert got["corr"] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-8)
        assert got["cosine"] == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-8)


def tau_b(a, b):
    s = np.sign(a[:, None] - a[None, :]) * np.sign(b[:, None] - b[None, :])
    ta, tb = (np.abs(np.sign(v[:, None] - v[None, :])).sum() for v in (a, b))
    return s.sum() / np.sqrt(ta * tb)


@pytest.mark.parametrize("tile,pairs", [(17, S.RANGE_PAIRS), (1024, 50), (40, 300)])
def test_rank_similarities(paired, monkeypatch, tile, pairs):
    """One task or many ranges, the scores are those of the distances themselves."""
    monkeypatch.setattr(S, "RANGE_PAIRS", pairs)
    a, b = upper()
    assert S.rdm_kendall(paired, [], tile=tile).first()["kendall"] == pytest.approx(tau_b(a, b), abs=1e-9)
    rho = pd.Series(a).rank().corr(pd.Series(b).rank())
    assert S.rdm_spearman(paired, [], tile=tile).first()["spearman"] == pytest.approx(rho, abs=1e-9)


@pytest.mark.parametrize("scale", [1.0, 1e-6, 1e7])
def test_ranks_do_not_depend_on_the_scale(spark, monkeypatch, scale):
    """Whole-number distances with many ties, two keys, one side in other units; a key of two items is left out."""
    monkeypatch.setattr(S, "RANGE_PAIRS", 40)
    g = np.random.default_rng(4)
    rows, want = [], {}
    for key, n in (("p", 40), ("q", 25), ("small", 2)):
        x, y = g.integers(0, 3, (n, 2)).astype(float), g.integers(0, 4, (n, 2)).astype(float)
        rows += [(key, i, float(v @ v) * scale**2, (v * scale).tolist(), float(w @ w), w.tolist()) for i, (v, w) in enumerate(zip(x, y))]
        at = np.triu_indices(n, 1)
        want[key] = [((v[:, None] - v[None]) ** 2).sum(-1)[at] for v in (x, y)]
    paired = spark.createDataFrame(rows, "k string, item int, alpha_a double, p_a array<double>, alpha_b double, p_b array<double>")
    for fn, name, brute in ((S.rdm_spearman, "spearman", lambda a, b: pd.Series(a).rank().corr(pd.Series(b).rank())), (S.rdm_kendall, "kendall", tau_b)):
        got = {r["k"]: r[name] for r in fn(paired, ["k"], tile=16).collect()}
        assert got.keys() == {"p", "q"}
        for k, v in got.items():
            assert v == pytest.approx(brute(*want[k]), abs=1e-9)


@pytest.mark.parametrize("name", ["spearman", "kendall"])
def test_rank_similarities_in_rounds(spark, paired, monkeypatch, name):
    """Keys that take rounds of their own, one of them several turns, and small ones parted by hash; no checkpoint holds the distances of both sides."""
    monkeypatch.setattr(S, "RANGE_PAIRS", 200)
    monkeypatch.setattr(S, "ROUND_PAIRS", 700)
    a, b = upper()
    whole = tau_b(a, b) if name == "kendall" else pd.Series(a).rank().corr(pd.Series(b).rank())
    ids = [r["item"] for r in paired.select("item").orderBy("item").collect()]
    two = paired.withColumn("k", F.lit("all")).unionByName(paired.where(F.col("item").isin(ids[:8])).withColumn("k", F.lit("few")))
    rows = []
    kept = S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df: (rows.append(df.columns), kept(df))[1])
    got = {r["k"]: r[name] for r in getattr(S, "rdm_" + name)(two, ["k"], tile=17).collect()}
    assert got["all"] == pytest.approx(whole, abs=1e-9) and set(got) == {"all", "few"}
    assert not any({"x", "y"} <= set(c) for c in rows)


@pytest.mark.parametrize("kind,width", [(float, S.WIDTH), (np.int64, 8)])
def test_packed_values_come_back(kind, width):
    g = np.random.default_rng(5)
    v = S._settled(g.normal(size=999) * 10.0 ** g.integers(-200, 200, 999), np.full(999, 1e-290)) if kind is float else g.integers(-(1 << 40), 1 << 40, 999)
    assert (S._unpacked([S._packed(v[:400], width), S._packed(v[400:], width)], [400, 599], kind, width) == v).all()


def test_concordance_balance_is_brute_force():
    g = np.random.default_rng(3)
    a, b, n = g.integers(0, 40, 2000), g.integers(0, 50, 2000), g.integers(1, 4, 2000)
    want = (np.triu(np.sign(a[:, None] - a[None, :]) * np.sign(b[:, None] - b[None, :]), 1) * n[:, None] * n[None, :]).sum()
    assert S.concordance_balance(a, b, n, leaf=64) == pytest.approx(want)


def test_versa_equals_direct_computation(rows):
    got = S.versa(rows, "id", "x", "y", "split", alphas=(5.0,)).first()
    w, b = solve(X[PART != "test"], Y[PART != "test"], 5.0)
    test = PART == "test"
    iu = np.triu_indices(test.sum(), 1)
    want = np.corrcoef(rdm(X[test] @ w + b)[iu], rdm(Y[test])[iu])[0, 1]
    assert got["corr"] == pytest.approx(want, abs=1e-7)


def test_invariances(rows):
    inp = MetricInput(rows.select("id", "x", "y"), key="id", folds=4)
    scaled = MetricInput(rows.select("id", "x", F.transform("y", lambda v: v * 10).alias("y")).orderBy(F.desc("id")), key="id", folds=4)
    kw = {"alphas": (1.0,)}
    a = {(r["run"], r["target"]): r["pearson"] for r in get_metric("ridge")(inp, **kw).collect()}
    b = {(r["run"], r["target"]): r["pearson"] for r in get_metric("ridge")(scaled, **kw).collect()}
    assert a == pytest.approx(b, abs=1e-8)
    perfect = MetricInput(rows.select("id", "x", F.transform("x", lambda v: 2 * v + 1).alias("y")), key="id", folds=4)
    for r in get_metric("ridge")(perfect, alphas=(1e-10,)).collect():
        assert r["pearson"] == pytest.approx(1, abs=1e-6) and r["r2"] == pytest.approx(1, abs=1e-6)


def test_benchmark_cuts_units_and_goes_on_after_a_failure(rows, spark):
    from scoreweave.plans import runs

    units = spark.createDataFrame([(0, "V1"), (1, "V2"), (2, "V1"), (4, "V1")], "unit int, region string")
    ceilings = spark.createDataFrame([(0, 0.9), (1, 0.9), (2, 0.05), (4, 0.5)], "unit int, ceiling double")
    made = runs.Assembly(rows.select("id", "split", "y"), units, ceilings)
    features = rows.select(F.lit("top").alias("layer"), "id", "x")
    bench = runs.Benchmark("b", "a", ("V1",), "split", ceiling_threshold=0.1, metrics=("ridge", "temporal_ridge", "rsa"),
                           params={"ridge": {"alphas": (7.0,)}, "rsa": {"methods": ("corr",)}}, key="id")
    cut, c = runs.measured(bench, made)
    np.testing.assert_allclose(cut.where("id = 3").first()["y"], Y[3, [0, 4]])
    assert {(r["target"], r["ceiling"]) for r in c.collect()} == {(0, 0.9), (1, 0.5)}
    with pytest.warns(UserWarning, match="temporal_ridge failed"):  # its n_times is not given
        got = {(r["metric"], r["stat"]): r["value"] for r in runs.run_benchmark(bench, features, made, "m").collect()}
    train, test = PART != "test", PART == "test"
    w, b = solve(X[train], Y[train][:, [0, 4]], 7.0)
    p = X[test] @ w + b
    s = [corrected(Y[test][:, j], p[:, k]) for k, j in enumerate((0, 4))]
    assert got["ridge", "final_unceiled_pearson"] == pytest.approx(np.median(s), abs=1e-8)
    assert got["ridge", "final_pearson"] == pytest.approx(np.median([s[0] / 0.9, s[1] / 0.5]), abs=1e-8)
    iu = np.triu_indices(test.sum(), 1)
    want = np.corrcoef(rdm(X[test])[iu], rdm(Y[test][:, [0, 4]])[iu])[0, 1]
    assert got["rsa", "final_corr"] == pytest.approx(want, abs=1e-6)
    with pytest.raises(ValueError, match="no unit"):
        runs.measured(runs.Benchmark("b", "a", ("V9",)), made)
    with pytest.raises(KeyError):
        runs.run_benchmark(runs.Benchmark("b", "a", metrics=("nothing",)), features, made, "m")
