"""Classifiers against plain Newton in numpy, the number of scans, and odd rows."""

import numpy as np
import pytest

from scoreweave.functions.registry import MetricInput, get_metric
from scoreweave.operators import classify as C


def frame(spark, x, y, start=0):
    rows = [(start + i, a.tolist(), None if b is None else float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x array<double>, label double").repartition(3)


def objective(w, x, y, classes, c):
    z = x @ w[:-1] + w[-1]
    if len(classes) == 2:
        z = np.hstack([np.zeros((len(x), 1)), z])
    z = z - z.max(1, keepdims=True)
    return (np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), np.searchsorted(classes, y)]).sum() + (w[:-1] ** 2).sum() / (2 * c)


@pytest.mark.parametrize("kinds", [2, 4])
def test_fit_is_the_least_loss(spark, kinds):
    """No nearby weights have a smaller loss, in the units of standardised inputs."""
    g = np.random.default_rng(kinds)
    x = g.normal(size=(150, 3)) * [1.0, 100.0, 0.01] + [0.0, 1e4, 5.0]
    y = (g.normal(size=(150, kinds)) + (x - x.mean(0)) / x.std(0) @ g.normal(size=(3, kinds))).argmax(1) * 2 + 1
    fit = C.fit_classifier(frame(spark, x, y), "id", "x", "label", [3.0])
    z = (x - x.mean(0)) / x.std(0)
    np.testing.assert_allclose(fit.mean, x.mean(0)), np.testing.assert_allclose(fit.scale, x.std(0))
    least = objective(fit.w, z, y, fit.classes, 3.0)
    assert least == pytest.approx(fit.loss, rel=1e-9)
    for _ in range(200):
        assert objective(fit.w + g.normal(size=fit.w.shape) * 1e-3, z, y, fit.classes, 3.0) >= least - 1e-9
    out = C.classify(frame(spark, x, y), fit, ["id", "label"], "x").collect()
    assert all(abs(sum(r["probs"]) - 1) < 1e-12 and r["pred"] == fit.classes[int(np.argmax(r["probs"]))] for r in out)


def test_scans_and_choice(spark, monkeypatch):
    """Seven penalties and five folds take at most 15 scans, and the first best penalty is chosen by right answers on unseen folds."""
    g = np.random.default_rng(1)
    x = g.normal(size=(200, 4))
    y = (x @ [1.0, -2.0, 0.5, 0.0] + g.normal(size=200) > 0).astype(float)
    df = frame(spark, x, y)
    scans = []
    scan = C._scan
    monkeypatch.setattr(C, "_scan", lambda fits, own: scans.append(len(fits)) or scan(fits, own))
    rows = C.kfold(df, "id", 5, out="part").selectExpr("part", "x", "label AS y").cache()
    fits = C.newton(rows, C.candidates(rows, range(5), C.C_GRID))
    assert len(scans) + 2 <= 15 and scans[0] == 35
    local = [(r["part"], np.array(r["x"]), r["y"]) for r in rows.collect()]
    right = np.zeros(7)
    for i, f in enumerate(fits):
        left = i % 5
        right[i // 5] += sum(f.predict(v[None])[0] == t for p, v, t in local if p == left)
        own = np.array([v for p, v, _ in local if p != left])
        np.testing.assert_allclose(f.mean, own.mean(0), atol=1e-12)
        z, t = (own - f.mean) / f.scale, np.array([t for p, _, t in local if p != left])
        grad = (1 / (1 + np.exp(-(z @ f.w[:-1, 0] + f.w[-1, 0]))) - t) @ np.hstack([z, np.ones((len(z), 1))]) + np.append(f.w[:-1, 0] / f.c, 0)
        assert np.abs(grad).max() < 1e-5
    assert np.array(C._hits(rows, fits)).reshape(7, 5).sum(1).tolist() == right.tolist()
    monkeypatch.setattr(C, "TASK_BYTES", 1)  # one candidate after another
    assert C.fit_classifier(df, "id", "x", "label", C.C_GRID[2:5]).c == C.C_GRID[2:5][int(right[2:5].argmax())]


def test_odd_rows(spark):
    """Separable classes, a flat feature, one class only, NULL labels and entries that are no numbers, no rows."""
    x = np.hstack([np.linspace(-1, 1, 40)[:, None], np.full((40, 1), 2.0)])
    y = (x[:, 0] > 0).astype(float)
    odd = frame(spark, np.array([[np.nan, 1.0], [np.inf, 1.0]]), [1.0, 0.0], 100).unionByName(frame(spark, x[:2], [None, None], 200))
    fit = C.fit_classifier(frame(spark, x, y).unionByName(odd), "id", "x", "label", [100.0])
    assert fit.n == 40 and fit.w[1, 0] == pytest.approx(0, abs=1e-9) and (fit.predict(x) == y).all() and np.isfinite(fit.w).all()
    one = C.fit_classifier(frame(spark, x, np.full(40, 7.0)), "id", "x", "label")
    assert (one.predict(x) == 7).all()
    with pytest.raises(ValueError, match="no rows"):
        C.fit_classifier(odd, "id", "x", "label")


def test_agreement_with_people_by_name(spark):
    """Separable classes: the choices are the labels, so kappa and distances follow from the human table alone."""
    rows = spark.createDataFrame([(i, "test" if i % 2 else "train", [float(i % 4 > 1) * 4 - 2], int(i % 4 > 1)) for i in range(80)], "stimulus_id long, split string, x array<double>, label int")
    human = [(i, "s", "p", int(i % 4 > 1) if i % 8 != 1 else 1, 0) for i in range(80)]
    people = spark.createDataFrame(human, "stimulus long, scenario string, participant string, response int, ord int")
    inp = MetricInput(rows, split="split")
    got = get_metric("physion_contact_prediction")(inp, human=people).first()
    # 40 test rows, half of each class; people say 1 for 10 of the 20 rows of class 0
    assert got["accuracy"] == 1 and got["n_scenarios"] == 1 and got["center"] == pytest.approx(0.5)
    place = get_metric("physion_placement_detection")(inp, human=people.withColumnRenamed("response", "choice")).first()
    assert place["accuracy_model_gt"] == 1 and place["accuracy_model_human"] == pytest.approx(0.75) and place["chebyshev_distance_human_gt"] == pytest.approx(0.25)


def test_a_scan_hands_on_one_candidate_at_a_time():
    """Sums of two batches, one row each: no more than one candidate's Hessian is copied at once."""
    import pyarrow as pa

    from scoreweave.functions.matrices import list_column
    from scoreweave.operators import classify as K

    g = np.random.default_rng(3)
    x, y, part = g.normal(size=(30, 4)), np.arange(30) % 3.0, np.arange(30) % 2
    fits = {i: K.Linear(1.0, frozenset({0, 1} - {i}), np.arange(3.0), np.zeros(4), np.ones(4), 15, np.zeros((5, 3))) for i in (0, 1)}
    batch = lambda at: pa.RecordBatch.from_arrays([pa.array(part[at]), list_column(x[at]), pa.array(y[at])], ["part", "x", "y"])
    got = list(K._scan(fits, True)(iter([batch(slice(0, 11)), batch(slice(11, 30))])))
    assert [b.num_rows for b in got] == [1, 1]
    for b in got:
        r = b.to_pylist()[0]
        loss, grad, hess = K._sums(fits[r["i"]], x[part != r["i"]], y[part != r["i"]])
        assert np.allclose(r["loss"], loss) and np.allclose(r["g"], grad) and np.allclose(r["h"], hess.ravel())
