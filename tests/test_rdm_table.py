"""The table of distances: pairs leave packed rows, keys are read once per packed row, values are rounded as decimals would be."""

import numpy as np

from scoreweave.functions.columns import r6, r6_of
from scoreweave.operators import similarity as S


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rdm_keys_are_read_once_per_tile_row(spark):
    """Pairs are exploded from packed rows after the key is read, in item order, for every tile size."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(23, 6))
    rows = spark.createDataFrame([(int(i) % 2, int(i), v.tolist()) for i, v in enumerate(x)], "label int, item long, x array<double>")
    want = {(i, j): 1 - np.corrcoef(x[i], x[j])[0, 1] for i in range(23) for j in range(i + 1, 23) if i % 2 == j % 2}
    for tile in (4, 100):
        out = S.rdm(S.correlation_rows(rows, ["label"], "item", "x"), ["label"], tile=tile)
        got = {(r["i"], r["j"]): r["dist"] for r in out.collect()}
        assert got.keys() == want.keys() and out.count() == len(want)
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    plan = plan_of(out)
    assert plan.index("posexplode") < plan.index("from_json") and "InArrow" in plan  # the key is read below the explode


def test_large_keys_are_copied_few_times(spark, monkeypatch):
    """Tiles of a large key grow, and their distances leave them in strips: fewer copies of an item, the same pairs."""
    monkeypatch.setattr(S, "WIDEST", 40, raising=False)
    monkeypatch.setattr(S, "BLOCKS", 3, raising=False)
    monkeypatch.setattr(S, "BATCH_PAIRS", 100, raising=False)
    x = np.random.default_rng(4).normal(size=(110, 6))
    rows = spark.createDataFrame([(i > 9, i, v.tolist()) for i, v in enumerate(x)], "k boolean, item long, x array<double>")
    copies, dealt = [], S.tiles
    monkeypatch.setattr(S, "tiles", lambda *a: (copies.append(dealt(*a)), copies[-1])[1])
    got = {(r["i"], r["j"]): r["dist"] for r in S.rdm(S.correlation_rows(rows, ["k"], "item", "x"), ["k"], tile=4).collect()}
    want = 1 - np.corrcoef(x)
    assert got.keys() == {(i, j) for j in range(110) for i in range(j) if (i > 9) == (j > 9)}
    assert all(abs(d - want[k]) < 1e-12 for k, d in got.items())
    assert copies[0].count() == 10 * 3 + 100 * 3


def test_double_rounding_is_the_decimal_one(spark):
    v = [0.0, -1e-17, 1.9999994, 2.0, 0.1234565, -0.3, -4e-7, -6e-7, 1e8 + 1 / 3, *np.random.default_rng(1).uniform(-2, 2, 2000).tolist()]
    rows = spark.createDataFrame([(x,) for x in v], "x double").select(r6("x").alias("a"), r6_of("x").alias("b")).collect()
    assert all(repr(r["a"]) == repr(r["b"]) for r in rows)
