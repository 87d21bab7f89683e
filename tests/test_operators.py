"""Hand cases, edge cases, storage and streams."""

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scoreweave.functions import columns as C
from scoreweave.functions.ordering import grouped_median, hash_row_number, ordered_row_number, range_running_sum, stable_hash
from scoreweave.operators import align, behaviour, prep, reliability, scoring, splits, transforms, tuning, windows
from scoreweave.plans import planning, runs
from scoreweave.sources import store, tables, text


def one(spark, rows, fn):
    df = spark.createDataFrame(rows, "y double, p double")
    return df.agg(fn("y", "p").alias("v")).first()["v"]


def test_a_ceiling_on_the_threshold_does_not_pass_by_rounding(spark):
    """0.1 + 0.2 is 0.3 here in whatever order it was added up; each side has its own threshold."""
    c = spark.createDataFrame([("on", 0.1 + 0.2), ("above", 0.31), ("below", 0.29)], "unit string, ceiling double")
    t = spark.createDataFrame([("on", 0.7), ("above", 0.1 + 0.7), ("below", 0.9)], "unit string, ceiling double")
    names = lambda df: sorted(r["unit"] for r in df.collect())
    assert names(prep.mask_by_ceiling(c.select("unit"), c, 0.3)) == ["above"]
    assert names(prep.mask_by_ceiling(c.select("unit"), c, 0.3, inclusive=True)) == ["above", "on"]
    assert names(prep.mask_by_ceiling(c.select("unit"), c, 0.2, test_ceilings=t, test_threshold=0.8)) == ["below"]
    assert names(prep.mask_by_ceiling(c.select("unit"), c, 0.2, inclusive=True, test_ceilings=t, test_threshold=0.8)) == ["above", "below"]


def test_corrected_pearson_guards(spark):
    f = C.corrected_pearson
    assert one(spark, [(2.0, 2.0), (2.0, 2.0)], f) == 1.0
    assert one(spark, [(2.0, 1.0), (2.0, 5.0)], f) == 0.0
    assert one(spark, [(2.0, 2.0)], f) is None
    assert one(spark, [(0.0, 1.0), (1.0, 0.0)], f) is None  # r = -1
    assert one(spark, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], f) == pytest.approx(1.0)


def test_r2_and_concordance(spark):
    rows = [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)]
    assert one(spark, rows, C.r_squared) == 1.0
    assert one(spark, [(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], C.r_squared) == 0.0
    assert one(spark, rows, C.concordance) == pytest.approx(2 / 3, abs=1e-6)
    assert one(spark, [(2.0, 1.0), (2.0, 3.0)], C.r_squared_guarded) == 0.0


def test_kappa_edges(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("b", 1, 1), ("b", 1, 1)], "k string, y int, p int")
    got = {r["k"]: r["kappa"] for r in scoring.cohen_kappa(df, ["k"], "y", "p").collect()}
    assert got == {"a": 1.0, "b": None}


def test_reliability_hand_cases(spark):
    same = [(1, s, r, float(s * s)) for s in range(5) for r in range(4)]
    t = spark.createDataFrame(same, "unit int, stimulus int, rep int, value double")
    assert reliability.split_half(t, 5).first()["consistency"] == pytest.approx(1.0)
    two = [(1, s, r, float(v)) for s, (a, b) in enumerate([(1, 2), (2, 1), (3, 4), (5, 3)]) for r, v in enumerate((a, b))]
    t = spark.createDataFrame(two, "unit int, stimulus int, rep int, value double")
    r = pd.Series([1, 2, 3, 5]).corr(pd.Series([2, 1, 4, 3]))
    assert reliability.one_vs_all(t).first()["consistency"] == pytest.approx(2 * r / (1 + r))


def test_split_half_copies_no_trial(spark):
    """Cells that lack a half, NULL values, a flat unit; against pandas split by split."""
    rng = random.Random(3)
    rows = [(u, s, r, None if rng.random() < 0.1 else (7.25 if u == 2 else rng.gauss(s, 2.0))) for u in range(3) for s in range(9) for r in range(6) if rng.random() < 0.6]
    t = spark.createDataFrame(rows, "unit int, stimulus int, rep int, value double")
    halves = {(r["split"], r["rep"]): r["half"] for r in reliability.trial_halves(t, 8, 42).collect()}
    got = {(r["unit"], r["split"]): r["consistency"] for r in reliability.split_half(t, 8, per_split=True).collect()}
    pdf, want = pd.DataFrame(rows, columns=["unit", "stimulus", "rep", "value"]), {}
    for split in range(8):
        pdf["half"] = [halves[split, r] for r in pdf["rep"]]
        for unit, g in pdf.dropna().groupby("unit"):
            cell = g.pivot_table(index="stimulus", columns="half", values="value").dropna()
            r = 0.0 if unit == 2 else cell[1].corr(cell[2])
            want[unit, split] = 2 * r / (1 + r)
    assert got == pytest.approx(want, abs=1e-9)
    mean = {r["unit"]: r["consistency"] for r in reliability.split_half(t, 8).collect()}
    assert mean[0] == pytest.approx(sum(v for (u, _), v in want.items() if u == 0) / 8)


def test_circular_variance_hand_cases(spark):
    peak = [(1, a * 22.5, 5.0 if a == 3 else 0.0) for a in range(8)] + [(2, a * 22.5, 4.0) for a in range(8)]
    df = spark.createDataFrame(peak, "unit int, angle double, response double")
    got = {r["unit"]: r["cv"] for r in tuning.circular_variance(df).collect()}
    assert got[1] == pytest.approx(0, abs=1e-9) and got[2] == pytest.approx(1, abs=1e-9)


def test_bins_edges_and_cumulative_text(spark):
    rows = [("s", 0, "a", 0.0, 1.0), ("s", 1, "b", 1.5, 2.5), ("s", 2, "c", 6.5, 7.0)]
    df = spark.createDataFrame(rows, "story string, seq int, word string, t0 double, t1 double")
    got = [r["text"] for r in windows.cumulative_text(df, "story", 2.0).orderBy("bin").collect()]
    assert got == ["a", "a b", "a b", "a b c"]  # the midpoint 2.0 is in bin 1; bin 2 is empty


def test_cumulative_text_spans_buckets(spark, monkeypatch):
    rows = [("s", i, f"w{i}", float(i), float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "story string, seq int, word string, t0 double, t1 double")
    monkeypatch.setattr(windows, "TEXT_BUCKET", 4)
    got = [r["text"] for r in windows.cumulative_text(df, "story", 2.0).orderBy("bin").collect()]
    assert got[-1] == " ".join(f"w{i}" for i in range(30)) and len(got) == 15


def test_lag_skips_short_stories(spark):
    f = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 1), ("b", 2)], "story string, t int").withColumn("x", F.col("t"))
    out = align.lag_align(f, f.withColumnRenamed("x", "y"), "story", "t", 2).collect()
    assert [(r["story"], r["feature_t"], r["response_t"]) for r in out] == [("b", 0, 2)]


def test_group_folds_take_the_largest_first():
    folds = dict(splits.group_folds([("a", 5), ("b", 4), ("c", 3), ("d", 2), ("e", 1)], 2))
    by = {f: sorted(g for g in folds if folds[g] == f) for f in (0, 1)}
    assert by == {0: ["a", "d", "e"], 1: ["b", "c"]}
    with pytest.raises(ValueError):
        splits.group_folds([("a", 5)], 3)


def test_group_folds_by_sizes():
    """Folds of whole runs of equal groups are those of the rule taken group by group."""
    rnd = random.Random(4)
    for _ in range(300):
        k, most = rnd.randint(2, 6), rnd.choice([2, 5, 40])
        counts = [(f"g{i:03}", rnd.choice([1, 1, 1, rnd.randint(1, most), 3 * most])) for i in range(rnd.randint(k, 60))]
        sizes = sorted(Counter(n for _, n in counts).items(), reverse=True)
        got = []
        for (_, c), (_, rounds) in zip(sizes, splits.size_folds(sizes, k)):
            for (start, folds), (end, _) in zip(rounds, [*rounds[1:], (c, None)]):
                got += [folds[i % len(folds)] for i in range(end - start)]
        assert got == [f for _, f in splits.group_folds(counts, k)]


def test_grouped_folds_have_one_rule(spark, monkeypatch):
    """A hot group and more groups than once went to the driver; a NULL group; fewer groups than folds."""
    monkeypatch.setattr(splits, "MAX_GROUPS", 5, raising=False)
    rows = [("hot",)] * 40 + [(None,)] * 7 + [(f"g{i}",) for i in range(60)] + [("h",)] * 3 + [("i",)] * 3
    got = splits.group_kfold(spark.createDataFrame(rows, "g string"), "g", 4).distinct().collect()
    want = dict(splits.group_folds(list(Counter(g for g, in rows).items()), 4))
    assert {r["g"]: r["fold"] for r in got} == want and len(got) == len(want)
    few = splits.group_kfold(spark.createDataFrame([("a",), ("a",), ("b",)], "g string"), "g", 4).collect()
    assert sorted((r["g"], r["fold"]) for r in few) == [("a", 0), ("a", 0), ("b", 1)]
    with pytest.raises(ValueError):
        splits.group_kfold(spark.createDataFrame([("a",)], "g string"), "g", 4)


@pytest.mark.parametrize("kind", ["sparse", "dense"])
def test_projection_of_rows_with_one_key(spark, monkeypatch, kind):
    """Joined or sent to the tasks, every row has its own projection."""
    rows = [(1, [1.0, 2.0, 3.0, 4.0]), (1, [5.0, -1.0, 0.0, 2.0]), (2, [0.0, 1.0, 1.0, 0.5]), (None, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id int, vec array<double>")
    project = lambda: sorted((str(r["id"]), [round(x, 9) + 0.0 for x in r["vec"]]) for r in transforms.random_project(df, ["id"], "vec", 4, 3, kind).collect())
    sent = project()
    monkeypatch.setattr(transforms, "MATRIX_WEIGHTS", 1)
    assert project() == sent and len(sent) == 4


@pytest.mark.parametrize("n,k", [(3, 5), (10, 5), (103, 10)])
def test_folds_partition_the_rows(spark, n, k):
    df = spark.range(n).withColumn("lab", F.col("id") % 2)
    for out in (splits.kfold(df, "id", k), splits.stratified_kfold(df, "id", "lab", k)):
        got = out.collect()
        assert sorted(r["id"] for r in got) == list(range(n))
        assert all(0 <= r["fold"] < k for r in got)
    sizes = [r["count"] for r in splits.kfold(df, "id", k).groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    lab = splits.stratified_kfold(df, "id", "lab", k).groupBy("lab", "fold").count().toPandas()
    assert (lab.groupby("lab")["count"].agg(lambda c: c.max() - c.min()) <= 1).all()


def test_bucketed_ordering_equals_windows(spark):
    df = spark.range(5000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)).withColumn("v", (F.col("id") * 37) % 101)
    h = df.withColumn("h", stable_hash("id"))
    got = hash_row_number(h, ["k"], "h", "id", "rn").toPandas()
    want = got.sort_values(["k", "h"]).groupby("k").cumcount() + 1
    assert (got.sort_values(["k", "h"])["rn"] == want).all()
    got = ordered_row_number(df, ["k"], ["v", "id"], "rn").toPandas().sort_values(["k", "v", "id"])
    assert (got["rn"] == got.groupby("k").cumcount() + 1).all()
    got = range_running_sum(df, ["k"], "id", "v", 100, "run").toPandas().sort_values(["k", "id"])
    assert (got["run"] == got.groupby("k")["v"].cumsum()).all()
    med = grouped_median(df, ["k"], "v", "m").toPandas().set_index("k")["m"]
    assert (med.sort_index() == got.groupby("k")["v"].median().sort_index()).all()


def test_median_small_groups_and_nulls(spark):
    rows = [("a", 1.0), ("a", None), ("b", 1.0), ("b", 4.0), ("c", None)]
    got = {r["k"]: r["m"] for r in grouped_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", "m").collect()}
    assert got == {"a": 1.0, "b": 2.5}


def test_missing_and_infinite_values(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, 4.0), (1, float("inf"))], "k int, value double")
    assert [r["v"] for r in df.select(C.finite_or_zero("value").alias("v")).collect()] == [0.0, 4.0, 1e6]
    nan_only = df.where(~(F.col("value") > 1e300))
    assert reliability.average_repetition(nan_only, ["k"]).first()["value"] == 4.0


def test_ceiling_and_rollup_numbers(spark):
    s = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)], "fold int, unit int, score double")
    c = spark.createDataFrame([(0, 2.0), (1, 2.0)], "unit int, ceiling double")
    out = scoring.rollup(s, c, [], "fold", "unit").first()
    assert out["final_unceiled"] == 2.5 and out["final"] == 1.25
    partial = align.apply_ceiling(s, c.where("unit = 0"), ["unit"])
    assert partial.where("unit = 1 and ceiled_score is not null").count() == 0


def test_mixed_behaviour_raises(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, None)], "gt double, b double")
    with pytest.raises(PySparkException):
        prep.normalise_targets(df, "gt", "b").collect()
    assert prep.normalise_targets(df.withColumn("b", F.lit(None).cast("double")), "gt", "b").count() == 2


def test_region_errors_and_ids(spark):
    with pytest.raises(ValueError):
        prep.region_predicate("nowhere", ["a"], ["b"])
    df = spark.createDataFrame([("a/b/clip_img.mp4.x",), ("clip",)], "p string")
    assert [r[0] for r in df.select(prep.norm_id("p")).collect()] == ["clip", "clip"]


def test_csv_and_trials(spark, tmp_path):
    (tmp_path / "s.csv").write_text("stimulus_id,filename,train,extra,label,contacts,intra_generalizability\nx1,a/b.mp4,1,z,0.5,-1,0\n")
    r = tables.read_stimuli(spark, str(tmp_path / "s.csv")).first()
    assert (r["filename"], r["train"], r["label"], r["contacts"]) == ("a/b.mp4", 1, 0.5, -1.0)
    spark.createDataFrame([("s", 3, 1)], "stimulus_id string, choice int, responseBool int").write.parquet(str(tmp_path / "t"))
    assert tables.read_trials(spark, str(tmp_path / "t"), "placement").first()["target"] == 3
    assert tables.read_trials(spark, str(tmp_path / "t"), "contact").first()["target"] == 1


def test_path_labels(spark):
    df = spark.createDataFrame([("d/img_22.5deg_2.0cy_0.25phase_bw.jpg",), ("img_0deg_1cy_0phase_red.jpg",)], "p string")
    got = [(r["angle"], r["sf"], r["phase"], r["colour"]) for r in text.label_from_path(df, "p").collect()]
    assert got == [(22.5, 2.0, 0.25, 0.0), (0.0, 1.0, 0.0, 1.0)]


def test_store_appends_and_reuses(spark, tmp_path):
    path = str(tmp_path / "scores")
    rows = spark.createDataFrame([("m", "l", "b", "ridge", "final", 0.5)], "model string, layer string, benchmark string, metric string, stat string, value double")
    store.append_scores(rows, path)
    store.append_scores(rows.withColumn("value", F.lit(0.7)), path)
    assert store.read_scores(spark, path).count() == 2
    assert store.latest_scores(spark, path).first()["value"] == 0.7
    calls = []

    def build():
        calls.append(1)
        return rows

    for _ in range(2):
        assert store.materialise(spark, build, str(tmp_path / "prepared")).count() == 1
    assert len(calls) == 1


def test_planning(spark):
    names = spark.createDataFrame([("V1Gratings",), ("LeBel2023TRUTS01",), ("LeBel2023UTS01",), ("Other",)], "name string")
    got = planning.compatible_metrics(names).toPandas()
    assert list(got[got["name"] == "LeBel2023TRUTS01"].sort_values("position")["metric"]) == ["ridge", "temporal_rsa"]
    assert "orientation_selectivity" in set(got[got["name"] == "V1Gratings"]["metric"])
    ok = {r["name"]: r["compatible"] for r in planning.is_compatible(names, "pls").collect()}
    assert ok == {"V1Gratings": True, "LeBel2023TRUTS01": False, "LeBel2023UTS01": True, "Other": True}


def test_user_scorer_and_hook(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 2.0, 4.0)], "unit int, y double, p double")
    out = scoring.score(df, ["unit"], {"mae": lambda y, p: F.avg(F.abs(y - p))}).first()
    assert out["mae"] == 1.5


def test_benchmark_configuration_scores(spark):
    rows = runs.vector_rows(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"), "vec_id", "embedding", 32)
    from scoreweave.functions.registry import MetricInput

    b = runs.register_benchmark(runs.Benchmark("demo", "embeddings", metrics=("torch_ridge",)))
    assert runs.BENCHMARKS["demo"] is b
    table = runs.score_run(MetricInput(rows, key="vec_id", folds=3), b.metrics[0], "m", "l", b.name)
    assert {r["stat"] for r in table.collect()} == {"final_pearson", "final_unceiled_pearson", "final_r2", "final_unceiled_r2"}


def test_resample_pads_with_the_last_item(spark):
    df = spark.createDataFrame([("a", i, f"f{i}") for i in range(5)], "k string, i int, item string")
    got = prep.resample_sequence(df, "k", "i", fps=2.0, target_fps=1.0, seconds=5).orderBy("slot").collect()
    assert [r["item"] for r in got] == ["f0", "f2", "f4", "f4", "f4"]


def test_grid_distances(spark):
    df = spark.createDataFrame([(0, 17), (5, 7)], "a int, b int")
    got = [tuple(r) for r in df.select(behaviour.chebyshev("a", "b"), behaviour.euclidean("a", "b")).collect()]
    assert got[0] == (1.0, pytest.approx(2**0.5)) and got[1] == (2.0, 2.0)


def test_null_groups_keep_their_rows(spark):
    from scoreweave.functions.ordering import grouped_median, ordered_row_number
    from scoreweave.operators import splits

    rows = [(i, None if i % 4 == 0 else "ab"[i % 2], float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, label string, v double")
    held = splits.holdout(df, "k", 0.2, "label")
    assert held.count() == 40 and held.where("label is null and is_val").count() == 2
    folds = splits.stratified_kfold(df, "k", "label", 5).where("label is null").groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [2] * 5
    assert ordered_row_number(df, ["label"], ["v"], "rn").where("label is null").count() == 10
    medians = {r["label"]: r["m"] for r in grouped_median(df, ["label"], "v", "m").collect()}
    assert medians == {None: 18.0, "a": 20.0, "b": 20.0}


def test_store_keeps_other_models_and_rebuilds_broken_tables(spark, tmp_path):
    from scoreweave.sources import store

    for model in ("m1", "m2", "m2"):
        store.save_features(spark.range(3).selectExpr("id", f"'{model}' as model", "'l' as layer"), f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f").count() == 6
    (tmp_path / "t").mkdir()
    assert store.materialise(spark, lambda: spark.range(5), f"{tmp_path}/t").count() == 5
    assert store.materialise(spark, lambda: spark.range(9), f"{tmp_path}/t").count() == 5
