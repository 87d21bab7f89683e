"""Linear maps, classifiers and whole scoring runs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..functions.registry import MetricInput, get_metric
from ..operators import linear as L
from ..operators.align import lag_align
from ..operators.gram import moments
from ..operators.prep import kept_features
from ..operators.regions import spatial_traces
from ..operators.splits import kfold
from ..operators.tiles import gram_tiles, ridge_subsampled, ridge_tiles
from ..plans import runs
from ..plans.metrics import parted
from ..sources.store import latest_scores
from . import query
from .views import PAIRS, R, halves, scratch, stories, table, vectors

FOLD_SQL = """f AS (SELECT vec_id, ntile(5) OVER (ORDER BY md5('42:' || vec_id)) - 1 AS fold FROM embeddings)"""


def metric_input(spark, d, folds=10, **kw) -> MetricInput:
    return MetricInput(halves(spark, d), key="vec_id", folds=folds, **kw)


def per_target(df):
    """Fold-by-target scores in report form."""
    return df.select("run", F.col("target").cast("long").alias("target"), "alpha", r6("pearson").alias("pearson"), r6("r2").alias("r2"))


@query(f"""WITH {PAIRS}, {FOLD_SQL}, a AS (SELECT vec_id, unit AS i, p AS x FROM pairs),
 b AS (SELECT vec_id, unit AS j, p AS r FROM pairs UNION ALL SELECT vec_id, unit + 32, y FROM pairs)
 SELECT fold::VARCHAR AS part, i, j, count(*) AS n, {R('covar_pop(x, r) * count(*)', 5)} AS value FROM a JOIN b USING (vec_id) JOIN f USING (vec_id) GROUP BY 1, 2, 3""")
def fold_moments(spark, d):
    rows = kfold(halves(spark, d), "vec_id", 5).withColumn("part", F.col("fold").cast("string"))
    m = moments(rows, "part", "x", "y", parts=5)
    sx = m.df.where(F.col("g") < m.dim_x).select("part", F.col("g").alias("i"), F.col("s").alias("sx"))
    long = m.df.select("part", F.col("g").alias("j"), "n", "s", F.posexplode("xr").alias("i", "v")).join(sx, ["part", "i"])
    return long.select(
        "part", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "n",
        r6(F.col("v") - F.col("sx") * F.col("s") / F.col("n"), 5).alias("value"))


# Two features make ridge solvable in SQL, which checks the whole path: scan, roles, solve, score.
TWO = """d AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'test' ELSE 'train' END AS split, l_linestatus = 'O' AS v, l_quantity AS a, l_discount * 100 AS b,
  unnest([l_extendedprice / 1000, l_tax * 100]) AS y, unnest([0, 1]) AS target FROM lineitem)"""


def sums(name: str, where: str, src: str = "d") -> str:
    return f"""{name} AS (SELECT target, count(*)::DOUBLE AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb,
  covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS by_, var_pop(y) * count(*) AS yy FROM {src} WHERE {where} GROUP BY 1)"""


def solve2(alpha: str) -> str:
    det = f"((aa + {alpha}) * (bb + {alpha}) - ab * ab)"
    return f"((bb + {alpha}) * ay - ab * by_) / {det} AS wa, ((aa + {alpha}) * by_ - ab * ay) / {det} AS wb"


def two_features(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        F.when(F.col("l_returnflag") == "R", "test").otherwise("train").alias("split"), (F.col("l_linestatus") == "O").alias("v"),
        F.array(F.col("l_quantity"), F.col("l_discount") * 100).alias("x"), F.array(F.col("l_extendedprice") / 1000, F.col("l_tax") * 100).alias("y"))


FIT_SQL = """te AS (SELECT target, 1 - sum(pow(y - (my + wa * (a - ma) + wb * (b - mb)), 2)) / (var_pop(y) * count(*)) AS r2,
  covar_pop(y, wa * a + wb * b) / sqrt(var_pop(y) * var_pop(wa * a + wb * b)) AS r FROM w JOIN d USING (target) WHERE split = 'test' GROUP BY 1)
 SELECT target::BIGINT AS target, alpha::DOUBLE AS alpha, {wa} AS w0, {wb} AS w1, {b} AS b, {r2} AS r2, {sb} AS pearson FROM w JOIN te USING (target)""".format(
    wa=R("wa"), wb=R("wb"), b=R("my - wa * ma - wb * mb"), r2=R("r2"), sb=R("2 * r / (1 + r)"))


def fitted(df):
    return df.select(
        F.col("target").cast("long").alias("target"), "alpha", r6(F.col("w")[0]).alias("w0"), r6(F.col("w")[1]).alias("w1"), r6("b").alias("b"),
        r6("r2").alias("r2"), r6("pearson").alias("pearson"))


@query(f"WITH {TWO}, {sums('s', "split = 'train'")}, w AS (SELECT *, 1000.0 AS alpha, {solve2('1000')} FROM s), {FIT_SQL}")
def ridge_fixed(spark, d):
    rows = two_features(spark, d)
    m = moments(rows, "split", "x", "y", parts=2)
    return fitted(L.ridge(m, L.train_test_design(spark), 1000.0))


LOO_ALPHAS = (1.0, 1e4, 1e6)
KEPT = "ab"[kept_features(2, 1)[0]]  # the feature that a search on one of two features takes
KEPT_Y = {"a": "ay", "b": "by_"}[KEPT]


@query(f"""WITH {TWO}, {sums('s', "split = 'train'")}, al AS (SELECT unnest([1.0, 1e4, 1e6]::DOUBLE[]) AS alpha, unnest([0, 1, 2]) AS pos),
 g AS (SELECT s.*, alpha, pos, {solve2('alpha')}, (bb + alpha) / ((aa + alpha) * (bb + alpha) - ab * ab) AS ia, (aa + alpha) / ((aa + alpha) * (bb + alpha) - ab * ab) AS ib,
  -ab / ((aa + alpha) * (bb + alpha) - ab * ab) AS ic FROM s, al),
 e AS (SELECT g.target, pos, avg(pow((d.y - my - wa * (d.a - ma) - wb * (d.b - mb)) / (1 - 1 / n - (ia * pow(d.a - ma, 2) + ib * pow(d.b - mb, 2) + 2 * ic * (d.a - ma) * (d.b - mb))), 2)) AS err
  FROM g JOIN d USING (target) WHERE split = 'train' GROUP BY 1, 2),
 best AS (SELECT target, min_by(pos, err) AS pos FROM e GROUP BY 1), w AS (SELECT g.* FROM g JOIN best USING (target, pos)), {FIT_SQL}""")
def ridge_loo_choice(spark, d):
    rows = two_features(spark, d)
    m = moments(rows, "split", "x", "y", parts=2)
    return fitted(L.ridge_loo(rows, "split", "x", "y", m, L.train_test_design(spark), LOO_ALPHAS))


@query(f"WITH {TWO}, {sums('s', "split = 'train'")}, w AS (SELECT *, 1000.0 AS alpha, {solve2('1000')} FROM s), {FIT_SQL}")
def ridge_tiled(spark, d):
    """The system of ``ridge_fixed`` in tiles of one feature, eliminated tile by tile."""
    return fitted(ridge_tiles(gram_tiles(two_features(spark, d), "split", "x", "y", tile=1), L.train_test_design(spark), 1000.0))


@query(f"""WITH {TWO}, {sums('s', "split = 'train'")}, al AS (SELECT unnest([1.0, 1e4, 1e6]::DOUBLE[]) AS alpha, unnest([0, 1, 2]) AS pos),
 e AS (SELECT target, pos, min(alpha) AS alpha, avg(pow((d.y - my - ({KEPT_Y} / ({KEPT}{KEPT} + alpha)) * (d.{KEPT} - m{KEPT})) / (1 - 1 / n - pow(d.{KEPT} - m{KEPT}, 2) / ({KEPT}{KEPT} + alpha)), 2)) AS err
  FROM s JOIN d USING (target), al WHERE split = 'train' GROUP BY 1, 2),
 best AS (SELECT min_by(alpha, (m, pos)) AS alpha FROM (SELECT pos, min(alpha) AS alpha, avg(err) AS m FROM e GROUP BY 1)),
 w AS (SELECT s.*, alpha, {solve2('alpha')} FROM s, best), {FIT_SQL}""")
def ridge_subsampled_choice(spark, d):
    """Alpha searched on one of two features, fitted on both in tiles."""
    return fitted(ridge_subsampled(two_features(spark, d), "split", "x", "y", L.train_test_design(spark), 1, LOO_ALPHAS, tile=1))


@query(f"""WITH {TWO}, {sums('s', "split = 'train' AND NOT v")}, {sums('full', "split = 'train'")}, al AS (SELECT unnest([1.0, 1e4, 1e6]::DOUBLE[]) AS alpha, unnest([0, 1, 2]) AS pos),
 g AS (SELECT s.*, alpha, pos, {solve2('alpha')} FROM s, al),
 e AS (SELECT g.target, pos, min(alpha) AS alpha, 1 - sum(pow(d.y - my - wa * (d.a - ma) - wb * (d.b - mb), 2)) / (sum(pow(d.y - my, 2)) + 1e-6) AS r2 FROM g JOIN d USING (target)
  WHERE split = 'train' AND v GROUP BY 1, 2),
 best AS (SELECT max_by(alpha, (m, -pos)) AS alpha FROM (SELECT pos, min(alpha) AS alpha, avg(r2) AS m FROM e GROUP BY 1)),
 w AS (SELECT full.*, alpha, {solve2('alpha')} FROM full, best), {FIT_SQL}""".replace("full", "whole"))
def ridge_holdout_choice(spark, d):
    rows = two_features(spark, d)
    part = F.when(F.col("split") == "test", "test").when(F.col("v"), "val").otherwise("fit")
    m = moments(rows.withColumn("part", part), "part", "x", "y", parts=3)
    return fitted(L.ridge_holdout(m, L.holdout_design(spark), LOO_ALPHAS))


@query(f"""WITH {TWO}, {sums('s', "split = 'train'")}, z AS (SELECT *, sqrt(aa / (n - 1)) AS da, sqrt(bb / (n - 1)) AS db FROM s WHERE target = 0),
 q AS (SELECT *, ay / da AS sa, by_ / db AS sb FROM z), k AS (SELECT *, (sa * sa + sb * sb) / (sa * sa * aa / (da * da) + sb * sb * bb / (db * db) + 2 * sa * sb * ab / (da * db)) AS k FROM q),
 w AS (SELECT *, 1.0::DOUBLE AS alpha, k * sa / da AS wa, k * sb / db AS wb FROM k), {FIT_SQL}""")
def pls_one_component(spark, d):
    rows = two_features(spark, d).withColumn("y", F.slice("y", 1, 1))
    part = F.when(F.col("split") == "test", "test").when(F.col("v"), "val").otherwise("fit")
    m = moments(rows.withColumn("part", part), "part", "x", "y", parts=3)
    return fitted(L.pls(m, L.holdout_design(spark), [1]))


# a target without weights has a flat prediction, which scores 0
FLAT_FIT = FIT_SQL.replace("sqrt(var_pop(y) * var_pop(wa * a + wb * b)) AS r", "nullif(sqrt(var_pop(y) * var_pop(wa * a + wb * b)), 0) AS r").replace("2 * r / (1 + r)", "coalesce(2 * r / (1 + r), 0)")


def one_feature_sql(l1: float) -> str:
    """One feature makes the sparse maps a soft threshold; the second one is flat."""
    w = f"sign(ay) * greatest(abs(ay) / n - alpha * {l1}, 0) / (aa / n + alpha * {1 - l1})"
    return f"""WITH {TWO.replace('l_discount * 100 AS b', '0.0::DOUBLE AS b')}, {sums('s', "split = 'train' AND NOT v")}, {sums('whole', "split = 'train'")},
 al AS (SELECT unnest([100.0, 1.0, 0.01]::DOUBLE[]) AS alpha, unnest([0, 1, 2]) AS pos), g AS (SELECT s.*, alpha, pos, {w} AS wa FROM s, al),
 e AS (SELECT g.target, pos, min(alpha) AS alpha, 1 - sum(pow(d.y - my - wa * (d.a - ma), 2)) / (sum(pow(d.y - my, 2)) + 1e-6) AS r2 FROM g JOIN d USING (target) WHERE split = 'train' AND v GROUP BY 1, 2),
 best AS (SELECT max_by(alpha, (m, -pos)) AS alpha FROM (SELECT pos, min(alpha) AS alpha, avg(r2) AS m FROM e GROUP BY 1)),
 q AS (SELECT whole.*, alpha, {w} AS wa FROM whole, best), w AS (SELECT * REPLACE (wa * (wa * ay) / (wa * wa * aa + 1e-10) AS wa), 0.0::DOUBLE AS wb FROM q), {FLAT_FIT}"""


def one_feature(spark, d, l1):
    rows = two_features(spark, d).withColumn("x", F.array(F.col("x")[0], F.lit(0.0)))
    part = F.when(F.col("split") == "test", "test").when(F.col("v"), "val").otherwise("fit")
    m = moments(rows.withColumn("part", part), "part", "x", "y", parts=3)
    return fitted(L.elastic_net(m, L.holdout_design(spark), (0.01, 1.0, 100.0), l1))


@query(one_feature_sql(1.0))
def lasso_one_feature(spark, d):
    return one_feature(spark, d, 1.0)


@query(one_feature_sql(0.5))
def elastic_net_one_feature(spark, d):
    return one_feature(spark, d, 0.5)


# ---------------------------------------------------------------- the other maps on two features


def masked_sql(wa: str, wb: str, per_target: bool) -> str:
    """Hold-out choice of alpha and refit where a target may use one feature only; one alpha for all targets or each its own."""
    w = f"CASE WHEN {wa} THEN ay / (aa + alpha) ELSE 0.0 END AS wa, CASE WHEN {wb} THEN by_ / (bb + alpha) ELSE 0.0 END AS wb"
    best = "SELECT target, max_by(alpha, (r2, -pos)) AS alpha FROM e GROUP BY 1" if per_target else "SELECT max_by(alpha, (m, -pos)) AS alpha FROM (SELECT pos, min(alpha) AS alpha, avg(r2) AS m FROM e GROUP BY 1)"
    join = "whole JOIN best USING (target)" if per_target else "whole, best"
    return f"""WITH {TWO}, {sums('s', "split = 'train' AND NOT v")}, {sums('whole', "split = 'train'")}, al AS (SELECT unnest([1.0, 1e4, 1e6]::DOUBLE[]) AS alpha, unnest([0, 1, 2]) AS pos),
 g AS (SELECT s.*, alpha, pos, {w} FROM s, al),
 e AS (SELECT g.target, pos, min(alpha) AS alpha, 1 - sum(pow(d.y - my - wa * (d.a - ma) - wb * (d.b - mb), 2)) / (sum(pow(d.y - my, 2)) + 1e-6) AS r2 FROM g JOIN d USING (target)
  WHERE split = 'train' AND v GROUP BY 1, 2),
 best AS ({best}), w AS (SELECT *, {w} FROM {join}), {FIT_SQL}"""


def held_out_moments(spark, d):
    part = F.when(F.col("split") == "test", "test").when(F.col("v"), "val").otherwise("fit")
    return moments(two_features(spark, d).withColumn("part", part), "part", "x", "y", parts=3)


HALVES_OF_TWO = {"first": (0, 1), "second": (1, 2)}


@query(masked_sql("target = 1", "target = 0", False))
def ridge_constrained_choice(spark, d):
    """Feature i never serves target i; one alpha."""
    return fitted(L.constrained_ridge(held_out_moments(spark, d), L.holdout_design(spark), LOO_ALPHAS, block_size=2))


@query(masked_sql("target = 1", "target = 0", True))
def ridge_exclusion_choice(spark, d):
    return fitted(L.block_ridge(held_out_moments(spark, d), L.holdout_design(spark), HALVES_OF_TWO, 2, "exclusion", LOO_ALPHAS))


@query(masked_sql("target = 0", "target = 1", True))
def ridge_selection_choice(spark, d):
    return fitted(L.block_ridge(held_out_moments(spark, d), L.holdout_design(spark), HALVES_OF_TWO, 2, "selection", LOO_ALPHAS))


@query(f"WITH {TWO}, {sums('s', "split = 'train'")}, w AS (SELECT *, 2.0 AS alpha, {solve2('0.0')} FROM s), {FIT_SQL}")
def pls_two_components(spark, d):
    """As many components as features: least squares, whatever the targets."""
    return fitted(L.pls(held_out_moments(spark, d), L.holdout_design(spark), [2]))


# features and responses change sides
BACK = TWO.replace("l_quantity AS a, l_discount * 100 AS b", "l_extendedprice / 1000 AS a, l_tax * 100 AS b").replace("[l_extendedprice / 1000, l_tax * 100]", "[l_quantity, l_discount * 100]")
FIXED = f"""{sums('s', "split = 'train'")}, w AS (SELECT *, 1000.0 AS alpha, {solve2('1000')} FROM s), {FIT_SQL}"""


@query(f"""SELECT 'source_to_target' AS direction, target, alpha, r2, pearson FROM (WITH {TWO}, {FIXED})
 UNION ALL SELECT 'target_to_source', target, alpha, r2, pearson FROM (WITH {BACK}, {FIXED})""")
def bidirectional_fixed(spark, d):
    out = get_metric("bidirectional")(MetricInput(two_features(spark, d), split="split"), alphas=(1000.0,))
    return out.select("direction", F.col("target").cast("long").alias("target"), "alpha", r6("r2").alias("r2"), r6("pearson").alias("pearson"))


@query(f"SELECT target, alpha, w0, w1, b, r2, pearson FROM (WITH {BACK}, {FIXED})")
def inverse_fixed(spark, d):
    return fitted(get_metric("inverse_ridge")(MetricInput(two_features(spark, d), split="split"), alphas=(1000.0,)))


@query(f"SELECT 0::BIGINT AS unit, target AS t, alpha, r2, pearson FROM (WITH {TWO}, {FIXED})")
def temporal_fixed(spark, d):
    """Two targets are one unit at two times."""
    out = get_metric("temporal_ridge")(MetricInput(two_features(spark, d), split="split"), n_times=2, alphas=(1000.0,))
    return out.select(F.col("unit").cast("long").alias("unit"), F.col("t").cast("long").alias("t"), "alpha", r6("r2").alias("r2"), r6("pearson").alias("pearson"))


LAYERS = """d AS (SELECT CASE WHEN vec_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, embedding[1]::DOUBLE * scale AS a, embedding[2]::DOUBLE AS b,
  unnest([embedding[33], embedding[34]])::DOUBLE AS y, unnest([0, 1]) + 10 * layer AS target FROM embeddings, (SELECT unnest([0, 1]) AS layer, unnest([1.0, 0.05]::DOUBLE[]) AS scale))"""


@query(f"""WITH {LAYERS}, {FIXED.split(chr(10) + ' SELECT target::BIGINT')[0].replace('1000', '10')},
 c AS (SELECT CASE WHEN target < 10 THEN 'one' ELSE 'two' END AS layer, 2 * r / (1 + r) AS p, r2, CASE target % 10 WHEN 0 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS ceiling FROM te),
 m AS (SELECT layer, unnest(['final_unceiled_pearson', 'final_pearson', 'final_unceiled_r2', 'final_r2']) AS stat, unnest([p, p / ceiling, r2, r2 / ceiling]) AS v FROM c)
 SELECT 'model' AS model, layer, 'two_layers' AS benchmark, 'ridge' AS metric, stat, {R('median(v)')} AS value FROM m GROUP BY layer, stat""")
def benchmark_run(spark, d):
    """A benchmark from its configuration: two layers, four units of which region and ceiling leave two; scores come back from the store."""
    v, x = vectors(spark, d), F.col("vec")
    layers = F.array(*[F.struct(F.lit(name).alias("layer"), F.array(x[0] * scale, x[1]).alias("x")) for name, scale in (("one", 1.0), ("two", 0.05))])
    features = v.select("vec_id", F.explode(layers).alias("z")).select("vec_id", "z.*")
    y = F.array(x[40], x[32], x[41], x[33])
    responses = v.select("vec_id", F.when(F.col("vec_id") % 4 == 0, "test").otherwise("train").alias("split"), y.alias("y"))
    units = spark.createDataFrame([(0, "V2"), (1, "V1"), (2, "V1"), (3, "V1"), (3, "V2")], "unit int, region string")
    ceilings = spark.createDataFrame([(0, 0.9), (1, 0.8), (2, 0.05), (3, 0.5)], "unit int, ceiling double")
    bench = runs.register_benchmark(runs.Benchmark(
        "two_layers", "vectors", ("V1",), "split", ceiling_threshold=0.1, params={"ridge": {"alphas": (10.0,)}}, key="vec_id"))
    path = scratch(spark, "bench")
    runs.run_benchmark(bench, features, runs.Assembly(responses, units, ceilings), "model", path)
    return latest_scores(spark, path).select("model", "layer", "benchmark", "metric", "stat", r6("value").alias("value"))


# ---------------------------------------------------------------- full maps on the embeddings


@query()
def ridge_leave_one_out(spark, d):
    return per_target(get_metric("ridge")(metric_input(spark, d)))


@query()
def ridge_subsampled_search(spark, d):
    return per_target(get_metric("ridge")(metric_input(spark, d, 5), subsample=16))


@query()
def ridge_holdout(spark, d):
    return per_target(get_metric("torch_ridge")(metric_input(spark, d)))


@query()
def lasso(spark, d):
    return per_target(get_metric("torch_lasso")(metric_input(spark, d, 5)))


@query()
def elastic_net(spark, d):
    return per_target(get_metric("torch_elastic")(metric_input(spark, d, 5)))


@query()
def ridge_constrained(spark, d):
    """Two blocks of 16 features against 16 targets; feature i of a block never serves target i."""
    rows = halves(spark, d).withColumn("y", F.slice("y", 1, 16))
    parted, plan = _with_val(rows, 5)
    return per_target(L.constrained_ridge(moments(parted, "part", "x", "y", pilot=rows), plan, block_size=16))


@query()
def ridge_block_exclusion(spark, d):
    return _block(spark, d, "exclusion")


@query()
def ridge_block_selection(spark, d):
    return _block(spark, d, "selection")


def _block(spark, d, mode):
    rows = halves(spark, d)
    parted, plan = _with_val(rows, 5)
    regions = {"early": (0, 16), "middle": (16, 24), "late": (24, 32)}
    return per_target(L.block_ridge(moments(parted, "part", "x", "y", pilot=rows), plan, regions, 32, mode))


def _with_val(rows, folds):
    return parted(MetricInput(rows, key="vec_id", folds=folds), with_val=True)


@query()
def ridge_temporal(spark, d):
    """32 targets read as 8 units x 4 time bins."""
    from ..operators.scoring import rollup_time

    s = get_metric("temporal_ridge")(metric_input(spark, d, 5), n_times=4)
    out = rollup_time(s.select("run", "unit", "t", F.col("pearson").alias("score")), [], "t", "run")
    return out.select(F.col("t").cast("long").alias("t"), r6("final_score").alias("final_score"))


@query()
def ridge_inverse(spark, d):
    return per_target(get_metric("inverse_ridge")(metric_input(spark, d, 5)))


@query()
def ridge_bidirectional(spark, d):
    out = get_metric("bidirectional")(metric_input(spark, d, 5))
    return out.select(
        "direction", "run", F.col("target").cast("long").alias("target"), "alpha", r6("pearson").alias("pearson"), r6("r2").alias("r2"))


@query()
def pls(spark, d):
    return per_target(get_metric("pls")(metric_input(spark, d, 5)))


@query()
def loss_regressor_mse(spark, d):
    return per_target(get_metric("online_linear_regressor")(metric_input(spark, d, 5), loss="mse"))


@query()
def loss_regressor_ccc(spark, d):
    return per_target(get_metric("online_linear_regressor")(metric_input(spark, d, 5), loss="ccc"))


@query()
def loss_regressor_combined(spark, d):
    return per_target(get_metric("online_linear_regressor")(metric_input(spark, d, 5), loss="combined"))


@query()
def map_predictions(spark, d):
    """Held-out prediction of every (vector, target)."""
    inp = metric_input(spark, d, 5)
    rows, plan = parted(inp)
    m = moments(rows, "part", "x", "y", pilot=inp.rows)
    pred = L.predict(rows, ["vec_id"], "x", L.ridge(m, plan, 10.0), m.dim_x, m.dim_y, run_of="part")
    out = L.long_predictions(pred, ["vec_id"], rows, "y")
    return out.select("vec_id", F.col("target").cast("long").alias("target"), r6("y").alias("y"), r6("p").alias("p"))


# ---------------------------------------------------------------- classifiers


def _labelled(spark, d):
    doc = table(spark, d, "documents").select("doc_id", "text", "n_chars")
    words = F.size(F.split("text", " ")).cast("double")
    caps = F.length(F.regexp_replace("text", "[^A-Z]", "")).cast("double")
    vec = F.array(F.log(F.col("n_chars") + 1.0), F.log(words + 1), caps / F.greatest(F.col("n_chars").cast("double"), F.lit(1.0)))
    return table(spark, d, "labels").join(doc, "doc_id").select("doc_id", vec.alias("x"), F.col("quality").alias("label"), "toxic")


@query(f"""WITH RECURSIVE r AS (SELECT l_quantity AS x, l_extendedprice > 40000 AS y FROM lineitem), m AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM r),
 d AS (SELECT (x - m) / s AS x, y::INT::DOUBLE AS y FROM r, m),
 it AS (SELECT 0 AS i, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b UNION ALL
  SELECT i + 1, w - (hbb * gw - hwb * gb) / (hww * hbb - hwb * hwb), b - (hww * gb - hwb * gw) / (hww * hbb - hwb * hwb) FROM (
   SELECT i, w, b, w / 10 + sum((p - y) * x) AS gw, sum(p - y) AS gb, 1 / 10 + sum(p * (1 - p) * x * x) AS hww, sum(p * (1 - p)) AS hbb, sum(p * (1 - p) * x) AS hwb
   FROM (SELECT it.*, d.x, d.y, 1 / (1 + exp(-(w * d.x + b))) AS p FROM it, d WHERE i < 30) GROUP BY i, w, b))
 SELECT {R('w')} AS w, {R('b')} AS b, (SELECT count(*) FROM d WHERE (it.w * x + it.b > 0) = (y = 1)) AS n_right FROM it WHERE i = 30""")
def logistic_one_feature(spark, d):
    """A classifier of one feature, whose Newton steps SQL can take."""
    from ..operators.classify import classify, fit_classifier

    li = table(spark, d, "lineitem")
    rows = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.array("l_quantity").alias("x"), (F.col("l_extendedprice") > 40000).cast("int").alias("label"))
    fit = fit_classifier(rows, "id", "x", "label", [10.0])
    right = classify(rows, fit, ["label"], "x").agg(F.count_if(F.col("pred") == F.col("label")).alias("n_right"))
    return right.select(r6(F.lit(float(fit.w[0, 0]))).alias("w"), r6(F.lit(float(fit.w[1, 0]))).alias("b"), "n_right")


@query()
def logistic_probe(spark, d):
    """Behavioural probe: C by 5-fold accuracy, then scores against both targets on the held-out rows."""
    from ..operators.classify import classify, fit_classifier
    from ..operators.scoring import dual_scores
    from ..operators.splits import holdout

    rows = holdout(_labelled(spark, d), "doc_id", 0.2, "label")
    fit = fit_classifier(rows.where(~F.col("is_val")), "doc_id", "x", "label")
    pred = classify(rows.where("is_val"), fit, ["doc_id", "label", "toxic"], "x").withColumn("all", F.lit("all"))
    out = dual_scores(pred, ["all"], "pred", "label", "toxic")
    return out.select(*[r6(c).alias(c) for c in out.columns if c.endswith(("accuracy", "kappa", "macro"))])


@query()
def linear_classifier(spark, d):
    """Multiclass probe of the embedding label."""
    inp = MetricInput(vectors(spark, d).withColumnRenamed("vec", "x"), key="vec_id")
    out = get_metric("online_linear_classifier")(inp, label="label")
    return out.select(r6("accuracy").alias("accuracy"), r6("f1_macro").alias("f1_macro"), r6("kappa").alias("kappa"), "n")


# ---------------------------------------------------------------- whole runs


@query()
def scoring_run(spark, d):
    """Ridge with ceilings, rolled up and appended to a results store, then read back."""
    rows = halves(spark, d)
    ceilings = rows.select(F.posexplode("y").alias("target", "v")).groupBy("target").agg((F.avg(F.abs("v")) * 5).alias("ceiling"))
    path = scratch(spark, "runs")
    inp = MetricInput(rows, key="vec_id", folds=5, ceiling=ceilings)
    runs.score_run(inp, "torch_ridge", "model", "layer", "bench", path)
    return spark.read.parquet(path).select("model", "layer", "benchmark", "metric", "stat", r6("value").alias("value"))


@query()
def subject_to_subject(spark, d):
    """Regions of one subject (first half of the vector) predict regions of another (second half)."""

    def side(start):
        pieces = F.array(F.struct(F.lit("A").alias("region"), F.slice("vec", start, 16).alias("v")), F.struct(F.lit("B").alias("region"), F.slice("vec", start + 16, 16).alias("v")))
        return vectors(spark, d).select("vec_id", F.explode(pieces).alias("z")).select("vec_id", "z.region", F.col("z.v").alias("vec"))

    out = runs.assembly_to_assembly(side(1), side(33), "vec_id", [("A", "A"), ("A", "B"), ("B", "A")], "torch_ridge", 5)
    return out.groupBy("source_region", "target_region", "run").agg(F.count("pearson").alias("n"), r6(F.avg("r2")).alias("mean_r2"))


@query()
def story_scores(spark, d):
    """Time-resolved run: lagged alignment, whole stories held out, one score per unit."""
    s = stories(spark, d)
    ceilings = s.select(F.posexplode("y").alias("target", "v")).groupBy("target").agg((F.avg(F.abs("v")) * 5).alias("ceiling"))
    return runs.story_units(_story_fit(spark, d), ceilings).select(
        F.col("target").cast("long").alias("target"), r6("pearson").alias("pearson"), r6("r2").alias("r2"), r6("ceiled_pearson").alias("ceiled"))


@query()
def story_traces(spark, d):
    """Spatial correlation of held-out predictions at every time point, per unit mask."""
    masks = spark.range(32).select(F.col("id").cast("int").alias("unit"), F.explode(F.array(F.lit("whole"), F.when(F.col("id") < 8, "early").otherwise("late"))).alias("mask"))
    long = runs.story_predictions(_story_fit(spark, d), "vec_id", "story", "response_t", "x", "y")
    out = spatial_traces(long, masks)
    return out.select(F.col("story").cast("long").alias("story"), F.col("t").cast("long").alias("t"), "mask", r6("spatial_r").alias("spatial_r"))


def _story_fit(spark, d):
    s = stories(spark, d)
    rows = lag_align(s.select("story", "t", "x"), s.select("vec_id", "story", "t", "y"), "story", "t", 2)
    return runs.story_fit(rows, "story", "x", "y")
