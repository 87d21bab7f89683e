"""Classification scores and model-to-human agreement over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import behaviour as B
from ..operators import scoring
from . import query
from .views import CHOICES, R, choices, table


def sql_classes(src: str, keys: str, y: str, p: str) -> str:
    """SQL for per-key accuracy, F1 and kappa from a table ``src``."""
    return f"""cells AS (SELECT {keys}, {y} AS y, {p} AS p, count(*) AS n FROM {src} GROUP BY ALL),
 cls AS (SELECT {keys}, c, sum(r) AS r, sum(k) AS k, sum(h) AS h FROM (
  SELECT {keys}, y AS c, n AS r, 0 AS k, CASE WHEN y = p THEN n ELSE 0 END AS h FROM cells UNION ALL SELECT {keys}, p, 0, n, 0 FROM cells) GROUP BY ALL),
 agg AS (SELECT {keys}, sum(h)::DOUBLE AS h, sum(r)::DOUBLE AS n, sum(r::DOUBLE * k) AS m, avg(coalesce(2.0 * h / nullif(r + k, 0), 0)) AS f1_macro,
  coalesce(max(CASE WHEN c = 1 THEN coalesce(2.0 * h / nullif(r + k, 0), 0) END), 0) AS f1_binary FROM cls GROUP BY ALL),
 sc AS (SELECT {keys}, h / n AS accuracy, f1_binary, f1_macro, 1 - (1 - h / n) / nullif(1 - m / (n * n), 0) AS kappa, n FROM agg)"""


@query(f"WITH {CHOICES}, {sql_classes('choices', 'scenario', 'human', 'model')} SELECT scenario, {R('accuracy')} AS accuracy, {R('f1_binary')} AS f1_binary, {R('f1_macro')} AS f1_macro, {R('kappa')} AS kappa FROM sc")
def classification_scores(spark, d):
    out = scoring.classification_scores(choices(spark, d), ["scenario"], "human", "model")
    return out.select("scenario", *[r6(c).alias(c) for c in ("accuracy", "f1_binary", "f1_macro", "kappa")])


LINE_CLASSES = """lines AS (SELECT l_suppkey AS unit, l_linenumber::BIGINT AS y, least(1 + floor(l_quantity / 8), 7)::BIGINT AS p FROM lineitem)"""


@query(f"WITH {LINE_CLASSES}, {sql_classes('lines', 'unit', 'y', 'p')} SELECT unit, {R('kappa')} AS kappa, n::BIGINT AS n FROM sc")
def kappa_per_unit(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("unit"), F.col("l_linenumber").cast("long").alias("y"),
        F.least(1 + F.floor(F.col("l_quantity") / 8), F.lit(7)).cast("long").alias("p"))
    return scoring.cohen_kappa(li, ["unit"], "y", "p").select("unit", r6("kappa").alias("kappa"), "n")


@query(f"""WITH {CHOICES}, {sql_classes('choices', 'scenario, participant', 'model', 'human')}
 , med AS (SELECT scenario, coalesce(median(kappa), 0) AS kappa FROM sc GROUP BY 1),
 acc AS (SELECT scenario, avg((model = human)::INT) AS accuracy FROM choices GROUP BY 1)
 SELECT scenario, {R('kappa')} AS kappa, {R('accuracy')} AS accuracy FROM med JOIN acc USING (scenario)""")
def scenario_kappa(spark, d):
    m, h = _sides(spark, d)
    out = B.scenario_kappa(m, h)
    return out.select("scenario", r6("kappa").alias("kappa"), r6("accuracy").alias("accuracy"))


@query(f"""WITH {CHOICES}, {sql_classes('choices', 'scenario, participant', 'model', 'human')}
 , med AS (SELECT scenario, coalesce(median(kappa), 0) AS kappa FROM sc GROUP BY 1)
 SELECT {R('avg(kappa)')} AS center, {R('stddev_pop(kappa)')} AS error, count(*) AS n_scenarios, (SELECT {R('avg((model = human)::INT)')} FROM choices) AS accuracy FROM med""")
def model_human_kappa(spark, d):
    m, h = _sides(spark, d)
    out = B.model_human_kappa(m, h)
    return out.select(r6("center").alias("center"), r6("error").alias("error"), "n_scenarios", r6("accuracy").alias("accuracy"))


def _sides(spark, d):
    c = choices(spark, d)
    m = c.select("stimulus", "scenario", F.col("model").alias("choice"), F.col("human").alias("label"), F.col("stimulus").alias("ord"))
    h = c.select("stimulus", "scenario", "participant", F.col("human").alias("response"), F.col("stimulus").alias("ord"))
    return m, h


def _cheb(a: str, b: str) -> str:
    return f"greatest(abs({a} // 16 - {b} // 16), abs({a} % 16 - {b} % 16))"


def _eucl(a: str, b: str) -> str:
    return f"sqrt((pow({a} // 16 - {b} // 16, 2) + pow({a} % 16 - {b} % 16, 2))::DOUBLE)"


def _grid_cols(a: str, b: str, n: str, near: bool) -> str:
    out = f"avg(({a} = {b})::INT) AS accuracy_{n}, avg({_cheb(a, b)}) AS chebyshev_distance_{n}, avg({_eucl(a, b)}) AS euclidean_distance_{n}"
    if near:
        out += f", avg(({_cheb(a, b)} <= 1)::INT) AS accuracy_cheby_{n}, avg(({_eucl(a, b)} <= 1)::INT) AS accuracy_euclidean_{n}"
    return out


GRID_NAMES = [f"{k}_{n}" for n in ("model_human", "model_gt", "human_gt") for k in ("accuracy", "chebyshev_distance", "euclidean_distance")] + [
    "accuracy_cheby_model_gt", "accuracy_euclidean_model_gt"]


@query(f"""WITH md AS (SELECT l_partkey AS k, l_orderkey * 10000000 + l_linenumber * 1000000 + l_suppkey AS o, l_suppkey % 256 AS c, l_orderkey % 256 AS g FROM lineitem),
 hd AS (SELECT o_custkey AS k, o_orderkey AS o, o_orderkey % 256 AS c FROM orders),
 m1 AS (SELECT k, min_by(c, o) AS m, min_by(g, o) AS g FROM md GROUP BY 1), h1 AS (SELECT k, min_by(c, o) AS h FROM hd GROUP BY 1),
 a AS (SELECT {_grid_cols('g', 'c', 'model_gt', True)} FROM md),
 b AS (SELECT {_grid_cols('h', 'm', 'model_human', False)}, {_grid_cols('h', 'g', 'human_gt', False)} FROM m1 JOIN h1 USING (k))
 SELECT {', '.join(f'{R(n)} AS {n}' for n in GRID_NAMES)} FROM a, b""")
def grid_choice_accuracy(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    m = li.select(
        F.col("l_partkey").alias("stimulus"), (F.col("l_orderkey") * 10000000 + F.col("l_linenumber") * 1000000 + F.col("l_suppkey")).alias("ord"),
        (F.col("l_suppkey") % 256).alias("choice"), (F.col("l_orderkey") % 256).alias("contacts"))
    h = o.select(F.col("o_custkey").alias("stimulus"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 256).alias("choice"))
    out = B.grid_accuracy(m, h)
    return out.select(*[r6(n).alias(n) for n in GRID_NAMES])


@query(f"""WITH c AS (SELECT l_suppkey AS unit, (l_linenumber > 3)::BIGINT AS pred, (l_quantity > 25)::BIGINT AS gt, (l_discount > 0.05)::BIGINT AS hum FROM lineitem),
 g AS (SELECT unit, avg((pred = gt)::INT) AS a, count(*) AS n, sum(pred)::DOUBLE AS sp, sum(gt)::DOUBLE AS sg, sum(hum)::DOUBLE AS sh, avg((pred = hum)::INT) AS b FROM c GROUP BY 1),
 e AS (SELECT *, (sp * sg + (n - sp) * (n - sg)) / (n::DOUBLE * n) AS ea, (sp * sh + (n - sp) * (n - sh)) / (n::DOUBLE * n) AS eb FROM g)
 SELECT unit, {R('a')} AS gt_accuracy, {R('1 - (1 - a) / (1 - ea)')} AS gt_kappa, {R('b')} AS human_accuracy, {R('1 - (1 - b) / (1 - eb)')} AS human_kappa FROM e""")
def dual_target_scores(spark, d):
    c = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("unit"), (F.col("l_linenumber") > 3).cast("long").alias("pred"), (F.col("l_quantity") > 25).cast("long").alias("gt"),
        (F.col("l_discount") > 0.05).cast("long").alias("hum"))
    out = scoring.dual_scores(c, ["unit"], "pred", "gt", "hum")
    return out.select("unit", *[r6(n).alias(n) for n in ("gt_accuracy", "gt_kappa", "human_accuracy", "human_kappa")])
