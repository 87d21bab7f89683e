"""Representation similarity and unit matching over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6, r6_of
from ..functions.registry import MetricInput, get_metric
from ..operators import similarity as S
from . import query
from .maps import metric_input
from .views import PAIRS, R, STORIES, halves, stories, table




ZED = f"""v AS (SELECT vec_id, label, embedding[1:32]::DOUBLE[] AS x, embedding[33:64]::DOUBLE[] AS y FROM embeddings),
 c AS (SELECT vec_id, label, list_transform(x, lambda e: e - list_avg(x)) AS x, list_transform(y, lambda e: e - list_avg(y)) AS y FROM v),
 z AS (SELECT vec_id, label, list_transform(x, lambda e: e / sqrt(list_dot_product(x, x))) AS x, list_transform(y, lambda e: e / sqrt(list_dot_product(y, y))) AS y FROM c)"""
BY_LABEL = f"""{ZED}, d AS (SELECT p.label, p.vec_id AS i, q.vec_id AS j, 1 - list_dot_product(p.x, q.x) AS a, 1 - list_dot_product(p.y, q.y) AS b
 FROM z p JOIN z q ON p.label = q.label AND p.vec_id < q.vec_id)"""
SQL_COS = "sum(a * b) / sqrt(sum(a * a) * sum(b * b))"


def embedded(spark, d, keys=("label",)):
    h = halves(spark, d)
    return S.pair_up(S.correlation_rows(h, list(keys), "vec_id", "x"), S.correlation_rows(h, list(keys), "vec_id", "y"), list(keys))


@query(f"WITH {BY_LABEL} SELECT label::BIGINT AS label, i, j, {R('a')} AS dist FROM d")
def rdm_table(spark, d):
    out = S.rdm(S.correlation_rows(halves(spark, d), ["label"], "vec_id", "x"), ["label"])
    return out.select(F.col("label").cast("long").alias("label"), "i", "j", r6_of("dist").alias("dist"))


@query(f"WITH {BY_LABEL} SELECT label::BIGINT AS label, {R('corr(a, b)')} AS corr, {R(SQL_COS)} AS cosine FROM d GROUP BY 1")
def rdm_similarity_by_label(spark, d):
    out = S.rdm_similarity(embedded(spark, d), ["label"])
    return out.select(F.col("label").cast("long").alias("label"), r6("corr").alias("corr"), r6("cosine").alias("cosine"))


ALL_PAIRS = f"""{ZED}, d AS (SELECT 1 - list_dot_product(p.x, q.x) AS a, 1 - list_dot_product(p.y, q.y) AS b FROM z p JOIN z q ON p.vec_id < q.vec_id)"""


@query(f"WITH {ALL_PAIRS} SELECT {R('corr(a, b)')} AS corr, {R(SQL_COS)} AS cosine FROM d")
def rdm_similarity_whole(spark, d):
    out = S.rdm_similarity(embedded(spark, d, ()), [])
    return out.select(r6("corr").alias("corr"), r6("cosine").alias("cosine"))


@query(f"""WITH {BY_LABEL}, rk AS (SELECT label, rank() OVER (PARTITION BY label ORDER BY a) + (count(*) OVER (PARTITION BY label, a) - 1) / 2.0::DOUBLE AS a,
  rank() OVER (PARTITION BY label ORDER BY b) + (count(*) OVER (PARTITION BY label, b) - 1) / 2.0::DOUBLE AS b FROM d)
 SELECT label::BIGINT AS label, {R('corr(a, b)')} AS spearman FROM rk GROUP BY 1""")
def rdm_spearman(spark, d):
    out = S.rdm_spearman(embedded(spark, d), ["label"])
    return out.select(F.col("label").cast("long").alias("label"), r6("spearman").alias("spearman"))


@query(f"""WITH {BY_LABEL}, n AS (SELECT label, row_number() OVER () AS k, a, b FROM d),
 kk AS (SELECT p.label, sum(sign(p.a - q.a) * sign(p.b - q.b)) AS s, sum((p.a <> q.a)::INT) AS na, sum((p.b <> q.b)::INT) AS nb FROM n p JOIN n q ON p.label = q.label AND p.k < q.k GROUP BY 1)
 SELECT label::BIGINT AS label, {R('s / sqrt(na::DOUBLE * nb)')} AS kendall FROM kk""")
def rdm_kendall(spark, d):
    out = S.rdm_kendall(embedded(spark, d), ["label"])
    return out.select(F.col("label").cast("long").alias("label"), r6("kendall").alias("kendall"))


SEG = """sv AS (SELECT vec_id, t, embedding[t * 8 + 1:t * 8 + 8]::DOUBLE[] AS x, embedding[t * 8 + 33:t * 8 + 40]::DOUBLE[] AS y FROM embeddings, (SELECT unnest(range(4)) AS t)),
 sc AS (SELECT vec_id, t, list_transform(x, lambda e: e - list_avg(x)) AS x, list_transform(y, lambda e: e - list_avg(y)) AS y FROM sv),
 sz AS (SELECT vec_id, t, list_transform(x, lambda e: e / sqrt(list_dot_product(x, x))) AS x, list_transform(y, lambda e: e / sqrt(list_dot_product(y, y))) AS y FROM sc)"""


def segments(spark, d, col):
    t = F.explode(F.sequence(F.lit(0), F.lit(3)))
    long = halves(spark, d).withColumn("t", t).withColumn("v", F.slice(col, F.col("t") * 8 + 1, F.lit(8)))
    return S.correlation_rows(long, ["t"], "vec_id", "v")


def wide_scores(df, keys):
    """corr and cosine of a (method, score) table as columns."""
    out = df.groupBy(*keys).agg(
        F.max(F.when(F.col("method") == "corr", F.col("score"))).alias("corr"), F.max(F.when(F.col("method") == "cosine", F.col("score"))).alias("cosine"))
    return out.select(*[F.col(k).cast("long").alias(k) for k in keys], r6("corr").alias("corr"), r6("cosine").alias("cosine"))


@query(f"""WITH {ZED}, {SEG}, d AS (SELECT p.t, 1 - list_dot_product(zp.x, zq.x) AS a, 1 - list_dot_product(p.y, q.y) AS b FROM sz p JOIN sz q ON p.t = q.t AND p.vec_id < q.vec_id
  JOIN z zp ON zp.vec_id = p.vec_id JOIN z zq ON zq.vec_id = q.vec_id) SELECT t, {R('corr(a, b)')} AS corr, {R(SQL_COS)} AS cosine FROM d GROUP BY 1""")
def rsa_over_time(spark, d):
    model = S.correlation_rows(halves(spark, d), [], "vec_id", "x")
    return wide_scores(S.rsa_over_time(model, segments(spark, d, "y")), ["t"])


@query(f"""WITH {SEG}, d AS (SELECT p.t, 1 - list_dot_product(p.x, q.x) AS a, 1 - list_dot_product(p.y, q.y) AS b FROM sz p JOIN sz q ON p.t = q.t AND p.vec_id < q.vec_id)
 SELECT t, {R('corr(a, b)')} AS corr, {R(SQL_COS)} AS cosine FROM d GROUP BY 1""")
def rsa_dynamic_lockstep(spark, d):
    return wide_scores(S.rsa_dynamic(segments(spark, d, "x"), segments(spark, d, "y")), ["t"])


@query(f"""WITH {SEG}, d AS (SELECT p.t AS t_model, r.t AS t_response, 1 - list_dot_product(p.x, q.x) AS a, 1 - list_dot_product(r.y, s.y) AS b FROM sz p JOIN sz q ON p.t = q.t AND p.vec_id < q.vec_id
  JOIN sz r ON r.vec_id = p.vec_id JOIN sz s ON s.vec_id = q.vec_id AND s.t = r.t)
 SELECT t_model, t_response, {R('corr(a, b)')} AS corr, {R(SQL_COS)} AS cosine FROM d GROUP BY 1, 2""")
def rsa_dynamic_generalised(spark, d):
    return wide_scores(S.rsa_dynamic(segments(spark, d, "x"), segments(spark, d, "y"), generalise=True), ["t_model", "t_response"])


# Repeated measurements for the cross-validated distance: month of the ship date by year is the
# item, the line number the repetition, supplier classes the channels.
CROSS = """cell AS (SELECT {keys} year(l_shipdate) * 12 + month(l_shipdate) AS item, l_linenumber AS r, l_suppkey % {ch} AS ch, avg(l_quantity) AS v, avg(l_discount) * 100 AS w FROM lineitem GROUP BY ALL),
 ok AS (SELECT {keys} item FROM cell GROUP BY ALL HAVING count(*) = 7 * {ch}),
 cc AS (SELECT cell.* FROM cell JOIN ok USING ({using} item)),
 df AS (SELECT {pk} p.item AS i, q.item AS j, p.ch, p.r, p.v - q.v AS dv FROM cc p JOIN cc q ON p.ch = q.ch AND p.r = q.r AND p.item < q.item {kj}),
 sm AS (SELECT {keys} i, j, ch, sum(dv) AS s, sum(dv * dv) AS q FROM df GROUP BY ALL),
 bd AS (SELECT {keys} i, j, sum(s * s - q) / (7 * 6 * {ch}) AS b FROM sm GROUP BY ALL),
 ml AS (SELECT {keys} item, ch, avg(w) AS w FROM cc GROUP BY ALL),
 mp AS (SELECT {pk} p.item AS i, q.item AS j, 1 - corr(p.w, q.w) AS a FROM ml p JOIN ml q ON p.ch = q.ch AND p.item < q.item {kj} GROUP BY ALL),
 d AS (SELECT * FROM bd JOIN mp USING ({using} i, j))"""


def cross_inputs(spark, d, keys, channels):
    li = table(spark, d, "lineitem")
    cell = li.groupBy(
        *keys, (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("item"), F.col("l_linenumber").alias("r"), (F.col("l_suppkey") % channels).alias("ch")
    ).agg(F.avg("l_quantity").alias("v"), (F.avg("l_discount") * 100).alias("w"))

    def wide(df, by, val):
        s = F.array_sort(F.collect_list(F.struct("ch", val)))
        return df.groupBy(*by).agg(F.transform(s, lambda e: e[val]).alias("vec"), F.count(F.lit(1)).alias("k")).where(F.col("k") == channels).drop("k")

    reps = S.crossnobis_rows(wide(cell, [*keys, "item", "r"], "v"), list(keys), "item", "r", "vec", 7, channels)
    model = S.correlation_rows(wide(cell.groupBy(*keys, "item", "ch").agg(F.avg("w").alias("w")), [*keys, "item"], "w"), list(keys), "item", "vec")
    return S.pair_up(model, reps, list(keys))


@query("WITH " + CROSS.format(ch=16, keys="", using="", pk="", kj="") + f" SELECT {R('corr(a, b)', 5)} AS corr, {R(SQL_COS, 5)} AS cosine FROM d")
def crossnobis_similarity(spark, d):
    out = S.rdm_similarity(cross_inputs(spark, d, (), 16), [], None, S.crossnobis_signs(7, 16))
    return out.select(r6("corr", 5).alias("corr"), r6("cosine", 5).alias("cosine"))


@query("WITH " + CROSS.format(ch=4, keys="l_returnflag,", using="l_returnflag,", pk="p.l_returnflag,", kj="AND p.l_returnflag = q.l_returnflag")
       + f" SELECT l_returnflag AS t, {R('corr(a, b)', 5)} AS corr, {R(SQL_COS, 5)} AS cosine FROM d GROUP BY 1")
def crossnobis_over_time(spark, d):
    out = S.rdm_similarity(cross_inputs(spark, d, ("l_returnflag",), 4), ["l_returnflag"], None, S.crossnobis_signs(7, 4))
    return out.select(F.col("l_returnflag").alias("t"), r6("corr", 5).alias("corr"), r6("cosine", 5).alias("cosine"))


WITHIN = f"""{STORIES}, mv AS (SELECT story, t, 'whole' AS mask, x, y FROM stories UNION ALL SELECT story, t, 'early', x, y[1:8] FROM stories),
 mc AS (SELECT story, t, mask, list_transform(x, lambda e: e - list_avg(x)) AS x, list_transform(y, lambda e: e - list_avg(y)) AS y FROM mv),
 mz AS (SELECT story, t, mask, list_transform(x, lambda e: e / sqrt(list_dot_product(x, x))) AS x, list_transform(y, lambda e: e / sqrt(list_dot_product(y, y))) AS y FROM mc),
 gr AS (SELECT p.story, p.mask, 1 - list_dot_product(p.x, q.x) AS a, 1 - list_dot_product(p.y, q.y) AS b FROM mz p JOIN mz q ON p.story = q.story AND p.mask = q.mask AND p.t < q.t),
 rk AS (SELECT story, mask, rank() OVER (PARTITION BY story, mask ORDER BY a) + (count(*) OVER (PARTITION BY story, mask, a) - 1) / 2.0::DOUBLE AS a,
  rank() OVER (PARTITION BY story, mask ORDER BY b) + (count(*) OVER (PARTITION BY story, mask, b) - 1) / 2.0::DOUBLE AS b FROM gr),
 sc AS (SELECT story, mask, corr(a, b) AS s FROM rk GROUP BY 1, 2)"""


def within(spark, d):
    s = stories(spark, d)
    return S.rsa_within(s, s, "story", "t", "x", "y", [("early", range(8))])


@query(f"WITH {WITHIN} SELECT story::BIGINT AS story, mask, {R('s')} AS spearman FROM sc")
def rsa_within_story(spark, d):
    return within(spark, d).select(F.col("story").cast("long").alias("story"), "mask", r6("spearman").alias("spearman"))


@query(f"WITH {WITHIN} SELECT mask, {R('median(s)')} AS median_rsa, count(*) AS n_stories FROM sc GROUP BY 1")
def rsa_within_summary(spark, d):
    return S.rsa_within_summary(within(spark, d)).withColumn("median_rsa", r6("median_rsa"))


@query()
def versa(spark, d):
    from ..operators.splits import holdout

    rows = holdout(halves(spark, d), "vec_id", 0.2).withColumn("split", F.when(F.col("is_val"), "test").otherwise("train"))
    out = get_metric("versa")(MetricInput(rows, key="vec_id", split="split"))
    return out.select("n_items", r6("corr").alias("corr"), r6("cosine").alias("cosine"))


FOLDED = f"""{PAIRS}, f AS (SELECT vec_id, ntile(10) OVER (ORDER BY md5('42:' || vec_id)) - 1 AS fold FROM embeddings),
 r AS (SELECT fold, a.unit AS s, b.unit AS t, corr(a.p, b.y) AS r FROM pairs a JOIN pairs b USING (vec_id) JOIN f USING (vec_id) GROUP BY 1, 2, 3)"""


@query(f"""WITH {FOLDED}, a AS (SELECT fold, avg(m) AS m FROM (SELECT fold, s, max(r) AS m FROM r GROUP BY 1, 2) GROUP BY 1),
 b AS (SELECT fold, avg(m) AS n FROM (SELECT fold, t, max(r) AS m FROM r GROUP BY 1, 2) GROUP BY 1) SELECT fold::VARCHAR AS part, {R('(m + n) / 2')} AS score FROM a JOIN b USING (fold)""")
def semi_matching(spark, d):
    return get_metric("semi_matching")(metric_input(spark, d)).select("part", r6("score").alias("score"))


@query()
def one_to_one_matching(spark, d):
    return get_metric("one_to_one")(metric_input(spark, d)).select("part", "n_matched", r6("score").alias("score"))


@query()
def soft_matching(spark, d):
    out = get_metric("soft_matching")(metric_input(spark, d, 5), regs=(1e-2, 1e-1, 1.0))
    return out.select("run", F.col("target").cast("long").alias("target"), "alpha", r6("pearson").alias("pearson"), r6("r2").alias("r2"))
