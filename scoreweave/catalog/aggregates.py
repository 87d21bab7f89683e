"""Repeats, ceilings, scorers, roll-ups and statistics over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import r6
from ..operators import regions, reliability, scoring, tuning
from . import query
from .views import ATLAS, PAIRS, R, TRIALS, TUNING, atlas, bridge, pairs, table, trials, unit_scores, vectors
from .views import tuning as tuning_view

# SQL twins of the scorer columns, for grouped (y, p)
SQL_R = "covar_pop(y, p) / nullif(sqrt(var_pop(y) * var_pop(p)), 0)"


def sql_sb(r: str) -> str:
    return f"(2 * ({r}) / nullif(1 + ({r}), 0))"


SQL_SBR = sql_sb(SQL_R)
SQL_CCC = "2 * covar_pop(p, y) / (var_samp(p) + var_samp(y) + pow(avg(p) - avg(y), 2) + 1e-8)"
SQL_R2 = "1 - sum(pow(y - p, 2)) / nullif(var_pop(y) * count(y), 0)"
HALF = """halves AS (SELECT unit, stimulus, avg(CASE WHEN rep % 2 = 0 THEN value END) AS y, avg(CASE WHEN rep % 2 <> 0 THEN value END) AS p
 FROM trials GROUP BY 1, 2), paired AS (SELECT * FROM halves WHERE y IS NOT NULL AND p IS NOT NULL)"""
ODD_EVEN = f"{HALF}, rr AS (SELECT unit, {SQL_R} AS r FROM paired GROUP BY 1), ce AS (SELECT unit, r, {sql_sb('greatest(coalesce(r, 0), 0)')} AS ceiling FROM rr)"


# ---------------------------------------------------------------- repeats


@query(f"SELECT l_suppkey AS unit, l_partkey AS stimulus, {R('avg(CASE WHEN l_quantity <= 48 THEN l_quantity END)')} AS value FROM lineitem GROUP BY 1, 2")
def repetition_average(spark, d):
    q = F.col("l_quantity")
    li = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("unit"), F.col("l_partkey").alias("stimulus"), F.when(q <= 48, q).otherwise(F.lit(float("nan"))).alias("value"))
    return reliability.average_repetition(li, ["unit", "stimulus"]).withColumn("value", r6("value"))


@query(f"""WITH t AS (SELECT user_id AS unit, event_type AS run, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS t FROM events),
 n AS (SELECT unit, min(n) AS n FROM (SELECT unit, run, count(*) AS n FROM t GROUP BY 1, 2) GROUP BY 1)
 SELECT unit, t::BIGINT AS t, {R('avg(value)')} AS value FROM t JOIN n USING (unit) WHERE t < n.n GROUP BY 1, 2""")
def run_average(spark, d):
    from ..functions.ordering import ordered_row_number

    e = table(spark, d, "events").select(F.col("user_id").alias("unit"), F.col("event_type").alias("run"), "event_id", "value")
    t = ordered_row_number(e, ["unit", "run"], ["event_id"], "pos").withColumn("t", F.col("pos") - 1)
    return reliability.average_runs(t, ["unit"], "run", "t").select("unit", "t", r6("value").alias("value"))


@query(f"SELECT label::BIGINT AS story, u AS unit, {R('avg(embedding[u + 1]::DOUBLE)')} AS value FROM embeddings, (SELECT unnest(range(64)) AS u) GROUP BY 1, 2")
def sequence_mean(spark, d):
    v = vectors(spark, d).select(F.col("label").cast("long").alias("story"), F.posexplode("vec").alias("unit", "value"))
    out = reliability.sequence_mean(v, ["story", "unit"])
    return out.select("story", F.col("unit").cast("long").alias("unit"), r6("value").alias("value"))


@query(f"SELECT source, {R('avg(toxic)')} AS behaviour FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def behaviour_mean(spark, d):
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").withColumnRenamed("toxic", "target")
    return reliability.behaviour_mean(t, "source").withColumn("behaviour", r6("behaviour"))


@query(f"""WITH {TRIALS}, c AS (SELECT unit, avg(v) AS nv FROM (SELECT unit, stimulus, var_samp(value) AS v FROM trials GROUP BY 1, 2) GROUP BY 1),
 t AS (SELECT unit, var_pop(value) AS tv FROM trials GROUP BY 1),
 s AS (SELECT unit, sqrt(greatest(tv - nv, 0)) / nullif(sqrt(nv), 0) AS s FROM c JOIN t USING (unit))
 SELECT unit, {R('s')} AS ncsnr, {R('100 * s * s / (s * s + 1.0 / 3)')} AS ceiling_pct FROM s""")
def noise_ceiling(spark, d):
    return reliability.noise_ceiling(trials(spark, d), 3).select("unit", r6("ncsnr").alias("ncsnr"), r6("ceiling_pct").alias("ceiling_pct"))


@query(f"""WITH {TRIALS}, reps AS (SELECT DISTINCT rep FROM trials), sp AS (SELECT unnest(range(50)) AS split),
 rk AS (SELECT split, rep, row_number() OVER (PARTITION BY split ORDER BY md5('42:' || split || ':' || rep), rep) AS rk, count(*) OVER (PARTITION BY split) AS n FROM reps, sp),
 m AS (SELECT unit, split, stimulus, avg(CASE WHEN rk <= n // 2 THEN value END) AS y, avg(CASE WHEN rk > n // 2 THEN value END) AS p
  FROM trials JOIN rk USING (rep) GROUP BY 1, 2, 3),
 r AS (SELECT unit, split, coalesce({SQL_R}, 0) AS r FROM m WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2)
 SELECT unit, {R('avg(' + sql_sb('r') + ')')} AS consistency FROM r GROUP BY 1""")
def split_half_consistency(spark, d):
    return reliability.split_half(trials(spark, d), 50).withColumn("consistency", r6("consistency"))


@query(f"""WITH {TRIALS}, t AS (SELECT *, sum(value) OVER w AS s, count(*) OVER w AS n FROM trials WINDOW w AS (PARTITION BY unit, stimulus)),
 x AS (SELECT unit, rep, value AS y, (s - value) / nullif(n - 1, 0) AS p FROM t),
 r AS (SELECT unit, rep, coalesce({SQL_R}, 0) AS r FROM x WHERE p IS NOT NULL GROUP BY 1, 2)
 SELECT unit, {R('avg(' + sql_sb('r') + ')')} AS consistency FROM r GROUP BY 1""")
def one_vs_all_consistency(spark, d):
    return reliability.one_vs_all(trials(spark, d)).withColumn("consistency", r6("consistency"))


@query(f"WITH {TRIALS}, {ODD_EVEN} SELECT unit, {R('r')} AS split_r, {R('ceiling')} AS ceiling FROM ce")
def odd_even_ceiling(spark, d):
    return reliability.odd_even_ceiling(trials(spark, d)).select("unit", r6("split_r").alias("split_r"), r6("ceiling").alias("ceiling"))


@query(f"""WITH {TRIALS}, {ODD_EVEN} SELECT count(ceiling) AS n_units, {R('avg(ceiling)')} AS mean_ceiling, {R('median(ceiling)')} AS median_ceiling,
 count(*) FILTER (ceiling > 0) AS n_above_0, count(*) FILTER (ceiling > 0.1) AS n_above_0_1, count(*) FILTER (ceiling > 0.2) AS n_above_0_2,
 count(*) FILTER (ceiling > 0.5) AS n_above_0_5 FROM ce""")
def ceiling_summary(spark, d):
    s = reliability.ceiling_summary(reliability.odd_even_ceiling(trials(spark, d)))
    return s.withColumn("mean_ceiling", r6("mean_ceiling")).withColumn("median_ceiling", r6("median_ceiling"))


@query(f"""WITH {TRIALS}, {ODD_EVEN}, keep AS (SELECT unit FROM ce WHERE ceiling > 0.15),
 s AS (SELECT stimulus, {SQL_R} AS r FROM paired WHERE unit IN (SELECT unit FROM keep) GROUP BY 1)
 SELECT stimulus::BIGINT AS stimulus, {R('r')} AS split_r, {R(sql_sb('greatest(coalesce(r, 0), 0)'))} AS ceiling FROM s""")
def spatial_ceiling(spark, d):
    t = trials(spark, d)
    out = reliability.spatial_ceiling(t, reliability.odd_even_ceiling(t))
    return out.select(F.col("stimulus").cast("long").alias("stimulus"), r6("split_r").alias("split_r"), r6("ceiling").alias("ceiling"))


@query(f"""WITH {TRIALS}, m AS (SELECT unit, rep, avg(stimulus) AS mt, avg(value) AS mv, coalesce(covar_pop(value, stimulus) / nullif(var_pop(stimulus), 0), 0) AS b,
  var_pop(value) AS vv, covar_pop(value, stimulus) AS c, count(*) AS n FROM trials GROUP BY 1, 2),
 z AS (SELECT unit, rep, stimulus, value - mv - b * (stimulus - mt) AS e, sqrt(greatest(vv - b * c, 0) * n / nullif(n - 1, 0)) AS sd FROM trials JOIN m USING (unit, rep))
 SELECT unit, rep::BIGINT AS rep, stimulus::BIGINT AS stimulus, {R('CASE WHEN coalesce(sd, 0) < 1e-10 THEN 0.0::DOUBLE ELSE e / sd END')} AS z FROM z""")
def detrended_zscores(spark, d):
    out = reliability.detrend_zscore(trials(spark, d), ["unit", "rep"], "stimulus")
    return out.select("unit", F.col("rep").cast("long").alias("rep"), F.col("stimulus").cast("long").alias("stimulus"), r6("z").alias("z"))


# ---------------------------------------------------------------- scorers


@query(f"WITH {PAIRS} SELECT unit, {R(SQL_SBR)} AS pearson, {R(SQL_R2)} AS r2, {R('avg(pow(y - p, 2))')} AS mse, {R(SQL_CCC)} AS ccc FROM pairs GROUP BY 1")
def unit_scores_all(spark, d):
    out = scoring.score(pairs(spark, d), ["unit"], ["pearson", "r2", "mse", "ccc"])
    return out.select(F.col("unit").cast("long").alias("unit"), *[r6(c).alias(c) for c in ("pearson", "r2", "mse", "ccc")])


@query(f"""WITH {PAIRS}, g AS (SELECT label, unit, {SQL_R} AS r FROM pairs GROUP BY 1, 2)
 SELECT label::BIGINT AS label, unit, {R('CASE WHEN r <= 0 THEN r ELSE 2 * least(r, 0.999999) / (1 + least(r, 0.999999)) END')} AS clipped FROM g""")
def clipped_scores(spark, d):
    out = scoring.score(pairs(spark, d), ["label", "unit"], {"clipped": C.clipped_pearson})
    return out.select(F.col("label").cast("long").alias("label"), F.col("unit").cast("long").alias("unit"), r6("clipped").alias("clipped"))


@query(f"""WITH g AS (SELECT l_suppkey AS unit, l_quantity AS y, l_linenumber * 7.0::DOUBLE AS p FROM lineitem),
 u AS (SELECT unit, {SQL_R} AS r FROM g GROUP BY 1), c AS (SELECT CASE WHEN r <= 0 THEN r ELSE 2 * least(r, 0.999999) / (1 + least(r, 0.999999)) END AS c FROM u)
 SELECT {R('avg(c)')} AS mean, {R('median(c)')} AS median FROM c""")
def target_summary(spark, d):
    g = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_quantity").alias("y"), (F.col("l_linenumber") * 7.0).alias("p"))
    s = scoring.score(g, ["unit"], {"c": C.clipped_pearson})
    return scoring.summarise_targets(s, [], "c").select(r6("c_mean").alias("mean"), r6("c_median").alias("median"))


@query(f"""WITH {PAIRS}, g AS (SELECT label, unit, sum(pow(y - p, 2)) AS res, var_pop(y) * count(*) AS tot FROM pairs GROUP BY 1, 2)
 SELECT label::BIGINT AS label, {R('avg(1 - res / tot)')} AS uniform_average, {R('sum(tot - res) / sum(tot)')} AS variance_weighted FROM g GROUP BY 1""")
def r2_modes(spark, d):
    out = scoring.r2_summary(pairs(spark, d), ["label"])
    return out.select(F.col("label").cast("long").alias("label"), r6("uniform_average").alias("uniform_average"), r6("variance_weighted").alias("variance_weighted"))


@query(f"""WITH {PAIRS}, g AS (SELECT unit, covar_pop(y, p) * count(*) / greatest(sqrt(var_pop(y) * count(*)) * sqrt(var_pop(p) * count(*)), 1e-6) AS corr,
  {SQL_CCC} AS ccc, sum(pow(y - p, 2)) AS sse, count(*) AS n, stddev_samp(p) AS sp, stddev_samp(y) AS sy FROM pairs GROUP BY 1),
 f AS (SELECT -avg(corr) AS cl, 1 - avg(ccc) AS ccl, sum(sse) / sum(n) AS mse, avg(sp) / greatest(avg(sy), 1e-6) AS sr FROM g)
 SELECT {R('cl')} AS correlation_loss, {R('ccl')} AS ccc_loss, {R('mse')} AS mse, {R('sr')} AS scale_ratio, {R('mse + 0.3 * cl')} AS combined,
 {R('0.7 * mse + 0.3 * cl')} AS blended, {R('0.7 * mse + 0.3 * ccl')} AS ccc_mse FROM f""")
def regression_losses(spark, d):
    out = scoring.regression_losses(pairs(spark, d), 0.3)
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(f"""WITH {PAIRS}, s AS (SELECT label, unit, {SQL_SBR} AS s FROM pairs GROUP BY 1, 2), c AS (SELECT unit, avg(abs(y)) * 4 AS ceiling FROM pairs GROUP BY 1),
 f AS (SELECT label, median(s) AS m, median(s / ceiling) AS c FROM s JOIN c USING (unit) GROUP BY 1)
 SELECT {R('avg(m)')} AS final_unceiled, {R('avg(c)')} AS final FROM f""")
def score_rollup(spark, d):
    p = pairs(spark, d)
    s = scoring.score(p, ["label", "unit"], {"score": C.corrected_pearson})
    c = p.groupBy("unit").agg((F.avg(F.abs("y")) * 4).alias("ceiling"))
    out = scoring.rollup(s, c, [], fold="label")
    return out.select(r6("final_unceiled").alias("final_unceiled"), r6("final").alias("final"))


@query(f"""WITH {PAIRS}, s AS (SELECT label, unit // 4 AS unit, unit % 4 AS t, {SQL_SBR} AS s FROM pairs GROUP BY ALL), m AS (SELECT label, t, median(s) AS m FROM s GROUP BY 1, 2)
 SELECT t, {R('avg(m)')} AS final_score FROM m GROUP BY 1""")
def time_rollup(spark, d):
    s = scoring.score(pairs(spark, d), ["label", "unit"], {"score": C.corrected_pearson}).withColumn("t", F.col("unit") % 4)
    return scoring.rollup_time(s, [], "t", "label").select(F.col("t").cast("long").alias("t"), r6("final_score").alias("final_score"))


@query(f"""WITH {PAIRS}, q AS (SELECT label, unit, p AS y, y AS p FROM pairs), s AS (SELECT label, unit, {SQL_R2} AS s FROM q GROUP BY 1, 2),
 m AS (SELECT label, median(s) AS m FROM s GROUP BY 1) SELECT {R('avg(m)')} AS final FROM m""")
def inverse_rollup(spark, d):
    s = scoring.score(pairs(spark, d), ["label", "unit"], {"score": C.r_squared}, y="p", p="y")
    return scoring.rollup_inverse(s, [], "label").select(r6("final_unceiled_score").alias("final"))


# ---------------------------------------------------------------- regions and tuning


@query(f"""WITH {ATLAS}, lv AS (SELECT 'region' AS level, region AS name, pearson, r2 FROM located WHERE r2 IS NOT NULL
  UNION ALL SELECT 'hemi_region', hemi || '_' || region, pearson, r2 FROM located WHERE r2 IS NOT NULL
  UNION ALL SELECT 'group', grp, pearson, r2 FROM located JOIN bridge USING (region) WHERE r2 IS NOT NULL)
 SELECT level, name, {R('median(pearson)', 3)} AS median_pearson, {R('median(r2)', 3)} AS median_r2, count(*) AS n_units FROM lv GROUP BY 1, 2""")
def region_rollup(spark, d):
    out = regions.region_rollup(unit_scores(spark, d), atlas(spark, d), bridge(spark, d))
    return out.select("level", "name", r6("median_pearson", 3).alias("median_pearson"), r6("median_r2", 3).alias("median_r2"), "n_units")


@query(f"""WITH {ATLAS}, c AS (SELECT c_custkey AS unit, greatest(c_nationkey / 25.0::DOUBLE, 0.000001) AS ceiling FROM customer)
 SELECT grp AS mask, {R('median(pearson)', 3)} AS pearson_unceiled, {R('median(pearson / ceiling)', 3)} AS pearson_ceiled, count(*) AS n_units
 FROM located JOIN c USING (unit) JOIN bridge USING (region) GROUP BY 1""")
def region_global_scores(spark, d):
    s = unit_scores(spark, d).select("unit", "pearson")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("unit"), C.floor_ceiling(F.col("c_nationkey") / F.lit(25.0)).alias("ceiling"))
    masks = regions.attach_group(atlas(spark, d), bridge(spark, d)).select("unit", F.col("group").alias("mask"))
    out = regions.region_global(s, c, masks)
    return out.select("mask", r6("pearson_unceiled", 3).alias("pearson_unceiled"), r6("pearson_ceiled", 3).alias("pearson_ceiled"), "n_units")


CURVES = f"""{TUNING}, cu AS (SELECT unit, angle, avg(response) AS r FROM tuning GROUP BY 1, 2), lf AS (SELECT unit, abs(min(r)) AS l FROM cu GROUP BY 1),
 cv AS (SELECT unit, 1 - sqrt(pow(sum((r + l) * cos(2 * radians(angle))), 2) + pow(sum((r + l) * sin(2 * radians(angle))), 2)) / nullif(sum(r + l), 0) AS cv
  FROM cu JOIN lf USING (unit) GROUP BY 1)"""


@query(f"WITH {CURVES} SELECT unit, {R('cv')} AS cv FROM cv")
def circular_variance(spark, d):
    return tuning.circular_variance(tuning_view(spark, d)).select("unit", r6("cv").alias("cv"))


@query(f"""WITH {CURVES} SELECT {R('avg(cv)')} AS mean_cv, {R('median(cv)')} AS median_cv,
 {R('100.0 * count(*) FILTER (cv < (SELECT avg(cv) FROM cv)) / count(*)')} AS pct_below_mean, {R('100.0 * count(*) FILTER (cv < 0.6) / count(*)')} AS pct_below_06 FROM cv""")
def tuning_summary(spark, d):
    out = tuning.selectivity_summary(tuning.circular_variance(tuning_view(spark, d)))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(f"""WITH {CURVES}, pr AS (SELECT unit, min(angle) AS a FROM cu JOIN (SELECT unit, max(r) AS m FROM cu GROUP BY 1) USING (unit) WHERE r = m GROUP BY 1),
 c AS (SELECT count(*) FILTER (a = 0)::DOUBLE AS c0, count(*) FILTER (a = 45)::DOUBLE AS c45, count(*) FILTER (a = 90)::DOUBLE AS c90, count(*) FILTER (a = 135)::DOUBLE AS c135 FROM pr),
 t AS (SELECT *, 2 * c0 + c45 + c90 + c135 AS tot FROM c)
 SELECT {R('100 * c0 / tot')} AS pct_0, {R('100 * c45 / tot')} AS pct_45, {R('100 * c90 / tot')} AS pct_90, {R('100 * c135 / tot')} AS pct_135,
 {R('100 * c0 / tot')} AS pct_180, {R('(2 * c0 + c90) / tot')} AS cardinality_index FROM t""")
def orientation_preference(spark, d):
    out = tuning.orientation_preference(tuning_view(spark, d))
    return out.select(*[r6(c).alias(c) for c in out.columns])


# ---------------------------------------------------------------- statistics


@query(f"SELECT u AS unit, {R('avg(embedding[u + 1]::DOUBLE)')} AS mean, {R('greatest(stddev_samp(embedding[u + 1]::DOUBLE), 1e-12)')} AS std FROM embeddings, (SELECT unnest(range(64)) AS u) GROUP BY 1")
def feature_statistics(spark, d):
    return scoring.feature_stats(vectors(spark, d), "vec").select(F.col("unit").cast("long").alias("unit"), r6("mean").alias("mean"), r6("std").alias("std"))


@query(f"SELECT l_suppkey, {R('avg(l_quantity)')} AS mean, {R('greatest(stddev_samp(l_quantity), 1e-8)')} AS std, count(*) AS n FROM lineitem GROUP BY 1")
def label_statistics(spark, d):
    return scoring.label_stats(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity").withColumn("mean", r6("mean")).withColumn("std", r6("std"))


@query(f"""WITH m AS (SELECT l_suppkey, median(l_extendedprice) AS med FROM lineitem GROUP BY 1),
 s AS (SELECT l_suppkey, min(med) AS med, median(abs(l_extendedprice - med)) AS mad FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1)
 SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, {R('(l_extendedprice - med) / (mad * 1.4826 + 1e-8)', 5)} AS z FROM lineitem JOIN s USING (l_suppkey)""")
def robust_zscores(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    return scoring.robust_zscore(li, ["l_suppkey"], "l_extendedprice").drop("l_extendedprice").withColumn("z", r6("z", 5))


@query("""WITH c AS (SELECT 'label' AS name, label::VARCHAR AS v FROM embeddings UNION ALL SELECT 'order', o_orderkey::VARCHAR FROM orders),
 n AS (SELECT name, v, count(*) AS n FROM c GROUP BY 1, 2)
 SELECT name, count(*) AS n_classes, min(n) AS smallest, count(*) >= 2 AND min(n) >= 2 AS stratify FROM n GROUP BY 1""")
def stratify_check(spark, d):
    a = scoring.can_stratify(table(spark, d, "embeddings"), "label").withColumn("name", F.lit("label"))
    b = scoring.can_stratify(table(spark, d, "orders"), "o_orderkey").withColumn("name", F.lit("order"))
    return a.unionByName(b).select("name", "n_classes", "smallest", "stratify")


@query(f"WITH {TRIALS} SELECT unit, stimulus::BIGINT AS stimulus, {R('avg(value)')} AS value FROM trials GROUP BY 1, 2")
def trial_means(spark, d):
    out = reliability.average_repetition(trials(spark, d), ["unit", "stimulus"])
    return out.select("unit", F.col("stimulus").cast("long").alias("stimulus"), r6("value").alias("value"))
