"""Alignment joins, set operations and run planning over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import floor_ceiling, r6
from ..functions.registry import METRIC_GROUPS
from ..operators import align, regions
from ..operators.gram import cross_correlation, moments
from ..plans import planning
from . import query
from .views import CHOICES, INTERVALS, PAIRS, R, STORIES, choices, halves, intervals, stories, table, vectors

RULES = [(0, "ECONOMY A", ["tr_level", "offline_regression"]), (1, "ECONOMY", ["offline_similarity"]),
         (2, "PROMO", ["topographic", "offline_similarity", "offline_regression"]), (3, "S", ["online_regression"]),
         (4, "TYPE", ["tr_level", "offline_regression"])]
RULE_SQL = ", ".join(f"({i}, '{p}', {j}, '{g}')" for i, p, gs in RULES for j, g in enumerate(gs))
GROUP_SQL = ", ".join(f"('{g}', {i}, '{m}')" for g, ms in METRIC_GROUPS.items() for i, m in enumerate(ms))
PLAN_METRICS = ("chunked_ridge", "ridge", "rsa", "pls")


@query(f"""WITH r AS (SELECT o_custkey AS id, avg(o_totalprice) AS response FROM orders GROUP BY 1)
 SELECT vec_id, label::BIGINT AS label, {R('response')} AS response, {R('embedding[1]::DOUBLE')} AS x0 FROM embeddings JOIN r ON vec_id = id""")
def align_by_stimulus(spark, d):
    f = vectors(spark, d).withColumnRenamed("vec_id", "stimulus_id")
    r = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("stimulus_id")).agg(F.avg("o_totalprice").alias("response"))
    return align.align(f, r).select(
        F.col("stimulus_id").alias("vec_id"), F.col("label").cast("long").alias("label"), r6("response").alias("response"),
        r6(F.col("vec")[0]).alias("x0"))


@query("""WITH m AS (SELECT l_partkey AS k, min_by(l_quantity, l_orderkey * 10000000 + l_linenumber * 1000000 + l_suppkey) AS mq,
   min_by(l_suppkey, l_orderkey * 10000000 + l_linenumber * 1000000 + l_suppkey) AS ms FROM lineitem GROUP BY 1),
 h AS (SELECT o_custkey AS k, min_by(o_totalprice, o_orderkey) AS hp FROM orders GROUP BY 1)
 SELECT k, mq, ms, hp FROM m JOIN h USING (k)""")
def align_first_rows(spark, d):
    m = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("k"), F.col("l_quantity").alias("q"), F.col("l_suppkey").alias("s"),
        (F.col("l_orderkey") * 10000000 + F.col("l_linenumber") * 1000000 + F.col("l_suppkey")).alias("ord"))
    h = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("p"), F.col("o_orderkey").alias("ord"))
    out = align.align_first(m, h, "k", "ord")
    return out.select("k", F.col("model_q").alias("mq"), F.col("model_s").alias("ms"), F.col("human_p").alias("hp"))


@query(f"WITH {CHOICES} SELECT doc_id, scenario FROM documents JOIN choices ON doc_id = stimulus")
def scenario_lookup(spark, d):
    m = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("stimulus_id"))
    h = choices(spark, d).select(F.col("stimulus").alias("stimulus_id"), "scenario")
    return align.attach_scenario(m, h).select("doc_id", "scenario")


@query("""WITH m AS (SELECT DISTINCT s_name AS model, s_nationkey::VARCHAR AS layer, s_nationkey AS nk FROM supplier),
 plan AS (SELECT model, layer, nk, r_name AS benchmark, unnest(['chunked_ridge', 'ridge', 'rsa', 'pls']) AS metric FROM m, region),
 done AS (SELECT model, layer, benchmark, CASE WHEN nk < 9 THEN 'ridge' WHEN nk < 17 THEN 'chunked_ridge' ELSE 'rsa' END AS metric FROM plan)
 SELECT model, layer, benchmark, metric FROM plan p WHERE NOT EXISTS (SELECT 1 FROM done q WHERE p.model = q.model AND p.layer = q.layer
  AND p.benchmark = q.benchmark AND (q.metric = p.metric OR (p.metric = 'chunked_ridge' AND q.metric = 'ridge')))""")
def missing_experiments(spark, d):
    s = table(spark, d, "supplier")
    models = s.select(F.col("s_name").alias("model"), F.col("s_nationkey").cast("string").alias("layer")).distinct()
    plan = planning.plan_runs(models, table(spark, d, "region").withColumnRenamed("r_name", "benchmark"), PLAN_METRICS)
    nk = F.col("layer").cast("int")
    done = plan.withColumn("metric", F.when(nk < 9, "ridge").when(nk < 17, "chunked_ridge").otherwise("rsa")).distinct()
    return planning.missing_runs(plan, done, planning.synonym_table(spark))


@query(f"""WITH {STORIES}, n AS (SELECT story, max(t) + 1 AS n FROM stories GROUP BY 1)
 SELECT a.story::BIGINT AS story, a.t AS feature_t, b.t AS response_t, {R('a.x[1]')} AS x0, {R('b.y[1]')} AS y0
 FROM stories a JOIN stories b ON a.story = b.story AND b.t = a.t + 2 JOIN n ON n.story = a.story WHERE n.n >= 3""")
def lagged_alignment(spark, d):
    s = stories(spark, d)
    out = align.lag_align(s.select("story", "t", "x"), s.select("story", "t", "y"), "story", "t", 2)
    return out.select(
        F.col("story").cast("long").alias("story"), F.col("feature_t").cast("long").alias("feature_t"),
        F.col("response_t").cast("long").alias("response_t"), r6(F.col("x")[0]).alias("x0"), r6(F.col("y")[0]).alias("y0"))


@query(f"""WITH c AS (SELECT l_suppkey AS unit, greatest(avg(l_tax) - 0.03, 0.000001) AS ceiling FROM lineitem GROUP BY 1),
 s AS (SELECT l_suppkey AS unit, avg(l_discount) AS score FROM lineitem GROUP BY 1)
 SELECT unit, {R('score')} AS score, {R('score / ceiling', 4)} AS ceiled FROM s JOIN c USING (unit)""")
def ceiling_division(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "unit")
    c = li.groupBy("unit").agg(floor_ceiling(F.avg("l_tax") - 0.03).alias("ceiling"))
    s = li.groupBy("unit").agg(F.avg("l_discount").alias("score"))
    return align.apply_ceiling(s, c, ["unit"]).select("unit", r6("score").alias("score"), r6("ceiled_score", 4).alias("ceiled"))


@query(f"""WITH c AS (SELECT n_nationkey AS unit, (n_regionkey % 3)::DOUBLE AS ceiling FROM nation)
 SELECT c_custkey, {R('CASE WHEN ceiling = 0 THEN c_acctbal ELSE c_acctbal / ceiling END')} AS ceiled FROM customer JOIN c ON unit = c_nationkey""")
def ceiling_keeps_raw(spark, d):
    c = table(spark, d, "nation").select(F.col("n_nationkey").alias("unit"), (F.col("n_regionkey") % 3).cast("double").alias("ceiling"))
    s = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("unit"), F.col("c_acctbal").alias("score"))
    return align.apply_ceiling_keep_raw(s, c, ["unit"]).select("c_custkey", r6("ceiled_score").alias("ceiled"))


@query(f"""WITH b AS (SELECT r_name AS grp, n_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'letter_' || substr(n_name, 1, 1), n_name FROM nation UNION ALL SELECT 'not_asia', n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')
 SELECT grp AS "group", count(*) AS n, {R('sum(c_acctbal)', 2)} AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN b ON region = n_name GROUP BY 1""")
def overlapping_groups(spark, d):
    from .views import atlas, bridge

    b = bridge(spark, d)
    b = b.unionByName(regions.complement_group(b, table(spark, d, "nation").select(F.col("n_name").alias("region")), "ASIA", "not_asia"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("unit"), "c_acctbal")
    out = regions.attach_group(regions.attach_region(c, atlas(spark, d)), b)
    return out.groupBy("group").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("c_acctbal"), 2).alias("total"))


@query(f"""WITH {PAIRS.replace('pairs AS', 'p0 AS')}
 SELECT a.unit AS source, b.unit AS target, {R('corr(a.p, b.y)')} AS r FROM p0 a JOIN p0 b USING (vec_id) GROUP BY 1, 2""")
def unit_cross_correlation(spark, d):
    m = moments(halves(spark, d).withColumn("part", F.lit("all")), "part", "x", "y", parts=1)
    out = cross_correlation(m).select("target", F.posexplode("r").alias("source", "r"))
    return out.select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"), r6("r").alias("r"))


@query(f"""WITH t AS (SELECT 'a' AS subject, user_id AS unit, day(ts) - 1 AS t, value FROM events WHERE event_type IN ('click', 'view')
   UNION ALL SELECT 'b', user_id, hour(ts), value FROM events WHERE event_type NOT IN ('click', 'view')),
 n AS (SELECT min(n) AS n FROM (SELECT subject, max(t) + 1 AS n FROM t GROUP BY 1))
 SELECT subject, t::BIGINT AS t, count(*) AS n, {R('avg(value)')} AS mean FROM t WHERE t < (SELECT n FROM n) GROUP BY 1, 2""")
def subject_stack(spark, d):
    e = table(spark, d, "events")
    few = F.col("event_type").isin("click", "view")
    a = e.where(few).select(F.lit("a").alias("subject"), F.col("user_id").alias("unit"), (F.dayofmonth("ts") - 1).alias("t"), "value")
    b = e.where(~few).select(F.lit("b").alias("subject"), F.col("user_id").alias("unit"), F.hour("ts").alias("t"), "value")
    out = align.stack_subjects([a, b], "t")
    return out.groupBy("subject", F.col("t").cast("long").alias("t")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"))


@query(f"""WITH r(priority, prefix, gpos, grp) AS (VALUES {RULE_SQL}), g(grp, pos, metric) AS (VALUES {GROUP_SQL}),
 names AS (SELECT DISTINCT p_type AS name FROM part),
 first AS (SELECT name, min(priority) AS priority FROM names JOIN r ON starts_with(name, prefix) GROUP BY 1)
 SELECT name, metric, min(gpos * 1000 + pos)::BIGINT AS position FROM first JOIN r USING (priority) JOIN g USING (grp) GROUP BY 1, 2""")
def compatible_metrics(spark, d):
    names = table(spark, d, "part").select(F.col("p_type").alias("name"))
    rules = spark.createDataFrame(RULES, "priority int, prefix string, groups array<string>")
    out = planning.compatible_metrics(names, rules=rules)
    return out.select("name", "metric", F.col("position").cast("long").alias("position"))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def id_intersection(spark, d):
    return align.intersect_ids(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT 'customer' AS side, c_nationkey::BIGINT AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier")
def side_union(spark, d):
    c = table(spark, d, "customer").select(F.lit("customer").alias("side"), F.col("c_nationkey").cast("long").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("side"), F.col("s_nationkey").cast("long").alias("nation"), F.col("s_acctbal").alias("balance"))
    return align.stack_subjects([c, s])


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def id_difference(spark, d):
    return align.except_ids(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def ordered_dedup(spark, d):
    return align.ordered_dedup(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query("""WITH a AS (SELECT l_partkey AS i, l_suppkey AS j, max(CASE WHEN l_discount > 0.02 THEN l_quantity END) AS a,
  max(CASE WHEN l_tax > 0.02 THEN l_extendedprice END) AS b FROM lineitem GROUP BY 1, 2) SELECT * FROM a WHERE a IS NOT NULL AND b IS NOT NULL""")
def valid_entries(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), "l_discount", "l_tax", "l_quantity", "l_extendedprice")
    a = li.groupBy("i", "j").agg(F.max(F.when(F.col("l_discount") > 0.02, F.col("l_quantity"))).alias("dist"))
    b = li.groupBy("i", "j").agg(F.max(F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice"))).alias("dist"))
    return align.valid_pairs(a, b.withColumn("dist", F.coalesce("dist", F.lit(float("nan")))), ["i", "j"])


@query(f"""WITH {INTERVALS} SELECT story, count(*) AS n, {R('max(t1)')} AS last FROM intervals GROUP BY 1""")
def interval_lengths(spark, d):
    return intervals(spark, d).groupBy("story").agg(F.count(F.lit(1)).alias("n"), r6(F.max("t1")).alias("last"))
