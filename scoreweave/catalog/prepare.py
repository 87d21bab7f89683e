"""Filters, id clean-up, masks, remaps and row expansion over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import decide_binary, decide_multiclass, finite_or_zero, floor_ceiling, r6
from ..operators import prep
from . import query
from .views import CHOICES, R, choices, table, vectors

CLASS_LIST = ", ".join(f"({c}, {i})" for i, c in enumerate(prep.ACTION_CLASSES))
RANGE_LIST = ", ".join(f"('{s}', '{r}', {a}, {b})" for s, r, a, b in prep.CHANNEL_RANGES)
ROI = ("ventral", "highventral", "midventral", "parietal", "V1", "V1d")


@query("""SELECT doc_id FROM documents WHERE lang NOT IN ('en', 'fr') AND n_chars > 500 AND doc_id IN (SELECT doc_id FROM labels)""")
def split_filter_test(spark, d):
    s = table(spark, d, "documents").select(
        "doc_id", F.col("doc_id").alias("stimulus_id"), F.col("lang").isin("en", "fr").cast("int").alias("train"),
        (F.col("n_chars") > 500).cast("int").alias("intra_generalizability"),
    )
    seen = table(spark, d, "labels").select(F.col("doc_id").alias("stimulus_id"))
    return prep.split_filter(s, train=False, intra=True, behaviour=seen).select("doc_id")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def sentinel_drop(spark, d):
    li = table(spark, d, "lineitem").withColumn("contacts", F.when(F.col("l_returnflag") == "R", -1).otherwise(F.col("l_linenumber")))
    return prep.drop_sentinel(li, "contacts").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, source || '_' || doc_id AS clean, lang || '_' || doc_id AS base FROM documents""")
def normalised_ids(spark, d):
    x = table(spark, d, "documents")
    path = F.concat(F.lit("videos/test.set/"), "source", F.lit("_"), "doc_id", F.lit("_img03.mp4.bak"))
    sim = F.concat("lang", F.lit("_"), "doc_id", F.lit("_sim_001"))
    return x.select("doc_id", prep.norm_id(path).alias("clean"), prep.drop_tail(sim, 8).alias("base"))


@query(f"""WITH m(class, idx) AS (VALUES {CLASS_LIST})
 SELECT idx::BIGINT AS idx, count(*) AS n FROM lineitem JOIN m ON class = l_partkey % 180 GROUP BY 1""")
def class_remap(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_partkey") % 180).cast("int").alias("class"))
    out = prep.remap_classes(li, prep.class_mapping(spark))
    return out.groupBy(F.col("idx").cast("long").alias("idx")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS class_idx FROM orders")
def class_densify(spark, d):
    out = prep.dense_labels(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey")
    return out.select("o_orderkey", F.col("class_idx").cast("long").alias("class_idx"))


@query("""WITH v AS (SELECT 'toxic' AS name, toxic::DOUBLE AS x FROM labels UNION ALL SELECT 'discount', l_discount FROM lineitem
  UNION ALL SELECT 'part', l_partkey FROM lineitem),
 s AS (SELECT name, count(DISTINCT x) AS n, min(x) AS lo, max(x) AS hi, bool_and(x IN (0, 1)) AS b FROM v GROUP BY 1)
 SELECT name, CASE WHEN n = 2 AND b THEN 'binary' WHEN lo >= 0 AND hi <= 1 AND n > 2 THEN 'soft_binary' ELSE 'multiclass' END AS task,
  n AS n_values FROM s""")
def target_task_types(spark, d):
    li = table(spark, d, "lineitem")
    out = prep.task_type(table(spark, d, "labels"), "toxic").withColumn("name", F.lit("toxic"))
    out = out.unionByName(prep.task_type(li, "l_discount").withColumn("name", F.lit("discount")))
    out = out.unionByName(prep.task_type(li, "l_partkey").withColumn("name", F.lit("part")))
    return out.select("name", "task", "n_values")


@query(f"""WITH r(subject, region, lo, hi) AS (VALUES {RANGE_LIST}),
 u AS (SELECT 'monkey' || CASE WHEN l_linestatus = 'F' THEN 'F' ELSE 'N' END AS subject, l_partkey % 1024 AS unit, l_quantity FROM lineitem)
 SELECT u.subject, region, count(*) AS n, {R('avg(l_quantity)')} AS mean FROM u JOIN r ON u.subject = r.subject AND unit >= lo AND unit < hi GROUP BY ALL""")
def channel_regions(spark, d):
    li = table(spark, d, "lineitem").select(
        F.concat(F.lit("monkey"), F.when(F.col("l_linestatus") == "F", "F").otherwise("N")).alias("subject"),
        (F.col("l_partkey") % 1024).alias("unit"), "l_quantity",
    )
    out = prep.select_channels(li, prep.channel_ranges(spark))
    return out.groupBy("subject", "region").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("l_quantity")).alias("mean"))


@query(f"""WITH c AS (SELECT c_custkey, c_acctbal, CASE c_mktsegment WHEN 'BUILDING' THEN 'ventral' WHEN 'AUTOMOBILE' THEN 'midventral'
   WHEN 'MACHINERY' THEN 'parietal' ELSE 'early' END AS ls, CASE WHEN c_nationkey < 8 THEN 'ventral' WHEN c_nationkey < 16 THEN 'midparietal' END AS rs,
   CASE WHEN c_nationkey < 5 THEN 'V1v' WHEN c_nationkey < 10 THEN 'V1d' ELSE 'hV4' END AS vis FROM customer),
 t AS (SELECT *, unnest(['ventral', 'highventral', 'midventral', 'parietal', 'V1', 'V1d']) AS roi FROM c)
 SELECT roi, count(*) AS n, {R('sum(c_acctbal)', 2)} AS total FROM t WHERE coalesce(CASE
   WHEN roi = 'highventral' THEN ls = 'ventral' OR coalesce(rs = 'ventral', false)
   WHEN roi LIKE 'V1%' THEN contains(vis, roi) ELSE contains(ls, roi) OR coalesce(contains(rs, roi), false) END, false) GROUP BY 1""")
def region_labels(spark, d):
    c = table(spark, d, "customer")
    seg, nk = F.col("c_mktsegment"), F.col("c_nationkey")
    tagged = c.select(
        "c_custkey", "c_acctbal",
        F.when(seg == "BUILDING", "ventral").when(seg == "AUTOMOBILE", "midventral").when(seg == "MACHINERY", "parietal").otherwise("early").alias("ls"),
        F.when(nk < 8, "ventral").when(nk < 16, "midparietal").alias("rs"),
        F.when(nk < 5, "V1v").when(nk < 10, "V1d").otherwise("hV4").alias("vis"),
    )
    out = prep.select_roi(tagged, ROI, ["ls", "rs"], ["vis"])
    return out.groupBy("roi").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name LIKE 'A%' OR n_name LIKE 'NATION_1%' OR n_name LIKE '%A' OR n_name LIKE '%5' GROUP BY 1")
def region_affixes(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    named = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    hit = prep.select_roi_affix(named, "n_name", ["A", "5"]).select("c_custkey", "n_name").unionByName(
        named.where(F.col("n_name").startswith("NATION_1")).select("c_custkey", "n_name")).distinct()
    return hit.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH c AS (SELECT l_suppkey AS unit, avg(l_discount) AS train_c, avg(l_tax) AS test_c FROM lineitem GROUP BY 1)
 SELECT l_suppkey AS unit, count(*) AS n, {R('avg(l_quantity)')} AS mean FROM lineitem WHERE l_suppkey IN
  (SELECT unit FROM c WHERE train_c > 0.049 AND test_c > 0.0395) GROUP BY 1""")
def reliability_mask(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "unit")
    train = li.groupBy("unit").agg(F.avg("l_discount").alias("ceiling"))
    test = li.groupBy("unit").agg(F.avg("l_tax").alias("ceiling"))
    kept = prep.mask_by_ceiling(li, train, 0.049, test_ceilings=test, test_threshold=0.0395)
    return kept.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("l_quantity")).alias("mean"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 45 THEN 0.0::DOUBLE WHEN l_quantity < 3 THEN 100.0::DOUBLE
 WHEN l_quantity < 6 THEN -100.0::DOUBLE ELSE l_quantity END AS value FROM lineitem""")
def value_cleaning(spark, d):
    q = F.col("l_quantity")
    dirty = F.when(q > 45, F.lit(float("nan"))).when(q < 3, F.lit(float("inf"))).when(q < 6, F.lit(float("-inf"))).otherwise(q)
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", finite_or_zero(dirty, clip=100.0).alias("value"))


@query(f"SELECT s_suppkey, {R('greatest(s_acctbal / 10000, 0.000001)')} AS ceiling, {R('greatest(s_acctbal / 10000, 0.001)')} AS clipped FROM supplier")
def ceiling_floor(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 10000).alias("c"))
    return s.select("s_suppkey", r6(floor_ceiling("c")).alias("ceiling"), r6(floor_ceiling("c", 1e-3)).alias("clipped"))


@query(f"""WITH k AS (SELECT i FROM (SELECT unnest(range(64)) AS i) ORDER BY md5('42:' || i) LIMIT 16),
 p AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS unit FROM k)
 SELECT vec_id, unit, {R('embedding[i + 1]::DOUBLE')} AS value FROM embeddings, p""")
def feature_subsample(spark, d):
    out = prep.subsample_features(vectors(spark, d), "vec", 64, 16).select("vec_id", F.posexplode("vec").alias("unit", "value"))
    return out.select("vec_id", F.col("unit").cast("long").alias("unit"), r6("value").alias("value"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('error', 'view') GROUP BY 1")
def name_exclusion(spark, d):
    return prep.exclude(table(spark, d, "events"), "event_type", ["error", "view"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations),
 k AS (SELECT conv_id, pos // 2 AS slot, turn, text FROM n WHERE pos % 2 = 0 AND pos // 2 < 4),
 l AS (SELECT conv_id, max(slot) AS last FROM k GROUP BY 1),
 g AS (SELECT conv_id, last, unnest(range(4)) AS slot FROM l)
 SELECT g.conv_id, g.slot, k.turn, md5(k.text) AS digest FROM g JOIN k ON k.conv_id = g.conv_id AND k.slot = least(g.slot, last)""")
def sequence_resample(spark, d):
    out = prep.resample_sequence(table(spark, d, "conversations"), "conv_id", "turn", fps=2.0, target_fps=1.0, seconds=4)
    return out.select("conv_id", F.col("slot").cast("long").alias("slot"), "turn", F.md5("text").alias("digest"))


@query("SELECT p_partkey, k AS repetition, 2 * k + 3 AS n_frames FROM part, (SELECT unnest(range(18)) AS k)")
def repeat_expansion(spark, d):
    out = prep.expand_repeats(table(spark, d, "part"))
    return out.select("p_partkey", F.col("repetition").cast("long").alias("repetition"), F.col("n_frames").cast("long").alias("n_frames"))


@query("""SELECT vec_id, (1 / (1 + exp(-embedding[1]::DOUBLE)) > 0.5)::BIGINT AS yes,
 list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings""")
def decision_rule(spark, d):
    v = vectors(spark, d)
    return v.select("vec_id", decide_binary(F.col("vec")[0]).cast("long").alias("yes"), decide_multiclass("vec").cast("long").alias("best"))


@query(f"WITH {CHOICES} SELECT stimulus, stimulus::VARCHAR AS name, model::DOUBLE AS gt, human::DOUBLE AS behav FROM choices")
def target_forms(spark, d):
    out = prep.normalise_targets(choices(spark, d), "model", "human", "stimulus")
    return out.select("stimulus", F.col("target.stimulus").alias("name"), F.col("target.gt").alias("gt"), F.col("target.behav").alias("behav"))


@query("""SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND trim(CASE WHEN role = 'system' THEN '  ' ELSE text END) <> ''""")
def empty_drop(spark, d):
    c = table(spark, d, "conversations").withColumn("text", F.when(F.col("role") == "system", "  ").otherwise(F.col("text")))
    return prep.drop_empty(c, text="text").select("conv_id", "turn")


@query("SELECT vec_id FROM embeddings WHERE list_max(list_transform(embedding, lambda x: abs(x)))::DOUBLE >= 0.3")
def silent_drop(spark, d):
    return prep.drop_empty(vectors(spark, d), signal="vec", silence=0.3).select("vec_id")


@query("SELECT md5(url) AS page, md5(string_split(string_split(string_split(url, '/')[-1], '.')[1], '_img')[1]) AS clean FROM pages")
def url_ids(spark, d):
    return table(spark, d, "pages").select(F.md5("url").alias("page"), F.md5(prep.norm_id("url")).alias("clean"))
