"""Time bins, context, segments, ranks and picks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..functions.ordering import grouped_median
from ..operators import regions, windows
from ..operators.similarity import rank_values
from . import query
from .views import INTERVALS, R, STORIES, intervals, stories, table

DAY = 86400.0
BINNED = f"""{INTERVALS}, b AS (SELECT *, floor((t0 + t1) / 2 / {DAY})::BIGINT AS bin FROM intervals),
 n AS (SELECT story, ceil(max(t1) / {DAY})::BIGINT AS n FROM intervals GROUP BY 1), f AS (SELECT story, unnest(range(n)) AS bin FROM n)"""


@query(f"""WITH {BINNED} SELECT f.story, f.bin, count(word) AS n_words, coalesce(string_agg(word, ' ' ORDER BY seq), '') AS words
 FROM f LEFT JOIN b ON b.story = f.story AND b.bin = f.bin GROUP BY 1, 2""")
def interval_bins(spark, d):
    out = windows.bin_intervals(intervals(spark, d), "story", DAY)
    return out.select("story", F.col("bin").cast("long").alias("bin"), F.col("n_words").cast("long").alias("n_words"), F.array_join("words", " ").alias("words"))


@query(f"""WITH {BINNED} SELECT f.story, f.bin, md5(coalesce(string_agg(word, ' ' ORDER BY seq), '')) AS digest, count(word) AS n
 FROM f LEFT JOIN b ON b.story = f.story AND b.bin <= f.bin GROUP BY 1, 2""")
def cumulative_text(spark, d):
    out = windows.cumulative_text(intervals(spark, d), "story", DAY)
    n = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", " ")))
    return out.select("story", F.col("bin").cast("long").alias("bin"), F.md5("text").alias("digest"), n.cast("long").alias("n"))


@query(f"""WITH {BINNED}, w AS (SELECT f.story, f.bin, list(word ORDER BY seq) FILTER (word IS NOT NULL) AS w FROM f LEFT JOIN b ON b.story = f.story AND b.bin <= f.bin GROUP BY 1, 2)
 SELECT story, bin, coalesce(array_to_string(w[-8:], ' '), '') AS tail FROM w""")
def cumulative_text_tail(spark, d):
    out = windows.cumulative_text(intervals(spark, d), "story", DAY, max_words=8)
    return out.select("story", F.col("bin").cast("long").alias("bin"), F.col("text").alias("tail"))


SIGNAL = "sig AS (SELECT user_id AS story, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


def signal(spark, d):
    from ..functions.ordering import ordered_row_number

    e = table(spark, d, "events").select(F.col("user_id").alias("story"), "event_id", "value")
    return ordered_row_number(e, ["story"], ["event_id"], "pos").select("story", (F.col("pos") - 1).alias("i"), "value")


@query(f"""WITH {SIGNAL}, g AS (SELECT story, i // 10 AS segment, count(*) AS k, sum(value) AS total, max_by(value, i) AS last FROM sig GROUP BY 1, 2)
 SELECT story, segment, 10::BIGINT AS size, {R('total')} AS total, {R('CASE WHEN k = 10 THEN last ELSE 0 END')} AS last FROM g WHERE k = 10 OR (segment > 0 AND k > 5)""")
def signal_segments(spark, d):
    out = windows.segments(signal(spark, d), "story", "i", "value", 10)
    return out.select(
        "story", F.col("segment").cast("long").alias("segment"), F.size("samples").cast("long").alias("size"),
        r6(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)).alias("total"), r6(F.element_at("samples", -1)).alias("last"))


@query(f"""WITH {SIGNAL}, nn AS (SELECT story, min(n) AS n FROM sig GROUP BY 1),
 sg AS (SELECT story, n, unnest(range(CASE WHEN n // 10 > 0 AND n % 10 > 5 THEN n // 10 + 1 ELSE n // 10 END)) AS segment FROM nn),
 w AS (SELECT story, segment, least((segment + 1) * 10, n) AS e FROM sg)
 SELECT w.story, segment, 25::BIGINT AS size, {R('sum(value * (25 - (e - i) + 1))')} AS weighted FROM w JOIN sig ON sig.story = w.story AND i < e AND i >= e - 25 GROUP BY 1, 2""")
def context_windows(spark, d):
    out = windows.context_windows(signal(spark, d), "story", "i", "value", 10, 25)
    weighted = F.aggregate(F.zip_with("samples", F.sequence(F.lit(1), F.lit(25)), lambda x, k: x * k), F.lit(0.0), lambda a, x: a + x)
    return out.select("story", F.col("segment").cast("long").alias("segment"), F.size("samples").cast("long").alias("size"), r6(weighted).alias("weighted"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 7")
def head_per_story(spark, d):
    return windows.head_per_key(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", ["ts", "event_id"], 7).select("user_id", "event_id")


@query("SELECT s_suppkey, t, 25 + 25 * t AS t_ms, s_suppkey * 7 + t AS row FROM supplier, (SELECT unnest(range(7)) AS t)")
def time_bin_rows(spark, d):
    out = windows.flatten_time(windows.time_bins(table(spark, d, "supplier")), "s_suppkey", "t", 7)
    return out.select("s_suppkey", F.col("t").cast("long").alias("t"), F.col("t_ms").cast("long").alias("t_ms"), "row")


@query(f"""SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, {R('rank() OVER w + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0::DOUBLE')} AS avg_rank
 FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity)""")
def average_ranks(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity")
    return rank_values(li, ["l_suppkey"], "l_quantity").drop("l_quantity").withColumn("avg_rank", r6("avg_rank"))


GRID = """g AS (SELECT l_suppkey AS run, l_linenumber AS pos, max(floor(l_quantity / 10)) AS score FROM lineitem GROUP BY 1, 2)"""


def grid_rows(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("pos")).agg(
        F.max(F.floor(F.col("l_quantity") / 10)).cast("double").alias("score"))


@query(f"WITH {GRID} SELECT run, pos::BIGINT AS pos, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, pos) AS rn FROM g) WHERE rn = 1")
def best_hyperparameter(spark, d):
    return windows.pick_best(grid_rows(spark, d), ["run"], "score", "pos").select("run", F.col("pos").cast("long").alias("pos"), "score")


@query(f"WITH {GRID} SELECT pos % 2 = 0 AS task, max(score)::DOUBLE AS score FROM g GROUP BY 1")
def best_run(spark, d):
    g = grid_rows(spark, d).withColumn("task", F.col("pos") % 2 == 0).withColumn("pos", F.col("run"))
    return windows.best_run(g, ["task"], "score", "pos").select("task", "score")


TRACE = f"""{STORIES}, un AS (SELECT story, t, u, x[u + 1] AS p, y[u + 1] AS y FROM stories, (SELECT unnest(range(32)) AS u)),
 rr AS (SELECT story, t, m AS mask, covar_pop(y, p) / sqrt(var_pop(y) * var_pop(p)) AS r, var_pop(y) AS vy, var_pop(p) AS vp
  FROM un JOIN (SELECT unnest(range(32)) AS u, unnest(range(32)) % 4 AS m0) k USING (u), (SELECT 'whole' AS m, -1 AS q UNION ALL SELECT 'quarter', 1) s WHERE q < 0 OR m0 = q GROUP BY 1, 2, 3),
 tr AS (SELECT story, t, mask, 2 * r / (1 + r) AS s FROM rr)"""


def traces(spark, d):
    s = stories(spark, d).select("story", "t", F.posexplode(F.arrays_zip("x", "y")).alias("unit", "z"))
    long = s.select("story", "t", "unit", F.col("z.y").alias("y"), F.col("z.x").alias("p"))
    masks = spark.range(32).select(F.col("id").cast("int").alias("unit"), F.explode(
        F.when(F.col("id") % 4 == 1, F.array(F.lit("whole"), F.lit("quarter"))).otherwise(F.array(F.lit("whole")))).alias("mask"))
    return regions.spatial_traces(long, masks)


@query(f"WITH {TRACE} SELECT story::BIGINT AS story, mask, {R('median(s)')} AS median_r, {R('median(s) / (SELECT median(abs(s)) FROM tr)')} AS median_r_ceiled FROM tr GROUP BY 1, 2")
def story_summary(spark, d):
    t = traces(spark, d)
    out = regions.story_summary(t, t.select(F.abs("spatial_r").alias("ceiling")))
    return out.select(F.col("story").cast("long").alias("story"), "mask", r6("median_r").alias("median_r"), r6("median_r_ceiled").alias("median_r_ceiled"))


@query(f"WITH {TRACE} SELECT mask, t::BIGINT AS t, {R('median(s)')} AS median_r, count(s) AS n_stories FROM tr GROUP BY 1, 2")
def time_progression(spark, d):
    out = regions.time_progression(traces(spark, d))
    return out.select("mask", F.col("t").cast("long").alias("t"), r6("median_r").alias("median_r"), "n_stories")


@query(f"SELECT l_suppkey, {R('median(l_extendedprice)', 4)} AS median, count(*) AS n FROM lineitem GROUP BY 1")
def grouped_medians(spark, d):
    out = grouped_median(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", "median", count_out="n")
    return out.withColumn("median", r6("median", 4))


@query(f"SELECT {R('median(l_extendedprice)', 4)} AS median FROM lineitem")
def overall_median(spark, d):
    return grouped_median(table(spark, d, "lineitem"), [], "l_extendedprice", "median").withColumn("median", r6("median", 4))

