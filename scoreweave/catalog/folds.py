"""Deterministic splits over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits
from . import query
from .views import table


@query("SELECT c_custkey, ntile(10) OVER (ORDER BY md5('42:' || c_custkey)) - 1 AS fold FROM customer")
def folds_plain(spark, d):
    return splits.kfold(table(spark, d, "customer"), "c_custkey").select("c_custkey", F.col("fold").cast("long").alias("fold"))


@query("SELECT c_custkey, ntile(10) OVER (PARTITION BY c_mktsegment ORDER BY md5('42:' || c_custkey)) - 1 AS fold FROM customer")
def folds_stratified(spark, d):
    return splits.stratified_kfold(table(spark, d, "customer"), "c_custkey", "c_mktsegment").select("c_custkey", F.col("fold").cast("long").alias("fold"))


@query("""WITH RECURSIVE g AS (SELECT c_nationkey AS g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_nationkey::VARCHAR) AS k FROM customer GROUP BY 1),
 r AS (SELECT 0::BIGINT AS k, [0, 0, 0, 0, 0]::BIGINT[] AS load, -1::BIGINT AS fold, -1::BIGINT AS g UNION ALL
  SELECT g.k, list_transform(load, lambda x, i: CASE WHEN i = list_position(load, list_min(load)) THEN x + n ELSE x END), list_position(load, list_min(load)) - 1, g.g
  FROM r JOIN g ON g.k = r.k + 1)
 SELECT c_custkey, fold::BIGINT AS fold FROM customer JOIN r ON r.g = c_nationkey""")
def folds_grouped(spark, d):
    return splits.group_kfold(table(spark, d, "customer"), "c_nationkey", 5).select("c_custkey", F.col("fold").cast("long").alias("fold"))


@query("""WITH r AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42:' || c_custkey)) AS rk, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
 SELECT c_custkey, rk <= ceil(n * 0.1::DOUBLE) AS is_val FROM r""")
def holdout_stratified(spark, d):
    return splits.holdout(table(spark, d, "customer"), "c_custkey", 0.1, "c_mktsegment").select("c_custkey", "is_val")


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey)) AS rk, count(*) OVER () AS n FROM orders)
 SELECT o_orderkey, rk <= ceil(n * 0.1::DOUBLE) AS is_val FROM r""")
def holdout_random(spark, d):
    return splits.holdout(table(spark, d, "orders"), "o_orderkey", 0.1).select("o_orderkey", "is_val")


@query("""WITH n AS (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS k, o_custkey FROM orders),
 r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey)) AS rk, count(*) OVER () AS n, (SELECT min(k) FROM n) AS smallest FROM orders)
 SELECT o_orderkey, rk <= ceil(n * 0.1::DOUBLE) AS is_val FROM r""")
def holdout_fallback(spark, d):
    """A label with singleton classes cannot be stratified, so the split is a plain one."""
    return splits.holdout(table(spark, d, "orders").withColumn("label", F.col("o_orderkey")), "o_orderkey", 0.1, "label").select("o_orderkey", "is_val")
