"""Which runs are left to do, and which metrics fit a benchmark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import METRIC_GROUPS, PREFIX_GROUPS
from ..operators.align import first_prefix, ordered_dedup

SYNONYMS = {"chunked_ridge": ("chunked_ridge", "ridge")}  # fixed values


def synonym_table(spark: SparkSession, synonyms: dict[str, Sequence[str]] = SYNONYMS) -> DataFrame:
    return spark.createDataFrame([(m, s) for m, names in synonyms.items() for s in names], "metric string, done_as string")


def plan_runs(models: DataFrame, benchmarks: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Every (model, layer) x benchmark x metric.  Metrics and benchmarks are short lists, so they are
    exploded onto the model rows rather than cross-joined."""
    names = benchmarks.agg(F.collect_set("benchmark")).scalar()
    return models.withColumn("benchmark", F.explode(names)).withColumn(
        "metric", F.explode(F.array(*[F.lit(m) for m in metrics]))
    )


def missing_runs(plan: DataFrame, done: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Planned runs none of whose equivalent metrics is done.

    Each done row is expanded to the metric names it satisfies, then one anti join.  A metric with
    its own synonym list is satisfied only by the names on that list.
    """
    keys = ["model", "layer", "benchmark"]
    listed = synonyms.select("metric").distinct()
    itself = done.select(*keys, "metric").join(F.broadcast(listed), "metric", "left_anti").select(*keys, "metric")
    through = done.select(*keys, F.col("metric").alias("done_as")).join(F.broadcast(synonyms), "done_as").select(*keys, "metric")
    satisfied = itself.unionByName(through).distinct()
    return plan.join(satisfied, [*keys, "metric"], "left_anti")


def prefix_rules(spark: SparkSession) -> DataFrame:
    rows = [(i, p, list(g)) for i, (p, g) in enumerate(PREFIX_GROUPS)]
    return spark.createDataFrame(rows, "priority int, prefix string, groups array<string>")


def group_table(spark: SparkSession) -> DataFrame:
    rows = [(g, i, m) for g, names in METRIC_GROUPS.items() for i, m in enumerate(names)]
    return spark.createDataFrame(rows, "grp string, pos int, metric string")


def compatible_metrics(names: DataFrame, name: str = "name", rules: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(name, metric, position): metrics of the groups of the first matching prefix, first mention kept."""
    spark = names.sparkSession
    rules = prefix_rules(spark) if rules is None else rules
    groups = group_table(spark) if groups is None else groups
    hit = first_prefix(names.select(name).distinct(), rules, name)
    long = hit.select(name, F.posexplode("groups").alias("gpos", "grp")).join(F.broadcast(groups), "grp")
    return ordered_dedup(long.withColumn("position", F.col("gpos") * 1000 + F.col("pos")), [name], "metric", "position")


def is_compatible(names: DataFrame, metric: str, name: str = "name") -> DataFrame:
    """Unknown benchmarks never block; known ones accept only their metrics."""
    known = first_prefix(names.select(name).distinct(), prefix_rules(names.sparkSession), name).select(name, F.lit(True).alias("known"))
    fit = compatible_metrics(names, name).where(F.col("metric") == metric).select(name, F.lit(True).alias("fits"))
    out = names.select(name).distinct().join(known, name, "left").join(fit, name, "left")
    return out.select(name, (F.col("known").isNull() | F.coalesce("fits", F.lit(False))).alias("compatible"))
