"""Unit atlas joins and region-level roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import corrected_pearson
from ..functions.ordering import grouped_median


def attach_region(df: DataFrame, atlas: DataFrame, unit: str = "unit") -> DataFrame:
    return df.join(atlas, unit)


def attach_group(df: DataFrame, bridge: DataFrame) -> DataFrame:
    """Region groups overlap, so a unit appears once per group that lists its region."""
    return df.join(bridge, "region")


def complement_group(bridge: DataFrame, regions: DataFrame, group: str, out: str) -> DataFrame:
    """A group built as all regions minus one group."""
    member = bridge.where(F.col("group") == group).select("region")
    rest = regions.select("region").distinct().join(member, "region", "left_anti")
    return rest.select(F.lit(out).alias("group"), "region")


def expand_levels(df: DataFrame, bridge: DataFrame) -> DataFrame:
    """One row per (unit, level, name) for the three reporting levels.

    Region and hemisphere x region are two labels on the same row, so they are exploded in place;
    only the overlapping groups need the bridge.
    """
    levels = F.array(
        F.struct(F.lit("region").alias("level"), F.col("region").alias("name")),
        F.struct(F.lit("hemi_region").alias("level"), F.concat_ws("_", "hemi", "region").alias("name")),
    )
    rest = [c for c in df.columns if c not in ("region", "hemi")]
    own = df.select(*rest, F.explode(levels).alias("_l")).select(*rest, "_l.level", "_l.name")
    grouped = attach_group(df, bridge).select(*rest, F.lit("group").alias("level"), F.col("group").alias("name"))
    return own.unionByName(grouped)


def region_rollup(scores: DataFrame, atlas: DataFrame, bridge: DataFrame) -> DataFrame:
    """Median r, median R2 and number of valid units per region, hemisphere x region and group."""
    s = attach_region(scores, atlas).where(
        F.col("pearson").isNotNull() & ~F.isnan("pearson") & F.col("r2").isNotNull() & ~F.isnan("r2")
    )
    long = expand_levels(s, bridge)
    r = grouped_median(long, ["level", "name"], "pearson", "median_pearson", count_out="n_units")
    q = grouped_median(long, ["level", "name"], "r2", "median_r2")
    return r.join(q, ["level", "name"])


def fill_empty(rolled: DataFrame, names: DataFrame) -> DataFrame:
    """Listed regions without valid units report zeros."""
    return names.join(rolled, ["level", "name"], "left").na.fill(
        {"median_pearson": 0.0, "median_r2": 0.0, "n_units": 0}
    )


def region_global(scores: DataFrame, ceilings: DataFrame, masks: DataFrame) -> DataFrame:
    """Per mask: unceiled and ceiled median r and the unit count (ceiled unit by unit)."""
    s = scores.join(ceilings, "unit").join(masks, "unit").withColumn(
        "ceiled", F.try_divide(F.col("pearson"), F.col("ceiling"))
    )
    raw = grouped_median(s, ["mask"], "pearson", "pearson_unceiled", count_out="n_units")
    ceiled = grouped_median(s, ["mask"], "ceiled", "pearson_ceiled")
    return raw.join(ceiled, "mask")


def spatial_traces(predictions: DataFrame, masks: DataFrame) -> DataFrame:
    """Per (story, t, mask): corrected correlation across units, from long (story, t, unit, y, p)."""
    return (
        predictions.join(masks, "unit").groupBy("story", "t", "mask").agg(corrected_pearson("y", "p").alias("spatial_r"))
    )


def story_summary(traces: DataFrame, time_ceiling: DataFrame | None = None) -> DataFrame:
    """Median over time of each story's trace, plain and divided by the median time ceiling."""
    med = grouped_median(traces, ["story", "mask"], "spatial_r", "median_r")
    every = traces.select("story", "mask").distinct().join(med, ["story", "mask"], "left").na.fill({"median_r": 0.0})
    if time_ceiling is None:
        return every
    c = grouped_median(time_ceiling, [], "ceiling", "c").scalar()
    return every.withColumn("median_r_ceiled", F.try_divide(F.col("median_r"), c))


def time_progression(traces: DataFrame) -> DataFrame:
    """Median across stories at each position; stories may differ in length."""
    return grouped_median(traces, ["mask", "t"], "spatial_r", "median_r", count_out="n_stories")

