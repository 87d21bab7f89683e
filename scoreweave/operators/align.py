"""Key-based alignment: joins, set operations and stacking.  Nothing is positional."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col


def align(features: DataFrame, responses: DataFrame, on: Sequence[str] = ("stimulus_id",)) -> DataFrame:
    """Features joined to responses by key.  Adaptive execution picks the strategy and splits skew."""
    return features.join(responses, list(on))


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the lowest ``order`` per key, by a combinable aggregate instead of a window."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return picked.select(key, "_r.*")


def align_first(model: DataFrame, human: DataFrame, key: str, order: str) -> DataFrame:
    """Stimuli present on both sides, one (first) row per side.  Columns get ``model_``/``human_``."""
    m = first_per_key(model, key, order)
    h = first_per_key(human, key, order)
    m = m.select(key, *[F.col(c).alias(f"model_{c}") for c in m.columns if c != key])
    h = h.select(key, *[F.col(c).alias(f"human_{c}") for c in h.columns if c != key])
    return m.join(h, key)


def attach_scenario(model: DataFrame, human: DataFrame, key: str = "stimulus_id") -> DataFrame:
    """Scenario of each stimulus from the human table (last mapping by name); unmatched rows drop."""
    lookup = human.where(F.col("scenario").isNotNull()).groupBy(key).agg(F.max("scenario").alias("scenario"))
    return model.join(lookup, key)


def lag_align(
    features: DataFrame, responses: DataFrame, story: str, t: str, delay: int = 2
) -> DataFrame:
    """Feature at bin t with the response at t + delay, inside the common length of each story.

    Stories whose common length is below delay + 1 bins are skipped.  Lengths are one combinable
    aggregate per side, so a very long story does not concentrate in one task.
    """
    length = (
        features.groupBy(story).agg((F.max(t) + 1).alias("_nf"))
        .join(responses.groupBy(story).agg((F.max(t) + 1).alias("_nr")), story)
        .select(story, F.least("_nf", "_nr").alias("_n"))
        .where(F.col("_n") >= delay + 1)
    )
    shifted = features.withColumn("response_t", F.col(t) + delay).withColumnRenamed(t, "feature_t")
    right = responses.withColumnRenamed(t, "response_t")
    return (
        shifted.join(right, [story, "response_t"])
        .join(length, story)
        .where(F.col("response_t") < F.col("_n"))
        .drop("_n")
    )


def apply_ceiling(scores: DataFrame, ceilings: DataFrame, on: Sequence[str], value: str = "score") -> DataFrame:
    """Score divided by its unit's ceiling; units without a ceiling keep a NULL ceiled score."""
    return scores.join(ceilings, list(on), "left").withColumn(
        f"ceiled_{value}", F.try_divide(F.col(value), F.col("ceiling"))
    )


def apply_ceiling_keep_raw(scores: DataFrame, ceilings: DataFrame, on: Sequence[str], value: str = "score") -> DataFrame:
    """Variant that keeps the raw score where the ceiling is zero."""
    joined = scores.join(ceilings, list(on), "left")
    return joined.withColumn(
        f"ceiled_{value}",
        F.when(F.col("ceiling") == 0, F.col(value)).otherwise(F.col(value) / F.nullif(F.col("ceiling"), F.lit(0.0))),
    )


def mean_ceiling(ceilings: DataFrame) -> DataFrame:
    """The single ceiling used for scalar scores: the mean over units."""
    return ceilings.agg(F.avg("ceiling").alias("ceiling"))


def stack_subjects(frames: Sequence[DataFrame], time: str | None = None) -> DataFrame:
    """Union along the unit axis; with ``time``, trimmed to the shortest subject's length."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    if time is None:
        return out
    shortest = out.groupBy("subject").agg((F.max(time) + 1).alias("n")).agg(F.min("n").alias("n"))
    return out.where(F.col(time) < shortest.scalar())


def region_pairs(source: DataFrame, target: DataFrame, on: str = "stimulus_id") -> DataFrame:
    """Subject-to-subject alignment: every source region's vector with every target region's vector.

    ``source``/``target`` hold one wide vector per (stimulus, region); the region axis is a short
    fixed list, so the join grows with stimuli only.
    """
    s = source.select(on, F.col("region").alias("source_region"), F.col("vec").alias("x"))
    t = target.select(on, F.col("region").alias("target_region"), F.col("vec").alias("y"))
    return s.join(t, on)


def first_prefix(names: DataFrame, prefixes: DataFrame, name: str = "name") -> DataFrame:
    """The first (lowest ``priority``) prefix of a short rule table that starts each name.

    A name's beginnings, one per distinct prefix length, meet the rules in an equi join.
    """
    lengths = prefixes.agg(F.collect_set(F.length("prefix"))).scalar()
    starts = names.withColumn("_len", F.explode(lengths)).where(F.length(name) >= F.col("_len"))
    hits = starts.withColumn("prefix", F.substring(F.col(name), F.lit(1), F.col("_len"))).join(F.broadcast(prefixes), "prefix")
    return hits.groupBy(name).agg(F.min_by(F.struct("prefix", "groups"), "priority").alias("_r")).select(
        name, "_r.prefix", "_r.groups"
    )


def ordered_dedup(df: DataFrame, keys: Sequence[str], value: str, position: str) -> DataFrame:
    """Distinct values per key at their first position."""
    return df.groupBy(*keys, value).agg(F.min(position).alias(position))


def intersect_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def except_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Set difference by anti join; the right side is reduced to its distinct keys first."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def valid_pairs(a: DataFrame, b: DataFrame, on: Sequence[str], value: str = "dist") -> DataFrame:
    """Entries that are defined on both sides (mask union)."""
    left = a.select(*on, F.col(value).alias("a")).where(F.col("a").isNotNull() & ~F.isnan("a"))
    right = b.select(*on, F.col(value).alias("b")).where(F.col("b").isNotNull() & ~F.isnan("b"))
    return left.join(right, list(on))


def trim_to_common_length(df: DataFrame, group: Sequence[str], run: str, t: str) -> DataFrame:
    """Rows with t below the shortest run of their group; two combinable aggregates, no window."""
    group = list(group)
    shortest = (
        df.groupBy(*group, run).agg((F.max(t) + 1).alias("_n")).groupBy(*group).agg(F.min("_n").alias("_n"))
    )
    return df.join(shortest, group).where(col(t) < F.col("_n")).drop("_n")

