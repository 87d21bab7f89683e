"""Orientation tuning: circular variance and preferred angles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import grouped_median

REPORTED_ANGLES = (0, 45, 90, 135, 180)  # fixed values; 180 repeats the count of 0


def tuning_curve(df: DataFrame) -> DataFrame:
    """Mean response per (unit, angle); ``angle`` in degrees."""
    return df.groupBy("unit", "angle").agg(F.avg("response").alias("response"))


def circular_variance(df: DataFrame) -> DataFrame:
    """1 - |sum r e^(2i angle)| / sum r on curves shifted up by the magnitude of their minimum."""
    curve = tuning_curve(df)
    low = curve.groupBy("unit").agg(F.abs(F.min("response")).alias("_lift"))
    r = F.col("response") + F.col("_lift")
    twice = 2 * F.radians(F.col("angle").cast("double"))
    s = curve.join(low, "unit").groupBy("unit").agg(
        F.sum(r * F.cos(twice)).alias("re"), F.sum(r * F.sin(twice)).alias("im"), F.sum(r).alias("tot")
    )
    return s.select("unit", (1 - F.try_divide(F.hypot("re", "im"), F.col("tot"))).alias("cv"))


def selectivity_summary(cv: DataFrame) -> DataFrame:
    """Mean and median CV and the percentage of units below the mean and below 0.6."""
    mean = cv.agg(F.avg("cv")).scalar()
    out = cv.withColumn("_m", mean).agg(
        F.avg("cv").alias("mean_cv"),
        (100 * F.avg(F.coalesce((F.col("cv") < F.col("_m")).cast("double"), F.lit(0.0)))).alias("pct_below_mean"),
        (100 * F.avg(F.coalesce((F.col("cv") < 0.6).cast("double"), F.lit(0.0)))).alias("pct_below_06"),
    )
    return out.withColumn("median_cv", grouped_median(cv, [], "cv", "m").scalar())


def preferred_angle(df: DataFrame) -> DataFrame:
    """Angle of the largest mean response; the smallest angle wins a tie."""
    curve = tuning_curve(df)
    return curve.groupBy("unit").agg(
        F.max_by("angle", F.struct(F.col("response"), -F.col("angle"))).alias("preferred")
    )


def orientation_preference(df: DataFrame) -> DataFrame:
    """Share of units at 0/45/90/135/180 (180 counts 0 again) and the cardinality index."""
    pref = preferred_angle(df)
    n = {a: F.count_if(F.col("preferred") == (0 if a == 180 else a)) for a in REPORTED_ANGLES}
    c = pref.agg(*[n[a].alias(f"n{a}") for a in REPORTED_ANGLES])
    tot = sum((F.col(f"n{a}") for a in REPORTED_ANGLES[1:]), F.col("n0"))
    pct = [F.try_divide(100.0 * F.col(f"n{a}"), tot).alias(f"pct_{a}") for a in REPORTED_ANGLES]
    cardinal = F.try_divide((F.col("n0") + F.col("n90") + F.col("n180")).cast("double"), tot)
    return c.select(*pct, cardinal.alias("cardinality_index"))
