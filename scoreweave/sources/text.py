"""Tables extracted from text columns: labels in file names and timed-word annotation text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col

# Layout of the interval annotation text.
WORD_TIER = r'(?s)name = "word"(.*?)(?:name = |$)'
INTERVAL = r'xmin = ([\d.]+)\s+xmax = ([\d.]+)\s+text = "(.*?)"'


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def label_from_path(df: DataFrame, path: str) -> DataFrame:
    """Grating parameters from names like ``x_22.5deg_2.0cy_0.5phase_bw.jpg`` (units are cut off)."""
    parts = F.split(base_name(path), "_")

    def number(i: int, unit_chars: int) -> Column:
        return F.regexp_extract(parts[i], r"^(.*).{%d}$" % unit_chars, 1).cast("double")

    colour = F.substring_index(parts[4], ".jpg", 1)
    return (
        df.withColumn("angle", number(1, 3))
        .withColumn("sf", number(2, 2))
        .withColumn("phase", number(3, 5))
        .withColumn("colour", F.when(colour == "bw", F.lit(0.0)).otherwise(F.lit(1.0)))
    )


def explode_intervals(df: DataFrame, key: str, text: str) -> DataFrame:
    """All non-blank (word, t0, t1) of the word tier, numbered in text order."""
    tier = F.regexp_extract(col(text), WORD_TIER, 1)

    def group(i: int) -> Column:
        return F.regexp_extract_all(F.col("_tier"), F.lit(INTERVAL), i)

    zipped = F.arrays_zip(group(1).alias("a"), group(2).alias("b"), group(3).alias("w"))
    rows = df.select(key, tier.alias("_tier")).select(key, F.posexplode(zipped).alias("seq", "iv"))
    return rows.select(
        key,
        F.col("seq").cast("int").alias("seq"),
        F.trim(F.col("iv.w")).alias("word"),
        F.col("iv.a").cast("double").alias("t0"),
        F.col("iv.b").cast("double").alias("t1"),
    ).where(F.col("word") != "")
