"""The results store: append-only scores, feature tables and prepared assemblies as Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORE_PARTITIONS = ("model", "layer", "benchmark")


def run_layer_name(layers: list[str], limit: int = 80) -> str:
    """Directory-safe name of a layer list: joined, or a digest when the join is long."""
    import hashlib

    joined = "_".join(layers)
    return joined if len(joined) <= limit else "layers_" + hashlib.md5(joined.encode()).hexdigest()


def append_scores(df: DataFrame, path: str, aggregation: str = "none") -> None:
    """Append result rows; one directory per model/layer/benchmark, stamped with UTC time."""
    stamped = df.withColumn("run_ts", F.current_timestamp()).withColumn("aggregation", F.lit(aggregation))
    stamped.write.mode("append").partitionBy(*SCORE_PARTITIONS).parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_scores(spark: SparkSession, path: str) -> DataFrame:
    """Most recent value of every score; ``max_by`` combines before the shuffle."""
    keys = [*SCORE_PARTITIONS, "metric", "stat"]
    return read_scores(spark, path).groupBy(*keys).agg(F.max_by("value", "run_ts").alias("value"))


def save_features(df: DataFrame, path: str) -> None:
    """Feature rows (train, test and labels alike) partitioned for layer-wise reads; only the models and layers saved are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "layer").parquet(path)


def materialise(spark: SparkSession, build: Callable[[], DataFrame], path: str) -> DataFrame:
    """Read a prepared table if it was written completely before, otherwise build, write and read it.

    The writer's commit marker tells a finished table; a folder without it is a broken write and is replaced.
    """
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
