"""Readers for stimuli and trials, and the long <-> dense response layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the stimulus-metadata files.
STIMULUS_SCHEMA = (
    "filename STRING, stimulus_id STRING, label DOUBLE, contacts DOUBLE, "
    "train INT, intra_generalizability INT"
)
CLASS_SCHEMA = "filename STRING, class INT"
# Which trial column is the behaviour target of each task.
TRIAL_TARGET = {"placement": "choice", "contact": "responseBool"}


def read_stimuli(spark: SparkSession, path: str, schema: str = STIMULUS_SCHEMA, fmt: str = "csv") -> DataFrame:
    """Stimulus metadata with declared types; a schema means no inference pass over the files.

    Columns are matched by name against the file's header, so files may order or extend them.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    names = [f.split()[0] for f in schema.split(",")]
    kinds = dict(f.split() for f in schema.split(","))
    raw = spark.read.option("header", True).csv(path)  # header only; every column is text
    return raw.select(*[F.col(n).cast(kinds[n]).alias(n) for n in names if n in raw.columns])


def read_trials(spark: SparkSession, path: str, task: str, targets: dict[str, str] = TRIAL_TARGET) -> DataFrame:
    """Behaviour trials with the task's response column renamed to ``target``."""
    if task not in targets:
        raise ValueError(f"unknown task {task!r}; one of {sorted(targets)}")
    df = spark.read.parquet(path)
    others = [c for c in df.columns if c not in targets.values()]
    return df.select(*others, F.col(targets[task]).alias("target"))


def to_long(df: DataFrame, keys: Sequence[str], vec: str, unit: str = "unit", value: str = "value") -> DataFrame:
    """One row per (keys, unit) from one array per key; unit is the 0-based array position."""
    return df.select(*keys, F.posexplode(F.col(vec).cast("array<double>")).alias(unit, value))


def to_dense(df: DataFrame, keys: Sequence[str], unit: str = "unit", value: str = "value", out: str = "vec") -> DataFrame:
    """One array per key, ordered by unit.  The group is one stimulus: its size is the unit count."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(unit).alias("u"), F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda s: s["v"]).alias(out))
