"""Helpers shared by the text operators."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = -(2**63)


def shared_folder(spark: SparkSession) -> None:
    """Checkpoints go to the folder named in spark.checkpoint.dir; without one (tests) a folder below the working directory's warehouse."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints")
        spark.sparkContext.setCheckpointDir(folder)


def settle(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries built and run inside leave no shuffle files behind once they end.

    For many rounds that each end in ``settle``: the next round reads checkpoints.  A frame built inside is not to be run twice outside."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextmanager
def few_rows(spark: SparkSession, n: int = 1) -> Iterator[None]:
    """Tasks get so many rows at once: for rows of megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def others(df: DataFrame, *taken: str) -> list[str]:
    """Columns whose names, compared as Spark does, are none of ``taken``."""
    low = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in low]


def col(name: str) -> Column:
    """A column by its literal name (dots and back-ticks allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_key(name: str) -> Column:
    """The id as a key: null ids are one id, smaller than all others."""
    return F.coalesce(col(name).cast("long"), F.lit(LEAST))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Runs without [\\x20\\x09-\\x0D], which is what bytes.split() separates."""
    return text.split()


def word_hashes(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))


STEP = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(32))) * SPREAD
    h = (h ^ (h >> np.uint64(32))) * SPREAD
    return h ^ (h >> np.uint64(32))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes."""
    count = max(0, len(h) - n + 1)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * STEP + h[i : i + count]
    return mix(out)
