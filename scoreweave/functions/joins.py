"""Size-checked broadcasting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the side has at most ``max_rows`` rows; otherwise leave it to the optimizer.

    The check stops reading after ``max_rows + 1`` rows.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where a NULL key meets a NULL key, so that a NULL group keeps its rows."""
    named = right.withColumnsRenamed({k: f"_ns_{k}" for k in keys})
    on = [left[k].eqNullSafe(named[f"_ns_{k}"]) for k in keys]
    return left.join(named, on, how).drop(*[f"_ns_{k}" for k in keys])


SMALL_ROWS = 50_000


def small_table(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """A short per-key summary as a broadcast table, computed once; the frame itself if it is longer.

    Joining it costs no shuffle of the other side, so a hot key's rows stay where they are.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
