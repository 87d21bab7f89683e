"""A table that micro-batches add to: exact under replay, restart and any lateness.

A batch writes its partial rows as a piece of its own, then a new version of the manifest that lists the live pieces.  A reader
takes the newest finished version and merges its pieces.  A replayed batch takes the place of its earlier piece, or is
skipped when it has been merged already; a batch that failed before its manifest left only an unlisted folder.  When there are more
than ``most`` pieces they are merged into one, so reading does not grow with the number of batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "piece string, first long, last long"


class StreamTable:
    """``merge`` makes one row per key of the rows of several pieces; it is applied again to its own results.

    Rows carry the column ``batch``, the id of the batch they come from (the largest one after a merge), which ``merge`` keeps.
    Only one stream writes to a table; of two writers of one version the second fails.
    """

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], schema: StructType | str | None = None, most: int = 16):
        self.spark, self.path, self.merge, self.schema, self.most = spark, path.rstrip("/"), merge, schema, most

    def _versions(self) -> list[int]:
        """Finished versions of the manifest, ascending; looked up where the table lies, which may be any store."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = [s.getPath() for s in fs.listStatus(folder)]
        done = [p for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def manifest(self) -> tuple[int, list[tuple[str, int, int]]]:
        """The newest version and its pieces with the first and last batch in each."""
        versions = self._versions()
        if not versions:
            return 0, []
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v={versions[-1]}").collect()
        return versions[-1], sorted((tuple(r) for r in rows), key=lambda r: r[1])

    def _publish(self, version: int, pieces: list[tuple[str, int, int]]) -> None:
        self.spark.createDataFrame(pieces, MANIFEST).coalesce(1).write.mode("error").parquet(f"{self.path}/manifest/v={version}")

    def _rows(self, pieces: list[tuple[str, int, int]]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/data/{p}" for p, _, _ in pieces])

    def commit(self, batch_id: int, rows: DataFrame) -> bool:
        """Add the partial rows of a batch; False when the batch had been merged before."""
        version, pieces = self.manifest()
        if any(first <= batch_id <= last and first < last for _, first, last in pieces):
            return False
        piece = f"batch={batch_id}-{uuid.uuid4().hex}"
        rows.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("error").parquet(f"{self.path}/data/{piece}")
        pieces = [p for p in pieces if p[1] != batch_id] + [(piece, batch_id, batch_id)]
        self._publish(version + 1, pieces)
        if len(pieces) > self.most:
            self.compact()
        return True

    def compact(self) -> None:
        """Merge all pieces into one."""
        version, pieces = self.manifest()
        if len(pieces) < 2:
            return
        piece = f"merged-{uuid.uuid4().hex}"
        self.merge(self._rows(pieces)).write.mode("error").parquet(f"{self.path}/data/{piece}")
        self._publish(version + 1, [(piece, min(p[1] for p in pieces), max(p[2] for p in pieces))])

    def read(self) -> DataFrame:
        """One row per key over everything committed."""
        _, pieces = self.manifest()
        if not pieces:
            if self.schema is None:
                raise ValueError(f"no batch has been committed to {self.path}")
            return self.spark.createDataFrame([], self.schema)
        return self.merge(self._rows(pieces)).drop("batch")


def latest(*keys: str) -> Callable[[DataFrame], DataFrame]:
    """Merge: of every key the row of its newest batch."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, "batch")]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"), F.max("batch").alias("batch"))
        return newest.select(*keys, *[F.col("_r")[c].alias(c) for c in rest], "batch")

    return merge
