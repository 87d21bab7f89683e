"""Streaming twins, run over the given tables in several arrivals with a restart between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators.gram import cross_correlation
from ..streaming import online
from ..streaming.tables import StreamTable, latest
from . import query
from .views import PAIRS, R, intervals, scratch, table
from .windows import BINNED, DAY

FILES = 4


def stream(df: DataFrame, order: str, target: StreamTable, write) -> StreamTable:
    """Let the rows come in FILES arrivals by ``order``, each a micro-batch; the stream stops after each and is started again for the next.

    ``write`` makes the writer of a streaming frame; the files lie below the shared folder, as many per arrival as tasks write, each
    written when its time has come.
    """
    spark = df.sparkSession
    folder, checkpoint = scratch(spark, "arrivals"), scratch(spark, "offsets")
    low, high = df.agg(F.min(order).cast("double"), F.max(order).cast("double")).first()
    if low is None:
        return target
    place = F.least(F.floor((F.col(order).cast("double") - low) / (high - low or 1.0) * FILES), F.lit(FILES - 1))
    for k in range(FILES):
        df.where(F.coalesce(place, F.lit(0)) == k).write.mode("append").parquet(folder)
        rows = spark.readStream.schema(df.schema).parquet(folder)
        write(rows).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return target


def summed(df: DataFrame, order: str, name: str, partial, merge, most: int = 3) -> DataFrame:
    target = StreamTable(df.sparkSession, scratch(df.sparkSession, name), merge, partial(df.limit(0)).schema, most)
    return stream(df, order, target, lambda rows: online.into(rows, target, partial)).read()


def events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"SELECT user_id, count(value) AS n, {R('avg(value)')} AS mean, {R('stddev_samp(value)')} AS std FROM events GROUP BY 1")
def stream_running_stats(spark, d):
    keys = ["user_id"]
    out = summed(events(spark, d), "ts", "stats", lambda b: online.partial_stats(b, keys, "value"), online.merge_stats(keys))
    return online.finish_stats(out, keys).select("user_id", "n", r6("mean").alias("mean"), r6("std").alias("std"))


@query(f"""SELECT epoch(date_trunc('day', ts))::BIGINT AS bin_start, event_type, count(*) AS n, {R('sum(value)', 4)} AS total FROM events GROUP BY 1, 2""")
def stream_tumbling_bins(spark, d):
    keys = ["event_type"]
    out = summed(events(spark, d), "ts", "bins", lambda b: online.partial_windows(b, "ts", "1 day", keys, "value"), online.merge_windows(keys))
    return out.select(F.unix_timestamp("win_start").alias("bin_start"), "event_type", "n", r6("total", 4).alias("total"))


@query(f"""WITH e AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) + (k + 1) * INTERVAL 6 HOUR AS e, event_type, value FROM events, (SELECT unnest(range(4)) AS k))
 SELECT epoch(e)::BIGINT AS context_end, event_type, count(*) AS n, {R('avg(value)')} AS mean FROM e GROUP BY 1, 2""")
def stream_sliding_context(spark, d):
    keys = ["event_type"]
    out = summed(events(spark, d), "ts", "context", lambda b: online.partial_windows(b, "ts", "24 hours", keys, "value", "6 hours"), online.merge_windows(keys))
    return online.finish_windows(out).select(F.unix_timestamp("win_end").alias("context_end"), "event_type", "n", r6("mean").alias("mean"))


@query(f"""WITH {BINNED}, w AS (SELECT f.story, f.bin, list(word ORDER BY seq) FILTER (word IS NOT NULL) AS w FROM f LEFT JOIN b ON b.story = f.story AND b.bin <= f.bin GROUP BY 1, 2)
 SELECT story, bin, coalesce(array_to_string(w[-8:], ' '), '') AS tail FROM w""")
def stream_word_context(spark, d):
    """The last eight words up to every day of a story, kept by a stateful operator."""
    words = intervals(spark, d).select("story", "seq", "word", "t0", "t1")
    target = StreamTable(spark, scratch(spark, "words"), latest("story", "bin"), "story long, bin int, words array<string>", 3)
    out = stream(words, "seq", target, lambda rows: online.into(online.word_context(rows, "story", DAY, 8), target, mode="update")).read()
    return out.select("story", F.col("bin").cast("long").alias("bin"), F.array_join("words", " ").alias("tail"))


@query(f"""WITH {PAIRS} SELECT a.label::VARCHAR AS part, a.unit AS source, b.unit AS target, {R('corr(a.p, b.y)')} AS r FROM pairs a JOIN pairs b USING (vec_id) GROUP BY 1, 2, 3""")
def stream_moments(spark, d):
    """Moments merged batch by batch, then scored on demand."""
    v = F.col("embedding").cast("array<double>")
    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("part"), F.slice(v, 1, 32).alias("x"), F.slice(v, 33, 32).alias("y"))
    target = StreamTable(spark, scratch(spark, "moments"), online.merge_moments, most=3)
    stream(rows, "vec_id", target, lambda b: online.into(b, target, online.partial_moments("x", "y", (32, 32))))
    out = cross_correlation(online.read_moments(target, (32, 32)))
    return out.select("part", F.posexplode("r").alias("source", "r"), "target").select(
        "part", F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"), r6("r").alias("r"))
