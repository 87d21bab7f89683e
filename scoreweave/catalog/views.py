"""Views of the given tables in the roles the operators expect, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.columns import TIE_OFFSET


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def R(expr: str, digits: int = 6) -> str:
    """SQL twin of ``functions.columns.r6``."""
    rounded = f"round(({expr})::DOUBLE + {TIE_OFFSET * 10.0**-digits!r}::DOUBLE, {digits})"
    return f"(CASE WHEN {rounded} = 0 THEN 0.0::DOUBLE ELSE {rounded} END)"


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", A.as_double("embedding").alias("vec"), "label")


def halves(spark, d) -> DataFrame:
    """Features x (first 32 entries) and responses y (last 32) per vector."""
    return vectors(spark, d).select("vec_id", "label", F.slice("vec", 1, 32).alias("x"), F.slice("vec", 33, 32).alias("y"))


def pairs(spark, d) -> DataFrame:
    """Long predictions: unit u has target y[u] and prediction x[u]."""
    z = F.arrays_zip("x", "y")
    return halves(spark, d).select("vec_id", "label", F.posexplode(z).alias("unit", "z")).select(
        "vec_id", "label", "unit", F.col("z.y").alias("y"), F.col("z.x").alias("p")
    )


PAIRS = """pairs AS (SELECT vec_id, label, u AS unit, embedding[u + 33]::DOUBLE AS y, embedding[u + 1]::DOUBLE AS p
 FROM embeddings, (SELECT unnest(range(32)) AS u))"""


def trials(spark, d) -> DataFrame:
    """Repeated measurements: supplier = unit, month = stimulus, line number = repetition."""
    li = table(spark, d, "lineitem")
    return li.groupBy(
        F.col("l_suppkey").alias("unit"), F.month("l_shipdate").alias("stimulus"), F.col("l_linenumber").alias("rep")
    ).agg(F.avg("l_quantity").alias("value"))


TRIALS = """trials AS (SELECT l_suppkey AS unit, month(l_shipdate) AS stimulus, l_linenumber AS rep, avg(l_quantity) AS value
 FROM lineitem GROUP BY ALL)"""


def choices(spark, d) -> DataFrame:
    """Behaviour: language = scenario, source = participant, quality = model, toxic = human."""
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id").select(
        F.col("doc_id").alias("stimulus"), F.col("lang").alias("scenario"), F.col("source").alias("participant"),
        F.col("quality").alias("model"), F.col("toxic").alias("human"), "n_chars",
    )


CHOICES = """choices AS (SELECT doc_id AS stimulus, lang AS scenario, source AS participant, quality AS model, toxic AS human, n_chars
 FROM labels JOIN documents USING (doc_id))"""


def tuning(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("unit"), (F.pmod(F.month("l_shipdate") - 1, F.lit(8)) * F.lit(22.5)).alias("angle"),
        F.col("l_quantity").alias("response"),
    )


TUNING = """tuning AS (SELECT l_suppkey AS unit, ((month(l_shipdate) - 1) % 8) * 22.5::DOUBLE AS angle, l_quantity AS response FROM lineitem)"""


def unit_scores(spark, d) -> DataFrame:
    """Two scores per unit (customer)."""
    spent = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"))
    c = table(spark, d, "customer")
    return c.join(spent, c.c_custkey == spent.o_custkey, "left").select(
        F.col("c_custkey").alias("unit"), F.col("c_acctbal").alias("pearson"), F.col("spent").alias("r2")
    )


def atlas(spark, d) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("unit"), F.col("n_name").alias("region"), F.col("c_mktsegment").alias("hemi")
    )


def bridge(spark, d) -> DataFrame:
    """Overlapping groups: a nation's region, and one group per first letter of the nation."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    by_region = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("group"), F.col("n_name").alias("region"))
    by_letter = n.select(F.concat(F.lit("letter_"), F.substring("n_name", 1, 1)).alias("group"), F.col("n_name").alias("region"))
    return by_region.unionByName(by_letter)


ATLAS = """scores AS (SELECT c_custkey AS unit, c_acctbal AS pearson, sum(o_totalprice) AS r2, min(c_nationkey) AS nk, min(c_mktsegment) AS hemi
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal),
 located AS (SELECT unit, pearson, r2, hemi, n_name AS region FROM scores JOIN nation ON nk = n_nationkey),
 bridge AS (SELECT r_name AS grp, n_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'letter_' || substr(n_name, 1, 1), n_name FROM nation)"""


def intervals(spark, d) -> DataFrame:
    """Timed words: a user's events in order, one second long, seconds since the user's first event."""
    e = table(spark, d, "events")
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000)
    first = e.groupBy("user_id").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("_first"))
    t0 = (F.unix_micros(F.col("ts").cast("timestamp")) - F.col("_first")) / F.lit(1_000_000)
    return e.join(first, "user_id").select(
        F.col("user_id").alias("story"), F.col("event_id").alias("seq"), F.col("event_type").alias("word"),
        t0.alias("t0"), (t0 + 1).alias("t1"), sec.alias("sec"),
    )


INTERVALS = """firsts AS (SELECT user_id, min(epoch_us(ts)) AS f FROM events GROUP BY 1),
 intervals AS (SELECT user_id AS story, event_id AS seq, event_type AS word, (epoch_us(ts) - f) / 1000000.0::DOUBLE AS t0,
  (epoch_us(ts) - f) / 1000000.0::DOUBLE + 1 AS t1 FROM events JOIN firsts USING (user_id))"""


def stories(spark, d) -> DataFrame:
    """Time-resolved vectors: a label is a story, its vectors in id order are the time points."""
    from ..functions.ordering import ordered_row_number

    return ordered_row_number(halves(spark, d), ["label"], ["vec_id"], "pos").select(
        "vec_id", F.col("label").alias("story"), (F.col("pos") - 1).cast("int").alias("t"), "x", "y"
    )


STORIES = """stories AS (SELECT vec_id, label AS story, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t,
  embedding[1:32]::DOUBLE[] AS x, embedding[33:64]::DOUBLE[] AS y FROM embeddings)"""


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table, under the shared checkpoint folder."""
    import uuid

    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base}/{name}-{uuid.uuid4().hex}"
