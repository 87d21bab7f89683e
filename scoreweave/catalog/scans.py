"""Readers, layouts, text extraction and the results store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..sources import store, tables, text
from . import query
from .views import R, scratch, table, vectors


@query("SELECT doc_id, lang, source, n_chars::DOUBLE AS label FROM documents")
def scan_stimuli(spark, d):
    s = tables.read_stimuli(spark, f"{d}/documents.parquet", fmt="parquet")
    return s.select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("label"))


@query("SELECT doc_id, quality, toxic::BIGINT AS target FROM labels")
def scan_trials(spark, d):
    t = tables.read_trials(spark, f"{d}/labels.parquet", "contact", {"contact": "toxic"})
    return t.select("doc_id", "quality", F.col("target").cast("long").alias("target"))


@query(f"SELECT vec_id, u AS unit, {R('embedding[u + 1]::DOUBLE')} AS value FROM embeddings, (SELECT unnest(range(64)) AS u)")
def dense_to_long(spark, d):
    return tables.to_long(vectors(spark, d), ["vec_id"], "vec").select(
        "vec_id", F.col("unit").cast("long").alias("unit"), r6("value").alias("value")
    )


@query(f"""SELECT l_orderkey AS stimulus, count(*) AS n_units,
 {R('sum(l_extendedprice)', 2)} AS total, {R('max_by(l_extendedprice, row(l_linenumber * 1000000 + l_partkey, l_extendedprice))', 2)} AS last_value
 FROM lineitem GROUP BY 1""")
def long_to_dense(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("stimulus"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("unit"),
        F.col("l_extendedprice").alias("value"),
    )
    dense = tables.to_dense(li, ["stimulus"])
    return dense.select(
        "stimulus", F.size("vec").cast("long").alias("n_units"),
        r6(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 2).alias("total"),
        r6(F.element_at("vec", -1), 2).alias("last_value"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_suppkey::DOUBLE AS angle, l_partkey::DOUBLE AS sf, l_linenumber::DOUBLE AS phase,
 CASE WHEN l_returnflag = 'A' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS colour FROM lineitem""")
def labels_from_paths(spark, d):
    li = table(spark, d, "lineitem")
    path = F.concat(
        F.lit("images/sine_"), "l_suppkey", F.lit("deg_"), "l_partkey", F.lit("cy_"), "l_linenumber", F.lit("phase_"),
        F.when(F.col("l_returnflag") == "A", "bw").otherwise("colour"), F.lit(".jpg"),
    )
    out = text.label_from_path(li.withColumn("path", path), "path")
    return out.select("l_orderkey", "l_linenumber", "angle", "sf", "phase", "colour")


@query("""WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events)
 SELECT user_id, seq, event_type AS word, event_id::DOUBLE AS t0, (event_id + 1)::DOUBLE AS t1 FROM numbered WHERE event_type <> 'error'""")
def timed_words(spark, d):
    e = table(spark, d, "events")
    word = F.when(F.col("event_type") == "error", " ").otherwise(F.concat(F.lit(" "), F.col("event_type")))
    entry = F.concat(
        F.lit("xmin = "), F.col("event_id"), F.lit(".0\n  xmax = "), F.col("event_id") + 1, F.lit(".0\n  text = \""), word, F.lit("\"\n")
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", entry.alias("e")))), lambda s: s["e"]), "")
    texts = e.groupBy("user_id").agg(
        F.concat(F.lit('name = "phone"\nxmin = 0 xmax = 1 text = "x"\nname = "word"\n'), body, F.lit('name = "end"')).alias("txt")
    )
    out = text.explode_intervals(texts, "user_id", "txt")
    return out.select("user_id", F.col("seq").cast("long").alias("seq"), "word", "t0", "t1")


def _score_rows(spark, d):
    s = table(spark, d, "supplier")
    return s.select(
        F.concat(F.lit("model"), F.col("s_nationkey")).alias("model"), F.lit("layer").alias("layer"),
        F.lit("bench").alias("benchmark"), F.lit("ridge").alias("metric"), F.col("s_name").alias("stat"), F.col("s_acctbal").alias("value"),
    )


@query(f"""SELECT 'model' || s_nationkey AS model, s_name AS stat, {R('s_acctbal + 1', 2)} AS value FROM supplier""")
def results_store(spark, d):
    path = scratch(spark, "scores")
    rows = _score_rows(spark, d)
    store.append_scores(rows, path)
    store.append_scores(rows.withColumn("value", F.col("value") + 1), path)
    return store.latest_scores(spark, path).select("model", "stat", r6("value", 2).alias("value"))


@query(f"SELECT label, count(*) AS n, {R('sum(embedding[1]::DOUBLE)')} AS first_total FROM embeddings GROUP BY 1")
def feature_store(spark, d):
    path = scratch(spark, "features")
    store.save_features(vectors(spark, d).withColumn("model", F.lit("m")).withColumn("layer", F.concat(F.lit("l"), "label")), path)
    saved = spark.read.parquet(path).where(F.col("model") == "m")
    return saved.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("vec")[0])).alias("first_total"))


@query(f"SELECT l_suppkey AS unit, {R('avg(l_quantity)')} AS value FROM lineitem GROUP BY 1")
def prepared_assembly(spark, d):
    path = scratch(spark, "assembly")

    def build():
        return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("unit")).agg(F.avg("l_quantity").alias("value"))

    store.materialise(spark, build, path)
    return store.materialise(spark, build, path).select("unit", r6("value").alias("value"))
