"""Vector normalisers, projections, layer and sequence pooling over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..functions.joins import checked_broadcast
from ..operators import scoring, transforms
from . import query
from .views import R, STORIES, stories, table, vectors

LONG = "long AS (SELECT vec_id, u AS unit, embedding[u + 1]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(64)) AS u))"


def explode(df, value="vec"):
    return df.select("vec_id", F.posexplode(value).alias("unit", "v")).select("vec_id", F.col("unit").cast("long").alias("unit"), r6("v").alias("value"))


@query(f"WITH {LONG}, s AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM long GROUP BY 1) SELECT vec_id, unit, {R('x / greatest(n, 1e-8)')} AS value FROM long JOIN s USING (vec_id)")
def normalise_cosine(spark, d):
    return explode(transforms.normalise(vectors(spark, d), "vec", "cosine"))


@query(f"WITH {LONG}, s AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM long GROUP BY 1) SELECT vec_id, unit, {R('x / (n + 1e-8)')} AS value FROM long JOIN s USING (vec_id)")
def normalise_unit(spark, d):
    return explode(transforms.normalise(vectors(spark, d), "vec", "unit_norm"))


@query(f"WITH {LONG}, s AS (SELECT vec_id, avg(x) AS m, var_pop(x) AS v FROM long GROUP BY 1) SELECT vec_id, unit, {R('(x - m) / sqrt(v + 1e-8)')} AS value FROM long JOIN s USING (vec_id)")
def normalise_layer(spark, d):
    return explode(transforms.normalise(vectors(spark, d), "vec", "layer_norm"))


@query(f"WITH {LONG}, s AS (SELECT unit, avg(x) AS m, stddev_samp(x) AS sd FROM long GROUP BY 1) SELECT vec_id, unit, {R('(x - m) / (sd + 1e-8)')} AS value FROM long JOIN s USING (unit)")
def normalise_batch(spark, d):
    return explode(transforms.normalise(vectors(spark, d), "vec", "batch_zscore"))


@query(f"WITH {LONG}, s AS (SELECT unit, avg(x) AS m, stddev_samp(x) AS sd FROM long GROUP BY 1) SELECT vec_id, unit, {R('(x - m) / greatest(sd, 1e-12)')} AS value FROM long JOIN s USING (unit)")
def normalise_global(spark, d):
    return explode(transforms.normalise(vectors(spark, d), "vec", "global_zscore"))


@query(f"""WITH {LONG}, m AS (SELECT unit, median(x) AS m FROM long GROUP BY 1), s AS (SELECT unit, min(m) AS m, median(abs(x - m)) AS mad FROM long JOIN m USING (unit) GROUP BY 1)
 SELECT vec_id, unit, {R('(x - m) / (mad * 1.4826 + 1e-8)')} AS value FROM long JOIN s USING (unit)""")
def normalise_robust(spark, d):
    return explode(transforms.normalise(vectors(spark, d), "vec", "robust_zscore"))


@query(f"""WITH s AS (SELECT l_suppkey, avg(l_quantity) AS m, greatest(stddev_samp(l_quantity), 1e-8) AS sd FROM lineitem GROUP BY 1)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {R('(l_quantity - m) / sd')} AS z, {R('l_quantity')} AS back FROM lineitem JOIN s USING (l_suppkey)""")
def label_zscores(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    st = scoring.label_stats(li, ["l_suppkey"], "l_quantity")
    z = transforms.unzlabel(transforms.zlabel(li, st, ["l_suppkey"], "l_quantity", "z"), st, ["l_suppkey"], "z", "back")
    return z.drop("l_quantity").withColumn("z", r6("z")).withColumn("back", r6("back"))


HASHES = """h AS (SELECT u AS unit, k AS out, md5('42:' || u || ':' || k) AS h FROM (SELECT unnest(range(64)) AS u), (SELECT unnest(range(16)) AS k)),
 un AS (SELECT unit, out, ((('0x' || substr(h, 1, 8))::BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS a, ((('0x' || substr(h, 9, 8))::BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS b FROM h)"""


@query(f"""WITH {LONG}, {HASHES}, w AS (SELECT unit, out, CASE WHEN b < 0.5 THEN -1 ELSE 1 END * pow(0.125::DOUBLE, -0.5) AS w FROM un WHERE a < 0.125)
 SELECT vec_id, out AS unit, {R('coalesce(sum(x * w), 0)')} AS value FROM long CROSS JOIN (SELECT unnest(range(16)) AS out) LEFT JOIN w USING (unit, out) GROUP BY 1, 2""")
def project_sparse(spark, d):
    return explode(transforms.random_project(vectors(spark, d), ["vec_id"], "vec", 64, 16, "sparse"))


@query(f"""WITH {LONG}, {HASHES}, w AS (SELECT unit, out, sqrt(-2 * ln(a)) * cos(2 * pi() * b) / 4 AS w FROM un)
 SELECT vec_id, out AS unit, {R('sum(x * w)')} AS value FROM long JOIN w USING (unit) GROUP BY 1, 2""")
def project_dense(spark, d):
    return explode(transforms.random_project(vectors(spark, d), ["vec_id"], "vec", 64, 16, "dense"))


@query(f"SELECT vec_id, u AS unit, {R('CASE WHEN u < 32 THEN embedding[u + 33] ELSE embedding[u - 31] END::DOUBLE')} AS value FROM embeddings, (SELECT unnest(range(64)) AS u)")
def layers_concatenated(spark, d):
    return explode(transforms.combine_layers(_layers(spark, d), ["vec_id"], ["second", "first"], "vec", "concatenate"))


@query(f"SELECT vec_id, u AS unit, {R('CASE WHEN u < 32 THEN embedding[u + 33] ELSE embedding[u - 31] END::DOUBLE')} AS value FROM embeddings, (SELECT unnest(range(64)) AS u)")
def layers_stacked(spark, d):
    return explode(transforms.flatten_vec(transforms.combine_layers(_layers(spark, d), ["vec_id"], ["second", "first"], "vec", "stack"), "vec"))


def _layers(spark, d):
    pieces = F.array(F.struct(F.lit("first").alias("layer"), F.slice("vec", 1, 32).alias("v")), F.struct(F.lit("second").alias("layer"), F.slice("vec", 33, 32).alias("v")))
    return vectors(spark, d).select("vec_id", F.explode(pieces).alias("z")).select("vec_id", "z.layer", F.col("z.v").alias("vec"))


@query(f"WITH {STORIES}, l AS (SELECT story, max(t) AS t FROM stories GROUP BY 1) SELECT story AS vec_id, u AS unit, {R('x[u + 1]')} AS value FROM stories JOIN l USING (story, t), (SELECT unnest(range(32)) AS u)")
def pool_last(spark, d):
    return explode(transforms.pool_sequence(stories(spark, d), ["story"], "t", "x", "last").withColumnRenamed("story", "vec_id").withColumnRenamed("x", "vec")).withColumn("vec_id", F.col("vec_id").cast("int"))


@query(f"WITH {STORIES} SELECT story AS vec_id, u AS unit, {R('avg(x[u + 1])')} AS value FROM stories, (SELECT unnest(range(32)) AS u) GROUP BY 1, 2")
def pool_mean(spark, d):
    return explode(transforms.pool_sequence(stories(spark, d), ["story"], "t", "x", "mean").withColumnRenamed("story", "vec_id").withColumnRenamed("x", "vec"))


@query(f"WITH {STORIES} SELECT story AS vec_id, t * 32 + u AS unit, {R('x[u + 1]')} AS value FROM stories, (SELECT unnest(range(32)) AS u)")
def pool_concatenated(spark, d):
    return explode(transforms.pool_sequence(stories(spark, d), ["story"], "t", "x", "concatenate").withColumnRenamed("story", "vec_id").withColumnRenamed("x", "vec"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents),
 s AS (SELECT *, sum(CASE WHEN pos = 0 OR regexp_matches(word, '^[A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS word_idx FROM w)
 SELECT doc_id, word_idx::BIGINT AS word_idx, count(*) AS n_pieces, round(avg(length(word)), 6) AS mean_len FROM s GROUP BY 1, 2""")
def pool_subwords(spark, d):
    """Runs of words opened by a capital play the part of words; their words play the pieces."""
    out = _pooled(spark, d)
    return out.select("doc_id", F.col("word_idx").cast("long").alias("word_idx"), "n_pieces", F.round(F.col("vec")[0], 6).alias("mean_len"))


def _pooled(spark, d, last=False):
    """Texts are pooled where they lie; those that share an id are one text to the SQL, so their words are brought together."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    words = F.split("text", " ")
    lengths = F.transform(words, lambda w: F.array(F.length(w).cast("double")))
    starts = F.transform(words, lambda w, i: (i == 0) | w.rlike("^[A-Z]"))
    twice = docs.groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id")
    if twice.isEmpty():
        return transforms.pool_texts(docs, "doc_id", lengths, starts, last)
    twice = checked_broadcast(twice)
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    shared = docs.join(twice, same, "left_semi")
    out = transforms.pool_texts(docs.join(twice, same, "left_anti"), "doc_id", lengths, starts, last)
    w = shared.select("doc_id", F.posexplode(words).alias("pos", "word")).withColumn("vec", F.array(F.length("word").cast("double")))
    rest = transforms.pool_words(w, "doc_id", "pos", "vec", (F.col("pos") == 0) | F.col("word").rlike("^[A-Z]"))
    names = ["doc_id", "word_idx", "vec"] if last else ["doc_id", "word_idx", "vec", "n_pieces"]
    return out.select(*names).unionByName((transforms.last_word(rest, "doc_id", "vec") if last else rest).select(*names))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents),
 s AS (SELECT *, sum(CASE WHEN pos = 0 OR regexp_matches(word, '^[A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS word_idx FROM w),
 p AS (SELECT doc_id, word_idx, avg(length(word)) AS m FROM s GROUP BY 1, 2)
 SELECT doc_id, max(word_idx)::BIGINT AS word_idx, round(max_by(m, word_idx), 6) AS mean_len FROM p GROUP BY 1""")
def last_subword(spark, d):
    out = _pooled(spark, d, last=True)
    return out.select("doc_id", F.col("word_idx").cast("long").alias("word_idx"), F.round(F.col("vec")[0], 6).alias("mean_len"))
