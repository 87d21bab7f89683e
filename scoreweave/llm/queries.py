"""Registered queries of the subpackage with their SQL."""

from __future__ import annotations

from zlib import crc32

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    embed_dup, hard_negatives, line_dedup, mixing, near_dedup, packing, periodic_runs, query, secret_scan, spotsigs, substring_dedup, topk, toxicity, url_filter,
)

# Rules of the query (host, path prefix, verdict)
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
# Domain labels whose hosts make up the block list
FLAGGED = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
TOKENIZER = "word_bpe_49k.json"


def categories() -> dict:
    """Categories in chain order, from the columns of labels."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocked_hosts(pages: DataFrame) -> DataFrame:
    """Domains in ``pages`` whose first label is flagged."""
    found = F.regexp_extract(url_filter.url_host(F.col("url")), rf"(?:^|\.)((?:{'|'.join(FLAGGED)})\..*)$", 1)
    return pages.select(found.alias("host")).where("host <> ''").distinct()


@query(r"""WITH l AS (SELECT doc_id, pos, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
 f AS (SELECT k, max(doc_id) AS keep FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
 j AS (SELECT l.doc_id, l.pos, l.line, f.k IS NOT NULL AND f.keep <> l.doc_id AS gone FROM l LEFT JOIN f ON l.k = f.k)
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id""")
def op1_line_dedup(spark, d):
    out = line_dedup.dedup_lines(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query(r"""WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
 r AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1' WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
  WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/' WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/' WHEN ('.' || host) LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule FROM u)
 SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.') THEN 'block' ELSE 'allow' END AS verdict FROM r""")
def op2_url_filter(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, RULES, blocked_hosts(pages)).select("page_id", "host", "path", "rule", "verdict")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS q FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
 s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
 SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""")
def op3_topk(spark, d):
    return topk.top_k(table(spark, d, "embeddings").select("vec_id", "embedding"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM w WHERE len(w) >= 20)),
 f AS (SELECT k, min({'d': doc_id, 's': s}) AS m FROM s GROUP BY k HAVING count(*) > 1),
 g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM s JOIN f USING (k) WHERE m.d <> doc_id OR m.s <> s),
 x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
 y AS (SELECT x.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE g.p IS NULL) AS t FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.p = x.p GROUP BY x.doc_id)
 SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN y USING (doc_id)""")
def op4_substring_dedup(spark, d):
    out = substring_dedup.remove_repeats(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op5_best_fit_packing(spark, d):
    return packing.pack(table(spark, d, "documents").select("doc_id", "text"), public_tokenizers.path(TOKENIZER))


@query()
def op6_toxicity(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, table(spark, d, "labels"), categories())
    return toxicity.score(docs, chain).drop("text")


@query(r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))),
 u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 r AS (SELECT doc_id AS a, doc_id AS c FROM n UNION SELECT u.a, r.c FROM r JOIN u ON u.b = r.a WHERE r.c < u.a),
 c AS (SELECT a, min(c) AS c FROM r GROUP BY a)
 SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, w.doc_id) AS component_id, coalesce(c.c, w.doc_id) = w.doc_id AS kept
 FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id""")
def op7_minhash_near_dedup(spark, d):
    return near_dedup.near_duplicates(table(spark, d, "documents").select("doc_id", "text"))


@query("""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
 u AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.q, b.q) >= 0.95),
 r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT u.a, r.c FROM r JOIN u ON u.b = r.a WHERE r.c < u.a),
 c AS (SELECT a, min(c) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM u GROUP BY a)
 SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.c, vec_id) AS component_id, coalesce(c.c, vec_id) = vec_id AS kept
 FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id""")
def op8_embedding_near_dedup(spark, d):
    return embed_dup.near_vectors(table(spark, d, "embeddings").select("vec_id", "embedding"))


def listed(*columns: str):
    """kind:start:end of spans in order, joined by commas."""
    kind = F.create_map(*[F.lit(x) for i, k in enumerate(secret_scan.KINDS) for x in (k[0], i)])
    both = F.array_sort(F.transform(F.concat(*columns), lambda s: F.struct(s["start"].alias("start"), kind[s["kind"]].alias("o"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(both, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query()
def op9_secret_scan(spark, d):
    out = secret_scan.scan_secrets(table(spark, d, "documents").select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind, *_ in secret_scan.KINDS]
    return out.select("doc_id", *counts, F.sha2(listed("base_spans"), 256).alias("base_sha256"), listed("base_spans", "added_spans").alias("spans"))


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, '=' || source AS source, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS n_tokens,
  ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % 1024 AS block FROM documents),
 b AS (SELECT source, block, sum(n_tokens)::BIGINT AS n FROM d GROUP BY ALL), t AS (SELECT source, sum(n)::BIGINT AS n FROM b GROUP BY 1),
 p AS (SELECT list(n::DOUBLE / (SELECT sum(n) FROM t) ORDER BY n) AS p, max(n) AS top, max(n)::DOUBLE / min(n) AS ratio FROM t),
 h AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.0::DOUBLE AS lo2, 1.0::DOUBLE AS hi2 UNION ALL
  SELECT i + 1, CASE WHEN e THEN m ELSE lo END, CASE WHEN e THEN hi ELSE m END, CASE WHEN o THEN m2 ELSE lo2 END, CASE WHEN o THEN hi2 ELSE m2 END FROM (
   SELECT h.*, (lo + hi) / 2 AS m, (lo2 + hi2) / 2 AS m2, pow(ratio, 1 - (lo2 + hi2) / 2) > 4 AS o,
    list_sum(list_transform(p, lambda x: -(pow(x, (lo + hi) / 2) / list_sum(list_transform(p, lambda y: pow(y, (lo + hi) / 2)))) * ln(pow(x, (lo + hi) / 2) / list_sum(list_transform(p, lambda y: pow(y, (lo + hi) / 2)))))) / ln(len(p)) >= 0.9 AS e FROM h, p) WHERE i < 40),
 a AS (SELECT greatest(CASE WHEN list_sum(list_transform(p, lambda x: -x * ln(x))) / ln(len(p)) >= 0.9 THEN 1.0 ELSE round(lo, 6) END, CASE WHEN ratio <= 4 THEN 0.0 ELSE least(1.0, round(lo2, 6) + 1e-6) END) AS a, top FROM h, p WHERE i = 40),
 g AS (SELECT source, n, floor(n * round(pow(top::DOUBLE / n, 1 - a), 9))::BIGINT AS goal FROM t, a),
 k AS (SELECT *, goal // n AS passes, goal - goal // n * n AS rest FROM g),
 x AS (SELECT b.source, b.block, b.n, passes, rest, sum(b.n) OVER (PARTITION BY b.source ORDER BY ('0x' || substr(md5('42:pass:' || passes || ':' || b.block), 1, 8))::BIGINT, b.block) AS after_ FROM b JOIN k ON k.source = b.source),
 y AS (SELECT *, after_ <= rest AS whole, after_ - n < rest AND after_ > rest AS border, rest - (after_ - n) AS room FROM x),
 z AS (SELECT d.*, passes, whole, border, room, CASE WHEN border THEN sum(n_tokens) OVER (PARTITION BY d.source, border ORDER BY ('0x' || substr(md5('42:' || passes || ':' || doc_id), 1, 8))::BIGINT, doc_id::VARCHAR) END AS run FROM d JOIN y ON y.source = d.source AND y.block = d.block)
 SELECT doc_id, source[2:] AS source, unnest(range(0, passes + CASE WHEN whole OR (border AND run <= room) THEN 1 ELSE 0 END)) AS epoch, block, n_tokens FROM z""")
def op10_source_mixing(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).drop("text")


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """For a tenth of the ids the words from some place on become periodic; without an id nothing changes."""
    h = crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a : a + p] * -(-(n - a) // p))[: n - a]]


@query()
def op11_periodic_runs(spark, d):
    out = periodic_runs.collapse_runs(table(spark, d, "documents").select("doc_id", "text"), edit=periodic_tail)
    best = [F.col("best")[c].alias(c) for c in ("start", "length", "period")]
    milli = F.expr("best.length * 1000 div best.period").alias("exponent_milli")
    digests = [F.sha2(periodic_runs.listed("runs"), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256")]
    return out.select("doc_id", "n_runs", *best, milli, *digests)


@query("""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END::BIGINT AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
 SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
 WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
 WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3""")
def op12_hard_negatives(spark, d):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, d, "embeddings").select("vec_id", "embedding", label.alias("label")))


def spots_sql(text: str) -> str:
    """DuckDB expression of the signatures of a text."""
    common = ", ".join(f"'{w}'" for w in dict.fromkeys(spotsigs.COMMON))
    units = f"""string_split(array_to_string(list_transform(list_filter(regexp_split_to_array(lower({text}), '{spotsigs.GAP}'), lambda w: w <> ''),
   lambda w: w || CASE WHEN w IN ({common}) THEN ' ' ELSE chr(10) END), ''), chr(10))[:-2]"""
    following = f"(list_transform({units}, lambda u: string_split(u, ' ')[-1]))[2:]"
    spots = f"""list_transform(list_filter(list_zip({units}, {following}), lambda z: contains(z[1], ' ')),
   lambda z: concat_ws(' ', array_to_string(string_split(z[1], ' ')[-2:], ' '), z[2]))"""
    chains = f"list_transform(list_zip({units}, {following}), lambda z: concat_ws(' ', z[1], z[2]))"
    return f"list_sort(list_distinct(list_transform(CASE WHEN len({spots}) > 0 THEN {spots} ELSE {chains} END, lambda s: substr(md5(s), 1, 16))))"


def likeness_sql(a: str, b: str) -> str:
    """DuckDB expression of the likeness of two signature lists, pruned by their lengths."""
    shared = f"len(list_intersect({a}, {b}))"
    return f"""CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 OR least(len({a}), len({b})) < greatest(len({a}), len({b})) * 0.05::DOUBLE THEN 0.0
  ELSE {shared}::DOUBLE / (len({a}) + len({b}) - {shared}) END::DOUBLE"""


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 n AS (SELECT doc_id, text, length(text) AS n, length(text) // 3 AS e, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first(text) OVER (ORDER BY doc_id DESC)) AS nt FROM t),
 e AS (SELECT *, substr(text, 1, n - e) || substr(nt, 1, e) AS et FROM n),
 s AS (SELECT *, {spots_sql('text')} AS a, {spots_sql('et')} AS b, {spots_sql('nt')} AS c FROM e)
 SELECT doc_id, n::BIGINT AS n_chars, sha256(et) AS edited_sha256, array_to_string(a, ',') AS fingerprint, array_to_string(b, ',') AS edited_fingerprint,
  {likeness_sql('a', 'b')} AS near_edited, {likeness_sql('a', 'c')} AS near_next FROM s""")
def op13_spotsigs(spark, d):
    out = spotsigs.fingerprints(table(spark, d, "documents").select("doc_id", "text"))
    prints = [F.array_join("signatures", ",").alias("fingerprint"), F.array_join("edited_signatures", ",").alias("edited_fingerprint")]
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), *prints, "near_edited", "near_next")
