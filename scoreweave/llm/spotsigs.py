"""SpotSigs fingerprints with DataFrame functions only.

A signature is a chain of content words that follows a common word (its anchor).  The fingerprint of a text is the set of
its signatures.  Two fingerprints are compared by Jaccard likeness, pruned by set length: lengths lie in
geometric parts, and sets that are too far apart in length to reach ``least`` are not intersected.

Every document is compared with its edited text and with the next document.  Neighbours are found without
a window over the whole table: keys (id, digest of the text) are dealt by ranges, the first key of a range also visits the range before,
and texts are shuffled once, into those ranges.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LEAST, col, id_key, settle

# Common words of English, French, German and Spanish
COMMON = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour que qui sa se ses son sur un une vous "
    "als am auch auf aus bei das dem den der des die ein eine einer er es für hat ich im ist mit nach nicht oder sich sie sind und von vor war wie wir zu zum "
    "al como con del el ella en era es esta fue ha la las lo los más no para pero por que se si sin su sus un una y ya yo"
).split()
GAP = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"  # what separates words: ASCII without letters and digits
PART = 8 << 20  # code points in a range of neighbours
EACH = 8  # ranges in a task, so that tasks are even
MOST = 16_384  # ranges whose first keys the driver holds; in a larger table they are longer, and their tasks spill
FAN = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spot_signatures(text: Column, common: list[str] | tuple = tuple(COMMON)) -> Column:
    """Sorted distinct signatures: 16 hex digits each of md5(anchor, content word, next content word).

    The anchor is the last common word right before the content word.  Words are lower-cased; the last content word has no
    other after it.  A text without a common word before a content word takes every content word for an anchor of the next; a
    text without content words has no signatures, null is an empty text.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")
    marked = F.array_join(F.transform(words, lambda w: F.concat(w, F.when(w.isin(*common), " ").otherwise("\n"))), "")

    def of_units(units: Column) -> Column:  # common words and the content word they stand before
        content = F.transform(units, lambda u: F.substring_index(u, " ", -1))
        return let(F.slice(content, 2, F.greatest(F.size(units), F.lit(1))), lambda following: of_both(units, following))

    def of_both(units: Column, following: Column) -> Column:
        spots = F.zip_with(units, following, lambda u, b: F.when(F.instr(u, " ") > 0, F.concat_ws(" ", F.substring_index(u, " ", -2), b)))
        chains = F.zip_with(units, following, lambda u, b: F.concat_ws(" ", u, b))
        return let(F.array_compact(spots), lambda x: F.when(F.size(x) > 0, x).otherwise(chains))

    # the part after the last content word has none and is no unit
    spots = let(F.split(marked, "\n"), lambda units: let(F.slice(units, 1, F.size(units) - 1), of_units))
    return F.array_sort(F.array_distinct(F.transform(spots, lambda s: F.substring(F.md5(s), 1, 16))))


def likeness(a: Column, b: Column, least: float = 0.05) -> Column:
    """Jaccard likeness of two signature sets; 0 where their lengths alone keep it below ``least``.

    Length n lies in part floor(ln n / ln(1 / least)); sets two parts apart, or neighbours with a ratio under ``least``, are
    not intersected.  Two empty sets are alike (1), an empty and a filled one are not (0).
    """
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))

    def part(n: Column) -> Column:
        return F.floor(F.ln(n) / F.ln(F.lit(1 / least)) + 1e-9)

    far = (part(large) - part(small) > 1) | (small < large * F.lit(least))
    near = let(F.size(F.array_intersect(a, b)), lambda shared: shared / (F.size(a) + F.size(b) - shared))
    return F.when(large == 0, 1.0).when(small == 0, 0.0).when(far, 0.0).otherwise(near)


def _ranges(keys: DataFrame, count: int) -> list[list[tuple]]:
    """First keys of ``count`` ranges in descending order, in lists of FAN."""
    dealt = keys.select("_id", "_h").repartitionByRange(count, F.col("_id").desc(), F.col("_h").desc())
    first = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("_id", "_h")).alias("k"))
    heads = sorted(((r["k"]["_id"], r["k"]["_h"]) for r in first.collect()), reverse=True)  # one row a range
    return [heads[i : i + FAN] for i in range(0, len(heads), FAN)]


def _range_of(groups: list[list[tuple]], key: Column) -> tuple[Column, Column]:
    """Number of the range a key lies in, and whether the key is the first of it: two short searches."""
    said = json.dumps([[{"_id": i, "_h": h} for i, h in g] for g in groups])
    table = F.from_json(F.lit(said), "array<array<struct<_id:bigint,_h:string>>>")
    tops = F.from_json(F.lit(json.dumps([{"_id": g[0][0], "_h": g[0][1]} for g in groups])), "array<struct<_id:bigint,_h:string>>")
    group = F.size(F.filter(tops, lambda x: x >= key))
    place = F.size(F.filter(F.element_at(table, group), lambda x: x >= key))
    return (group - 1) * FAN + place - 1, F.element_at(F.element_at(table, group), place) == key


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prepare=None) -> DataFrame:
    """One row per row of ``docs``: _id, text, next_text, and with ``prepare`` (a function of a text column) _own and _next of both.

    Next is the row with the next smaller id, after the last the first.  Rows that share an id follow one another
    in descending order of their texts' md5.
    """
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(id_key(id_col).alias("_id"), text.alias("text")).withColumn("_h", F.md5("text"))
    keys = settle(rows.groupBy("_id", "_h").agg(F.count(F.lit(1)).alias("_m"), F.sum(F.length("text").cast("long")).alias("_c")))
    sums = keys.agg(F.sum("_c").alias("c"), F.count(F.lit(1)).alias("n"), F.max("_m").alias("m")).first()
    if not sums["n"]:
        empty = rows.select("_id", "text", F.col("text").alias("next_text"), F.lit(1).cast("long").alias("_times"))
        return empty.select("*", prepare(F.col("text")).alias("_own"), prepare(F.col("text")).alias("_next")) if prepare else empty
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = max(EACH * tasks, -(-sums["c"] // PART))
    groups = _ranges(keys, min(count, sums["n"], MOST))
    heads = sum(map(len, groups))
    rows = rows.withColumn("_m", F.lit(1).cast("long"))
    if sums["m"] > 1:  # repeated rows: one stands for all, so a hot row never meets itself
        again = keys.where("_m > 1").select("_id", "_h", F.col("_m").alias("_n"))
        both = rows.join(again, ["_id", "_h"], "left")
        once = both.where("_n is not null").groupBy("_id", "_h").agg(F.first("text").alias("text"), F.first("_n").alias("_m"))
        rows = both.where("_n is null").select("_id", "_h", "text", "_m").unionByName(once)
    place, first = _range_of(groups, F.struct("_id", "_h"))
    rows = rows.withColumn("_range", place.cast("int")).withColumn("_first", first)
    home = F.struct(F.col("_range").alias("_range"), F.lit(False).alias("_guest"))
    guest = F.struct(F.pmod(F.col("_range") - 1, F.lit(heads)).alias("_range"), F.lit(True).alias("_guest"))
    rows = rows.withColumn("_to", F.explode(F.when(F.col("_first"), F.array(home, guest)).otherwise(F.array(home))))
    rows = rows.select("_id", "_h", "text", "_m", "_to._range", "_to._guest").repartition(max(tasks, heads if heads >= MOST else heads // EACH), "_range")
    if prepare:
        rows = rows.withColumn("_own", prepare(F.col("text")))
    order = Window.partitionBy("_range").orderBy("_guest", F.col("_id").desc(), F.col("_h").desc())
    rows = rows.withColumn("next_text", F.lead("text").over(order))
    if prepare:
        rows = rows.withColumn("_next", F.lead("_own").over(order))
    rows = rows.where("not _guest")
    parts = [("next_text", "text"), *([("_next", "_own")] if prepare else [])]
    last = F.struct(*[F.col(a).alias(a) for a, _ in parts], F.lit(1).cast("long").alias("_times"))
    before = F.struct(*[F.col(b).alias(a) for a, b in parts], (F.col("_m") - 1).alias("_times"))
    out = ["_id", "text", *(["_own"] if prepare else [])]
    rows = rows.select(*out, F.explode(F.when(F.col("_m") > 1, F.array(last, before)).otherwise(F.array(last))).alias("_to"))
    return rows.select(*out, "_to.*")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 3, least: float = 0.05) -> DataFrame:
    """Per document: doc_id, text, n_chars, edited_text, signatures and edited_signatures (arrays), near_edited, near_next.

    In the edited text the last floor(n_chars / ``share``) code points are replaced by the first as many (or all) of
    the next document's.  A null or empty text has no signatures; equal texts have equal signatures.  A null id is an id of its own, below all
    others; repeated rows come back as often as they are.  Ids are cast to long.  Other columns are ignored; an empty
    table gives an empty table.
    """
    rows = with_next(docs, id_col, text_col, spot_signatures)
    n = F.length("text").cast("long")
    cut = F.floor(n / share).cast("int")
    rows = rows.withColumn("n_chars", n).withColumn("edited_text", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    rows = rows.withColumn("edited_signatures", spot_signatures(F.col("edited_text"))).withColumnRenamed("_own", "signatures")
    rows = rows.withColumn("near_edited", likeness(F.col("signatures"), F.col("edited_signatures"), least))
    rows = rows.withColumn("near_next", likeness(F.col("signatures"), F.col("_next"), least))
    doc_id = F.when(F.col("_id") != LEAST, F.col("_id")).alias("doc_id")
    rows = rows.select(doc_id, "text", "n_chars", "edited_text", "signatures", "edited_signatures", "near_edited", "near_next", "_times")
    return rows.withColumn("_times", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).drop("_times")
