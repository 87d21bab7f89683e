"""Row numbers, running sums, average ranks and medians that never put one whole group in one task.

A window with ``PARTITION BY key`` sorts all rows of a key in a single task, and a window without
PARTITION BY sorts the whole table in one.  Here a group is first cut into ordered buckets; the
window runs inside a bucket, and small per-bucket totals supply the offsets between buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import col
from .joins import null_safe_join, small_table

HASH_BUCKET_HEX = 3  # 16 ** 3 equal-probability buckets of a hash order
MEDIAN_ACCURACY = 10000  # rank error of the sketch that narrows the search: n / accuracy


def stable_hash(key: Column | str, seed: int | str = 42) -> Column:
    """Portable pseudo-random order: hex md5 of ``seed:key``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string")))


def hash_to_long(hex_hash: Column) -> Column:
    return F.conv(F.substring(hex_hash, 1, 8), 16, 10).cast("long")


def hash_row_number(df: DataFrame, keys: Sequence[str], order_hash: str, tie: str, out: str) -> DataFrame:
    """1-based position of each row in hash order within ``keys`` (all rows when ``keys`` is empty).

    The leading hex digits of the hash are the buckets, so buckets are equal in size whatever the
    key distribution; offsets come from a table of at most 4096 counts per key.
    """
    keys = list(keys)
    bucketed = df.withColumn("_o_b", F.substring(order_hash, 1, HASH_BUCKET_HEX))
    counts = bucketed.groupBy(*keys, "_o_b").agg(F.count(F.lit(1)).alias("_o_n"))
    before = Window.partitionBy(*keys).orderBy("_o_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_o_off", F.coalesce(F.sum("_o_n").over(before), F.lit(0))).drop("_o_n")
    inside = Window.partitionBy(*keys, "_o_b").orderBy(order_hash, tie)
    numbered = bucketed.withColumn("_o_rn", F.row_number().over(inside))
    return (
        null_safe_join(numbered, offsets, [*keys, "_o_b"])
        .withColumn(out, (F.col("_o_rn") + F.col("_o_off")).cast("long"))
        .drop("_o_b", "_o_rn", "_o_off")
    )


def hash_cutoffs(df: DataFrame, strata: Sequence[str], key: Column | str, seed: int | str, ends: Callable[[Column], Column]) -> DataFrame:
    """(strata, cuts): the hash values found at the ranks ``ends(n)`` of each stratum's hash order.

    Assigning rows to rank ranges then only compares hashes, so wide rows are never shuffled or
    sorted.  The search reads the key column alone: bucket counts (combined before the shuffle)
    locate the few buckets that hold a wanted rank, and only those buckets are ordered.
    """
    strata = list(strata)
    narrow = df.select(*strata, stable_hash(key, seed).alias("_o_h")).withColumn(
        "_o_b", F.substring("_o_h", 1, HASH_BUCKET_HEX)
    )
    counts = narrow.groupBy(*strata, "_o_b").agg(F.count(F.lit(1)).alias("_o_c"))
    upto = Window.partitionBy(*strata).orderBy("_o_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*strata)
    placed = counts.select(
        *strata, "_o_b", (F.sum("_o_c").over(upto) - F.col("_o_c")).alias("_o_off"), F.sum("_o_c").over(upto).alias("_o_to"),
        F.sum("_o_c").over(whole).alias("_o_n"),
    )
    wanted = placed.withColumn("_o_end", F.explode(ends(F.col("_o_n")))).where(
        (F.col("_o_off") < F.col("_o_end")) & (F.col("_o_end") <= F.col("_o_to"))
    )
    inside = Window.partitionBy(*strata, "_o_b", "_o_end").orderBy("_o_h")
    hits = (
        null_safe_join(narrow, small_table(wanted), [*strata, "_o_b"])
        .withColumn("_o_rank", F.row_number().over(inside) + F.col("_o_off"))
        .where(F.col("_o_rank") == F.col("_o_end"))
    )
    return hits.groupBy(*strata).agg(F.array_sort(F.collect_list("_o_h")).alias("cuts"))


def range_running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: Column | str, width: int, out: str
) -> DataFrame:
    """Inclusive running sum of ``value`` by integer ``order`` within ``keys``.

    Buckets are ``order div width``; ``order`` must be unique within a key.
    """
    keys = list(keys)
    v = df.withColumn("_o_v", col(value)).withColumn("_o_b", F.floor(F.col(order) / width).cast("long"))
    sums = v.groupBy(*keys, "_o_b").agg(F.sum("_o_v").alias("_o_s"))
    before = Window.partitionBy(*keys).orderBy("_o_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_o_off", F.coalesce(F.sum("_o_s").over(before), F.lit(0))).drop("_o_s")
    inside = Window.partitionBy(*keys, "_o_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        null_safe_join(v.withColumn("_o_in", F.sum("_o_v").over(inside)), offsets, [*keys, "_o_b"])
        .withColumn(out, F.col("_o_in") + F.col("_o_off"))
        .drop("_o_v", "_o_b", "_o_in", "_o_off")
    )


SPLITS = 64  # sketch split points per group; each gap is cut again into as many equal ranges


def _cut_points(value: str) -> Column:
    return F.percentile_approx(value, [i / SPLITS for i in range(SPLITS + 1)], MEDIAN_ACCURACY)


def _range_bucket(value: Column, cuts: Column) -> Column:
    """Order-preserving bucket number: the gap between split points, then the position inside it."""
    gap = F.size(F.filter(cuts, lambda c: c < value))
    lo, hi = F.get(cuts, gap - 1), F.get(cuts, gap)
    inside = F.least(F.floor(F.try_divide(value - lo, hi - lo) * SPLITS), F.lit(SPLITS - 1))
    return (gap * SPLITS + F.coalesce(inside, F.lit(0))).cast("long")


def ordered_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """1-based position by ``order`` within ``keys`` for an arbitrary sortable first order column.

    Split points come from a mergeable quantile sketch per key (bounded size), so a hot key is cut
    into up to 4096 ordered pieces; the numbering itself is exact.  Rows equal in the first order
    column share a bucket.
    """
    keys, order = list(keys), list(order)
    first = F.col(order[0])
    typed = first.cast("double") if dict(df.dtypes)[order[0]] not in ("timestamp", "date") else None
    probe = typed if typed is not None else F.unix_micros(first.cast("timestamp")).cast("double")
    tagged = df.withColumn("_o_p", probe)
    splits = tagged.groupBy(*keys).agg(_cut_points("_o_p").alias("_o_cuts"))
    cut = (
        null_safe_join(tagged, small_table(splits), keys) if keys else tagged.withColumn("_o_cuts", splits.scalar())
    ).withColumn("_o_b", _range_bucket(F.col("_o_p"), F.col("_o_cuts")))
    counts = cut.groupBy(*keys, "_o_b").agg(F.count(F.lit(1)).alias("_o_n"))
    before = Window.partitionBy(*keys).orderBy("_o_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_o_off", F.coalesce(F.sum("_o_n").over(before), F.lit(0))).drop("_o_n")
    inside = Window.partitionBy(*keys, "_o_b").orderBy(*order)
    return (
        null_safe_join(cut.withColumn("_o_rn", F.row_number().over(inside)), offsets, [*keys, "_o_b"])
        .withColumn(out, (F.col("_o_rn") + F.col("_o_off")).cast("long"))
        .drop("_o_p", "_o_cuts", "_o_b", "_o_rn", "_o_off")
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Distinct values of each group with their frequency and their average (tie) rank.

    Equal values are collapsed to one row with a count before anything is ordered.
    """
    distinct = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_tied"))
    return ranks_of_counts(distinct, keys, value, out)


def ranks_of_counts(distinct: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Average ranks from distinct values with frequencies ``n_tied``."""
    keys = list(keys)
    splits = distinct.groupBy(*keys).agg(_cut_points(value).alias("_o_cuts"))
    cut = (
        null_safe_join(distinct, small_table(splits), keys) if keys else distinct.withColumn("_o_cuts", splits.scalar())
    ).withColumn("_o_b", _range_bucket(F.col(value), F.col("_o_cuts")))
    sums = cut.groupBy(*keys, "_o_b").agg(F.sum("n_tied").alias("_o_n"))
    before = Window.partitionBy(*keys).orderBy("_o_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_o_off", F.coalesce(F.sum("_o_n").over(before), F.lit(0))).drop("_o_n")
    inside = Window.partitionBy(*keys, "_o_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        null_safe_join(cut.withColumn("_o_c", F.sum("n_tied").over(inside)), offsets, [*keys, "_o_b"])
        .withColumn(out, F.col("_o_off") + F.col("_o_c") - (F.col("n_tied") - 1) / F.lit(2.0))
        .drop("_o_cuts", "_o_b", "_o_c", "_o_off")
    )


def grouped_median(
    df: DataFrame, keys: Sequence[str], value: Column | str, out: str, count_out: str | None = None
) -> DataFrame:
    """Exact interpolated median per group without sorting a whole group in one task.

    A quantile sketch with a proven rank error brackets the middle; rows below the bracket are only
    counted, equal values inside it are collapsed to counts, and only those distinct values are
    ordered.  NULLs are ignored.
    """
    keys = list(keys)
    v = df.select(*keys, col(value).cast("double").alias("_o_v")).where(F.col("_o_v").isNotNull())
    slack = 4.0 / MEDIAN_ACCURACY
    band = v.groupBy(*keys).agg(
        F.percentile_approx("_o_v", [0.5 - slack, 0.5 + slack], MEDIAN_ACCURACY).alias("_o_band"),
        F.count(F.lit(1)).alias("_o_n"),
    )
    if keys:
        joined = null_safe_join(v, small_table(band), keys)
    else:
        joined = v.withColumn("_o_band", band.select("_o_band").scalar()).withColumn("_o_n", band.select("_o_n").scalar())
    # One row per distinct value inside the bracket, and one row (NULL) for everything outside it:
    # how many values lie below, and the nearest values on either side.
    lo, hi = F.col("_o_band")[0], F.col("_o_band")[1]
    inside = F.when((F.col("_o_v") >= lo) & (F.col("_o_v") <= hi), F.col("_o_v"))
    slim = joined.groupBy(*keys, inside.alias("_o_mid")).agg(
        F.count(F.lit(1)).alias("_o_cnt"),
        F.count_if(F.col("_o_v") < lo).alias("_o_below"),
        F.max(F.when(F.col("_o_v") < lo, F.col("_o_v"))).alias("_o_prev"),
        F.min(F.when(F.col("_o_v") > hi, F.col("_o_v"))).alias("_o_next"),
        F.first("_o_n").alias("_o_n"),
    )
    step = F.when(F.col("_o_mid").isNull(), F.col("_o_below")).otherwise(F.col("_o_cnt"))
    run = Window.partitionBy(*keys).orderBy(F.col("_o_mid").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = slim.withColumn("_o_to", F.sum(step).over(run)).withColumn("_o_from", F.col("_o_to") - F.col("_o_cnt") + 1)
    k1, k2 = F.floor((F.col("_o_n") + 1) / 2), F.floor((F.col("_o_n") + 2) / 2)

    def pick(k: Column) -> Column:
        covered = F.col("_o_mid").isNotNull() & (F.col("_o_from") <= k) & (k <= F.col("_o_to"))
        return F.max(F.when(covered, F.col("_o_mid")))

    out_df = ranked.groupBy(*keys).agg(
        pick(k1).alias("_o_a"), pick(k2).alias("_o_z"),
        F.max("_o_prev").alias("_o_prev"), F.min("_o_next").alias("_o_next"), F.first("_o_n").alias("_o_n"),
    )
    low, high = F.coalesce("_o_a", "_o_prev"), F.coalesce("_o_z", "_o_next")
    cols = [*keys, ((low + high) / 2).alias(out)]
    if count_out:
        cols.append(F.col("_o_n").alias(count_out))
    return out_df.select(*cols)
