"""Repeats and ceilings: averaging, noise ceilings, split-half and one-versus-all consistency.

Inputs are long trials ``(unit, stimulus, rep, value)``.  Each operator is one or two combinable
aggregates; a unit or stimulus that holds most of the rows is reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import scale, total, vector_sum
from ..functions.columns import nan_to_null, pearson, spearman_brown
from ..functions.joins import checked_broadcast
from ..functions.ordering import grouped_median, hash_row_number, stable_hash
from ..session import cut_lineage
from .align import trim_to_common_length

FLAT = 1e-24  # variance, as a share of the squared mean, that is rounding alone
RELIABLE = 0.15  # fixed value: ceiling above which a unit counts as reliable


def average_repetition(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean over repetitions for every other coordinate, skipping missing values."""
    return df.groupBy(*keys).agg(F.avg(nan_to_null(value)).alias(value))


def average_runs(df: DataFrame, group: Sequence[str], run: str, t: str, value: str = "value") -> DataFrame:
    """Mean over runs after trimming all runs of a group to the shortest one."""
    trimmed = trim_to_common_length(df, group, run, t)
    return trimmed.groupBy(*group, t).agg(F.avg(nan_to_null(value)).alias(value))


def sequence_mean(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(nan_to_null(value)).alias(value))


def behaviour_mean(trials: DataFrame, key: str = "stimulus_id", target: str = "target") -> DataFrame:
    return trials.groupBy(key).agg(F.avg(nan_to_null(F.col(target).cast("double"))).alias("behaviour"))


def noise_ceiling(trials: DataFrame, n: int = 1) -> DataFrame:
    """Noise-ceiling SNR per unit and the ceiling in percent for an average of ``n`` trials.

    Noise variance: mean over stimuli of the n-1 variance over repeats; total variance: population
    variance over all trials; the signal variance is their difference, not below zero.
    """
    cell = trials.groupBy("unit", "stimulus").agg(F.var_samp("value").alias("v"))
    noise = cell.groupBy("unit").agg(F.avg("v").alias("noise_var"))
    total = trials.groupBy("unit").agg(F.var_pop("value").alias("total_var"))
    signal = F.greatest(F.col("total_var") - F.col("noise_var"), F.lit(0.0))
    out = noise.join(total, "unit").withColumn(
        "ncsnr", F.try_divide(F.sqrt(signal), F.sqrt(F.col("noise_var")))
    )
    sq = F.col("ncsnr") * F.col("ncsnr")
    return out.select("unit", "noise_var", "total_var", "ncsnr", (100 * sq / (sq + 1.0 / n)).alias("ceiling_pct"))


def trial_halves(trials: DataFrame, n_splits: int, seed: int) -> DataFrame:
    """(split, rep, half): the trial axis cut in two for every split, in hash order."""
    reps = trials.select("rep").distinct()
    size = reps.agg(F.count(F.lit(1))).scalar()
    splits = reps.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))).withColumn(
        "_h", stable_hash(F.concat_ws(":", F.col("split").cast("string"), F.col("rep").cast("string")), seed)
    )
    ranked = hash_row_number(splits, ["split"], "_h", "rep", "_rk")
    return ranked.select("split", "rep", F.when(F.col("_rk") <= F.floor(size / 2), 1).otherwise(2).alias("half"))


def half_members(trials: DataFrame, n_splits: int, seed: int) -> DataFrame:
    """(rep, member): for every split 1.0 where the repetition is in the first half, else 0.0, as one array."""
    first = F.array_sort(F.collect_list(F.struct("split", (F.col("half") == 1).cast("double").alias("one"))))
    return trial_halves(trials, n_splits, seed).groupBy("rep").agg(F.transform(first, lambda s: s["one"]).alias("member"))


def split_half(trials: DataFrame, n_splits: int = 50, seed: int = 42, per_split: bool = False) -> DataFrame:
    """Mean corrected half-to-half correlation over random halvings of the trial axis.

    A trial carries its halves in all splits as one array, so no trial is copied: one aggregate per (unit, stimulus) forms the half
    sums of all splits, and two per unit the means and the products around them.  A cell without a value in a half is left out of that split.
    """
    value = F.col("value").cast("double")
    members = trials.where(value.isNotNull()).join(checked_broadcast(half_members(trials, n_splits, seed)), "rep")
    cells = members.groupBy("unit", "stimulus").agg(
        vector_sum(scale("member", value)).alias("s1"), vector_sum("member").alias("n1"), F.sum(value).alias("s"), F.count(F.lit(1)).alias("n")
    )

    def halves(s1: Column, n1: Column) -> Column:
        whole = (n1 > 0) & (n1 < F.col("n"))
        h1, h2 = F.coalesce(F.try_divide(s1, n1), F.lit(0.0)), F.coalesce(F.try_divide(F.col("s") - s1, F.col("n") - n1), F.lit(0.0))
        return F.struct(whole.cast("double").alias("k"), F.when(whole, h1).otherwise(0.0).alias("h1"), F.when(whole, h2).otherwise(0.0).alias("h2"))

    cells = cut_lineage(cells.select("unit", "stimulus", F.zip_with("s1", "n1", halves).alias("h")))
    means = cells.groupBy("unit").agg(*[vector_sum(F.col("h")[c]).alias(c) for c in ("k", "h1", "h2")])
    means = means.select("unit", "k", *[F.zip_with(c, "k", lambda x, k: F.coalesce(F.try_divide(x, k), F.lit(0.0))).alias(f"m{c}") for c in ("h1", "h2")])

    def apart(h: Column, m: Column) -> Column:
        a, b = h["k"] * (h["h1"] - m["mh1"]), h["k"] * (h["h2"] - m["mh2"])
        return F.struct((a * b).alias("ab"), (a * a).alias("aa"), (b * b).alias("bb"))

    around = cells.join(means, "unit").withColumn("p", F.zip_with("h", F.arrays_zip("mh1", "mh2"), apart))
    sums = around.groupBy("unit").agg(*[vector_sum(F.col("p")[c]).alias(c) for c in ("ab", "aa", "bb")])

    def corrected(s: Column) -> Column:
        # a half that is constant but for rounding has no correlation
        flat = (s["aa"] <= FLAT * s["k"] * s["mh1"] * s["mh1"]) | (s["bb"] <= FLAT * s["k"] * s["mh2"] * s["mh2"])
        r = F.coalesce(F.when(~flat, F.try_divide(s["ab"], F.sqrt(s["aa"] * s["bb"]))), F.lit(0.0))
        return spearman_brown(r)

    scored = sums.join(means, "unit").select("unit", F.transform(F.arrays_zip("ab", "aa", "bb", "k", "mh1", "mh2"), lambda s: F.when(s["k"] > 0, corrected(s))).alias("c"))
    if per_split:
        return scored.select("unit", F.posexplode("c").alias("split", "consistency")).where("consistency is not null")
    there = F.filter("c", lambda x: x.isNotNull())
    return scored.select("unit", F.try_divide(total(there), F.size(there)).alias("consistency"))


def one_vs_all(trials: DataFrame, per_trial: bool = False) -> DataFrame:
    """Each trial against the mean of the others, corrected, averaged over trials.

    "Total minus self" needs only the per-cell sum, joined back; there is no trial-by-trial pairing.
    """
    totals = trials.groupBy("unit", "stimulus").agg(
        F.sum("value").alias("_s"), F.count("value").alias("_n")
    )
    rest = F.try_divide(F.col("_s") - F.col("value"), F.col("_n") - 1)
    joined = trials.join(totals, ["unit", "stimulus"]).withColumn("rest", rest)
    r = joined.groupBy("unit", "rep").agg(F.coalesce(pearson("value", "rest"), F.lit(0.0)).alias("r"))
    scored = r.withColumn("consistency", spearman_brown("r"))
    if per_trial:
        return scored.select("unit", "rep", "consistency")
    return scored.groupBy("unit").agg(F.avg("consistency").alias("consistency"))


def _halves_by_parity(df: DataFrame, keys: Sequence[str], run: str, value: str) -> DataFrame:
    even = F.pmod(F.col(run), F.lit(2)) == 0
    return df.groupBy(*keys).agg(
        F.avg(F.when(even, F.col(value))).alias("h1"), F.avg(F.when(~even, F.col(value))).alias("h2")
    )


def _half_ceiling(c: str) -> Column:
    return spearman_brown(F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)))


def odd_even_ceiling(df: DataFrame, unit: str = "unit", t: str = "stimulus", run: str = "rep", value: str = "value") -> DataFrame:
    """Odd/even-run ceiling per unit: negative correlations count as zero, then corrected."""
    r = _halves_by_parity(df, [unit, t], run, value).groupBy(unit).agg(pearson("h1", "h2").alias("split_r"))
    return r.withColumn("ceiling", _half_ceiling("split_r"))


def ceiling_summary(ceilings: DataFrame) -> DataFrame:
    """Mean, exact median and how many units pass 0 / 0.1 / 0.2 / 0.5."""
    counts = ceilings.agg(
        F.count("ceiling").alias("n_units"),
        F.avg("ceiling").alias("mean_ceiling"),
        *[F.count_if(F.col("ceiling") > t).alias(f"n_above_{str(t).replace('.', '_')}") for t in (0, 0.1, 0.2, 0.5)],
    )
    median = grouped_median(ceilings, [], "ceiling", "median_ceiling")
    return counts.withColumn("median_ceiling", median.scalar())


def spatial_ceiling(
    df: DataFrame, ceilings: DataFrame, unit: str = "unit", t: str = "stimulus", run: str = "rep",
    value: str = "value", threshold: float = RELIABLE,
) -> DataFrame:
    """Per time point: reliability of the spatial pattern over units that pass the threshold."""
    keep = ceilings.where(F.col("ceiling") > threshold).select(unit)
    halves = _halves_by_parity(df.join(keep, unit, "left_semi"), [unit, t], run, value)
    r = halves.groupBy(t).agg(pearson("h1", "h2").alias("split_r"))
    return r.withColumn("ceiling", _half_ceiling("split_r"))


def detrend_zscore(df: DataFrame, keys: Sequence[str], t: str, value: str = "value", eps: float = 1e-10) -> DataFrame:
    """Remove each run's linear trend and divide by the n-1 standard deviation; a flat run gives 0.

    The trend and the residual spread both follow from one set of central moments per run.
    """
    keys = list(keys)
    m = df.groupBy(*keys).agg(
        F.avg(t).alias("_mt"), F.avg(value).alias("_mv"),
        F.coalesce(F.try_divide(F.covar_pop(value, t), F.var_pop(t)), F.lit(0.0)).alias("_slope"),
        F.var_pop(value).alias("_vv"), F.covar_pop(value, t).alias("_c"), F.count(value).alias("_n"),
    )
    resid_sd = F.sqrt(
        F.greatest(F.col("_vv") - F.col("_slope") * F.col("_c"), F.lit(0.0)) * F.try_divide(F.col("_n"), F.col("_n") - 1)
    )
    joined = df.join(m.withColumn("_sd", resid_sd), keys)
    resid = F.col(value) - F.col("_mv") - F.col("_slope") * (F.col(t) - F.col("_mt"))
    out = F.when(F.coalesce(F.col("_sd"), F.lit(0.0)) < eps, F.lit(0.0)).otherwise(F.try_divide(resid, F.col("_sd")))
    return joined.withColumn("z", out).select(*df.columns, "z")
