"""Deterministic folds and hold-outs in a portable hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import checked_broadcast, null_safe_join
from ..functions.ordering import hash_cutoffs, stable_hash
from ..session import cut_lineage
from .scoring import can_stratify


def _attach(df: DataFrame, strata: list[str], cuts: DataFrame) -> DataFrame:
    """Cut points next to every row: literals without strata, else a join with a short table."""
    if strata:
        return null_safe_join(df, checked_broadcast(cuts.withColumnRenamed("cuts", "_cuts")), strata)
    found = cuts.first()  # a few hash strings
    values = found["cuts"] if found is not None else []
    return df.withColumn("_cuts", F.array(*[F.lit(c) for c in values]).cast("array<string>"))


def _fold_ends(k: int):
    """Last rank of every fold but the final one; earlier folds take the remainder, one row each."""

    def ends(n: Column) -> Column:
        q, rest = F.floor(n / k), n % k
        return F.array(*[(f + 1) * q + F.least(F.lit(f + 1), rest) for f in range(k - 1)])

    return ends


def _folds(df: DataFrame, key: str, strata: list[str], k: int, seed: int, out: str) -> DataFrame:
    cuts = hash_cutoffs(df, strata, key, seed, _fold_ends(k))
    h = stable_hash(key, seed)
    fold = F.size(F.filter("_cuts", lambda c: c < h))
    if strata:
        # a stratum with fewer rows than folds may have no cut at all
        joined = null_safe_join(df, checked_broadcast(cuts.withColumnRenamed("cuts", "_cuts")), strata, "left")
        return joined.withColumn(out, F.coalesce(F.nullif(fold, F.lit(-1)), F.lit(0)).cast("int")).drop("_cuts")
    return _attach(df, strata, cuts).withColumn(out, fold.cast("int")).drop("_cuts")


def kfold(df: DataFrame, key: str, k: int = 10, seed: int = 42, out: str = "fold") -> DataFrame:
    """Balanced folds (sizes differ by at most one row): consecutive shares of the hash order."""
    return _folds(df, key, [], k, seed, out)


def stratified_kfold(df: DataFrame, key: str, label: str, k: int = 10, seed: int = 42, out: str = "fold") -> DataFrame:
    """Folds balanced within every class."""
    return _folds(df, key, [label], k, seed, out)


def group_folds(counts: list[tuple], k: int) -> list[tuple]:
    """Largest group first into the lightest fold; the fold count shrinks to the group count."""
    k = min(k, len(counts))
    if k < 2:
        raise ValueError(f"need at least 2 groups, got {len(counts)}")
    load, out = [0] * k, []
    for group, n in sorted(counts, key=lambda c: (-c[1], str(c[0]))):
        f = min(range(k), key=lambda i: (load[i], i))
        load[f] += n
        out.append((group, f))
    return out


def size_folds(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, list[tuple[int, list[int]]]]]:
    """The same rule as ``group_folds`` for (size, number of groups of that size), largest size first: for every size
    the ranks from which on its groups go round certain folds.  Equal groups go round the folds that are less than one
    group above the lightest, until the next fold is reached: at most k such rounds per size."""
    load, out = [0] * k, []
    for n, left in sizes:
        rank, rounds = 0, []
        while left:
            order = sorted(range(k), key=lambda i: (load[i], i))
            first = order[0]
            active = [i for i in order if (load[i], i) < (load[first] + n, first)] or [first]
            take = left
            if len(active) < k:
                up = order[len(active)]
                gap = load[up] - load[first]
                times = gap // n - (gap % n == 0 and up < first)
                take = min(left, times * len(active))
            rounds.append((rank, active))
            for at, i in enumerate(active):
                load[i] += n * (take // len(active) + (at < take % len(active)))
            rank, left = rank + take, left - take
        out.append((n, rounds))
    return out


def group_kfold(df: DataFrame, group: str, k: int = 5, out: str = "fold") -> DataFrame:
    """Folds that never split a group: largest group first into the lightest fold, at every number of groups.

    Only the distinct group sizes with their frequencies reach the driver (fewer than the square root of twice the rows);
    groups are numbered by a distributed sort."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", F.coalesce(F.col(group).cast("string"), F.lit("None")))
    ordered = cut_lineage(counts.orderBy(F.desc("_n"), "_s").select(group, "_n", F.monotonically_increasing_id().alias("_i")))
    # the sort's partitions follow each other: the id holds the partition above 33 bits, and below them the place in it
    part = F.shiftright("_i", 33)
    sizes = [(r["_n"], r["c"]) for r in ordered.groupBy("_n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("_n")).collect()]
    total = sum(c for _, c in sizes)
    k = min(k, total)
    if k < 2:
        raise ValueError(f"need at least 2 groups, got {total}")
    before, offsets = 0, []
    for r in ordered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c")).orderBy("p").collect():
        offsets.append((r["p"], before))
        before += r["c"]
    larger, plan = 0, []
    for (n, rounds), (_, c) in zip(size_folds(sizes, k), sizes):
        plan.append((n, larger, [{"start": start, "folds": folds} for start, folds in rounds]))
        larger += c
    spark = df.sparkSession
    rounds = spark.createDataFrame(plan, "_n long, _larger long, _rounds array<struct<start: long, folds: array<int>>>")
    numbered = ordered.withColumn("_p", part).join(F.broadcast(spark.createDataFrame(offsets, "_p long, _off long")), "_p").join(checked_broadcast(rounds), "_n")
    rank = F.col("_off") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)) - F.col("_larger")
    numbered = numbered.withColumn("_rank", rank).withColumn("_r", F.element_at(F.filter("_rounds", lambda r: r["start"] <= F.col("_rank")), -1))
    turn = F.pmod(F.col("_rank") - F.col("_r.start"), F.size("_r.folds").cast("long")).cast("int")
    folds = numbered.select(group, F.get("_r.folds", turn).alias(out))
    return null_safe_join(df, checked_broadcast(folds), [group])


def holdout(df: DataFrame, key: str, fraction: float = 0.1, label: str | None = None, seed: int = 42, out: str = "is_val") -> DataFrame:
    """Hold out ceil(fraction * n) rows, per class when stratifying is possible, else overall."""

    def ends(n: Column) -> Column:
        return F.array(F.ceil(n * F.lit(fraction)))

    h = stable_hash(key, seed)
    strata = [label] if label is not None and can_stratify(df, label).first()["stratify"] else []
    cuts = hash_cutoffs(df, strata, key, seed, ends)
    return _attach(df, strata, cuts).withColumn(out, F.coalesce(h <= F.col("_cuts")[0], F.lit(False))).drop("_cuts")
