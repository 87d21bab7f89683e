"""Filters, id clean-up, masks, remaps and row expansion."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import CEILING_FLOOR, col, finite_or_zero, floor_ceiling
from ..functions.ordering import hash_row_number, ordered_row_number, stable_hash

# The class ids kept by the pruned action set, in dense-index order.
ACTION_CLASSES = (
    0, 1, 2, 3, 4, 5, 6, 8, 10, 12, 13, 14, 15, 16, 22, 23, 31, 33, 38, 39,
    46, 51, 53, 90, 91, 92, 122, 124, 130, 138, 139, 141, 143, 144, 150, 151, 156, 170, 171, 173,
)
# Channel range [start, end) of each region per recorded subject.
CHANNEL_RANGES = (
    ("monkeyN", "V1", 0, 512), ("monkeyN", "V4", 512, 768), ("monkeyN", "IT", 768, 1024),
    ("monkeyN", "Full", 0, 1024), ("monkeyF", "V1", 0, 512), ("monkeyF", "IT", 512, 832),
    ("monkeyF", "V4", 832, 1024), ("monkeyF", "Full", 0, 1024),
)
# Region names by the label column they are matched in.
STREAM_REGIONS = (
    "ventral", "parietal", "lateral", "highventral", "highparietal", "highlateral",
    "midparietal", "midlateral", "midventral",
)
VISUAL_REGIONS = ("V1", "V2", "V3", "V4", "V1d", "V2d", "V1v", "V3d", "V2v", "V3v")
# Reliability thresholds used by the data sets.
CEILING_THRESHOLDS = {"story": 0.15, "images": 0.2, "videos": 0.0, "recordings": -1000.0}

CEILING_DIGITS = 12  # fixed value


def split_filter(stimuli: DataFrame, train: bool, intra: bool = False, behaviour: DataFrame | None = None) -> DataFrame:
    """Rows of one split; a test split also needs behaviour for the stimulus (semi join)."""
    keep = F.col("train") == (1 if train else 0)
    if intra:
        keep = keep & (F.col("intra_generalizability") == 1)
    out = stimuli.where(keep)
    if not train and behaviour is not None:
        out = out.join(behaviour.select("stimulus_id"), "stimulus_id", "left_semi")
    return out


def drop_sentinel(df: DataFrame, column: str, sentinel: float = -1) -> DataFrame:
    return df.where(F.col(column) != sentinel)


def norm_id(c: Column | str) -> Column:
    """Base name, cut at the first dot, then cut at ``_img``."""
    base = F.element_at(F.split(col(c), "/"), -1)
    return F.substring_index(F.substring_index(base, ".", 1), "_img", 1)


def drop_tail(c: Column | str, chars: int) -> Column:
    """The string without its last ``chars`` characters."""
    c = col(c)
    return F.when(F.length(c) > chars, F.substring(c, F.lit(1), F.length(c) - chars)).otherwise(F.lit(""))


def class_mapping(spark, classes: Sequence[int] = ACTION_CLASSES) -> DataFrame:
    return spark.createDataFrame([(int(c), i) for i, c in enumerate(classes)], "class INT, idx INT")


def remap_classes(df: DataFrame, mapping: DataFrame, column: str = "class") -> DataFrame:
    """Sparse class ids to dense indices; unknown classes drop out.  ``mapping`` is a fixed list."""
    return df.join(F.broadcast(mapping), column)


def dense_labels(df: DataFrame, column: str, out: str = "class_idx") -> DataFrame:
    """Contiguous indices for the classes present.  Only the distinct classes are ordered."""
    classes = df.where(F.col(column).isNotNull()).select(column).distinct()
    ranked = ordered_row_number(classes, [], [column], "_pos")
    return df.join(ranked.select(column, (F.col("_pos") - 1).cast("int").alias(out)), column)


def task_type(df: DataFrame, column: str) -> DataFrame:
    """One row: binary (exactly 0/1), soft binary (within [0, 1], more than two values) or multiclass."""
    values = F.col(column).cast("double")
    stats = df.agg(
        F.count_distinct(values).alias("n_values"),
        F.min(values).alias("lo"),
        F.max(values).alias("hi"),
        F.bool_and((values == 0) | (values == 1)).alias("all01"),
    )
    kind = (
        F.when((F.col("n_values") == 2) & F.col("all01"), "binary")
        .when((F.col("lo") >= 0) & (F.col("hi") <= 1) & (F.col("n_values") > 2), "soft_binary")
        .otherwise("multiclass")
    )
    gaps = F.col("n_values") < F.floor(F.col("hi")) + 1
    return stats.select(
        kind.alias("task"),
        F.col("n_values").cast("long").alias("n_values"),
        F.when(kind == "multiclass", F.col("n_values")).otherwise(F.lit(2)).cast("long").alias("n_classes"),
        (gaps & (kind == "multiclass")).alias("has_gaps"),
    )


def channel_ranges(spark) -> DataFrame:
    return spark.createDataFrame(list(CHANNEL_RANGES), "subject STRING, region STRING, lo INT, hi INT")


def select_channels(df: DataFrame, ranges: DataFrame, region: str | None = None) -> DataFrame:
    """Attach (and optionally keep) the region whose channel range holds the unit.

    The ranges are a short fixed table per subject, hence the broadcast; the equi part of the
    join is the subject and the range is a filter on it.
    """
    if region is not None:
        ranges = ranges.where(F.col("region") == region)
    r = F.broadcast(ranges)
    hit = (df["subject"] == r["subject"]) & (df["unit"] >= r["lo"]) & (df["unit"] < r["hi"])
    return df.join(r, hit).select(df["*"], r["region"])


def region_predicate(region: str, stream_cols: Sequence[str], visual_cols: Sequence[str]) -> Column:
    """Label match for one region name, OR-ed over the hemispheres' label columns."""
    if region in STREAM_REGIONS:
        if region.startswith("high"):
            tests = [F.col(c) == region.replace("high", "") for c in stream_cols]
        else:
            tests = [F.col(c).contains(region) for c in stream_cols]
    elif region in VISUAL_REGIONS:
        tests = [F.col(c).contains(region) for c in visual_cols]
    else:
        raise ValueError(f"Invalid region: {region}")
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return F.coalesce(out, F.lit(False))


def select_roi(df: DataFrame, regions: Iterable[str], stream_cols: Sequence[str], visual_cols: Sequence[str]) -> DataFrame:
    """Rows of each requested region, tagged with it; a unit may serve several regions.

    One pass: the matching names become an array per row, which is then exploded.
    """
    tags = [F.when(region_predicate(r, stream_cols, visual_cols), F.lit(r)) for r in regions]
    return df.withColumn("roi", F.explode(F.filter(F.array(*tags), lambda t: t.isNotNull())))


def select_roi_affix(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Variant by prefix or suffix of the region name."""
    keep = F.lit(False)
    for n in names:
        keep = keep | F.col(column).startswith(n) | F.col(column).endswith(n)
    return df.where(keep)


def mask_by_ceiling(
    responses: DataFrame, ceilings: DataFrame, threshold: float, keys: Sequence[str] = ("unit",),
    inclusive: bool = False, test_ceilings: DataFrame | None = None, test_threshold: float | None = None,
) -> DataFrame:
    """Responses of the units whose ceiling passes, in train and (where given) test alike.

    A ceiling counts to ``CEILING_DIGITS`` decimals, so that one equal to the threshold does not pass by the order of its sum.
    """
    keys = list(keys)

    def passing(c: DataFrame, least: float) -> DataFrame:
        value = F.round("ceiling", CEILING_DIGITS)
        return c.where(value >= least if inclusive else value > least).select(*keys).distinct()

    keep = passing(ceilings, threshold)
    if test_ceilings is not None:
        keep = keep.join(passing(test_ceilings, threshold if test_threshold is None else test_threshold), keys, "left_semi")
    return responses.join(keep, keys, "left_semi")


def clean_values(df: DataFrame, column: str, clip: float | None = None) -> DataFrame:
    return df.withColumn(column, finite_or_zero(column, clip))


def floored_ceilings(df: DataFrame, floor: float = CEILING_FLOOR, column: str = "ceiling") -> DataFrame:
    return df.withColumn(column, floor_ceiling(column, floor))


def kept_features(dim: int, k: int, seed: int = 42) -> list[int]:
    """The ``k`` feature positions that come first in hash order, in ascending position.

    The feature axis is schema-sized, so this list is computed once on the driver.
    """
    import hashlib

    by_hash = sorted(range(dim), key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
    return sorted(by_hash[:k])


def subsample_features(df: DataFrame, vec: str, dim: int, k: int, seed: int = 42) -> DataFrame:
    """Keep ``k`` of ``dim`` features, the same ones for every row."""
    if k >= dim:
        return df
    keep = F.array(*[F.lit(i) for i in kept_features(dim, k, seed)])
    return df.withColumn(vec, F.transform(keep, lambda i: F.element_at(F.col(vec), i + 1)))


def keep_fraction(df: DataFrame, vec: str, dim: int, fraction: float, seed: int = 42) -> DataFrame:
    """Keep a sorted fraction of the feature axis, at least one feature."""
    return subsample_features(df, vec, dim, max(1, int(dim * fraction)), seed)


def exclude(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    return df.where(~F.col(column).isin(list(names)))


def resample_sequence(df: DataFrame, key: str, order: str, fps: float, target_fps: float, seconds: int = 4) -> DataFrame:
    """Every ``max(round(fps / target), 1)``-th item, at most ``target * seconds``, padded with the last kept item.

    Output ``slot`` runs from 0 to the fixed length - 1 for every key.  Rows past the fixed length
    are filtered before the shuffle that orders the few that remain.
    """
    step, n = max(round(fps / target_fps), 1), int(target_fps * seconds)
    numbered = ordered_row_number(df, [key], [order], "_pos")
    kept = numbered.where(((F.col("_pos") - 1) % step == 0) & ((F.col("_pos") - 1) / step < n)).withColumn(
        "slot", ((F.col("_pos") - 1) / step).cast("int")
    )
    payload = [c for c in df.columns if c != key]
    last = kept.groupBy(key).agg(
        F.max("slot").alias("_last"), F.max_by(F.struct(*payload), "slot").alias("_item")
    )
    pad = last.select(
        key,
        F.explode(F.when(F.col("_last") < n - 1, F.sequence(F.col("_last") + 1, F.lit(n - 1)))).alias("slot"),
        "_item",
    ).select(key, "slot", "_item.*")
    return kept.select(key, "slot", *payload).unionByName(pad)


def expand_repeats(df: DataFrame, copies: int = 18, base: int = 3, step: int = 2) -> DataFrame:
    """Each item becomes ``copies`` rows; copy k stands for a clip of ``base + step * k`` frames."""
    return df.withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn(
        "n_frames", F.col("repetition") * step + base
    )


def normalise_targets(df: DataFrame, gt: str, behaviour: str | None = None, stimulus: str | None = None) -> DataFrame:
    """All target forms as one nullable struct; behaviour must be present for all rows or none."""
    target = F.struct(
        (F.col(stimulus).cast("string") if stimulus else F.lit(None).cast("string")).alias("stimulus"),
        F.col(gt).cast("double").alias("gt"),
        (F.col(behaviour).cast("double") if behaviour else F.lit(None).cast("double")).alias("behav"),
    )
    out = df.withColumn("target", target)
    if behaviour is None:
        return out
    present = df.agg(F.count(behaviour).alias("b"), F.count(F.lit(1)).alias("n"))
    ok = present.select(((F.col("b") == 0) | (F.col("b") == F.col("n"))).alias("ok")).scalar()
    mixed = F.raise_error(F.lit("Mixed presence of behavioral targets")).cast("string")
    checked = F.when(ok, F.lit("ok")).otherwise(mixed)
    return out.where(checked == "ok")


def drop_empty(df: DataFrame, text: str | None = None, signal: str | None = None, silence: float = 1e-8) -> DataFrame:
    """Drop missing, blank or silent samples."""
    if text is not None:
        df = df.where(F.col(text).isNotNull() & (F.trim(F.col(text)) != ""))
    if signal is not None:
        peak = F.array_max(F.transform(F.col(signal), lambda x: F.abs(x)))
        df = df.where(F.coalesce(peak, F.lit(0.0)) >= silence)
    return df


def hash_sample_rank(df: DataFrame, key: str, seed: int = 42, out: str = "hash_rank") -> DataFrame:
    """Position of each row in the portable hash order of its key."""
    return hash_row_number(df.withColumn("_h", stable_hash(key, seed)), [], "_h", key, out).drop("_h")
