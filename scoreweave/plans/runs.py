"""Benchmarks as configuration and whole scoring runs: score, ceiling, roll-up, store."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.ordering import grouped_median
from ..functions.registry import MetricInput, get_metric
from ..operators import linear as L
from ..operators.align import align, apply_ceiling
from ..operators.gram import moments
from ..operators.prep import mask_by_ceiling
from ..operators.splits import group_kfold
from ..session import cut_lineage
from ..sources.store import append_scores


@dataclass(frozen=True)
class Benchmark:
    """A benchmark is data: which stimuli, which regions, which split, which metrics."""

    name: str
    assembly: str
    regions: tuple[str, ...] = ()
    split: str | None = None
    stratify: str | None = None
    ceiling_threshold: float | None = None
    metrics: tuple[str, ...] = ("ridge",)
    params: dict = field(default_factory=dict)  # keyword arguments by metric name
    key: str = "stimulus_id"
    folds: int = 10


@dataclass(frozen=True)
class Assembly:
    """What was measured: (key, y and the columns that split and stratify), one (unit, region) row for every region
    a unit lies in, and (unit, ceiling).  A unit is its position in ``y``, from 0."""

    responses: DataFrame
    units: DataFrame | None = None
    ceilings: DataFrame | None = None


BENCHMARKS: dict[str, Benchmark] = {}


def register_benchmark(b: Benchmark) -> Benchmark:
    BENCHMARKS[b.name] = b
    return b


def roll(scores: DataFrame, ceilings: DataFrame | None, metric: str, run: str = "run", values: Sequence[str] = ("pearson", "r2")) -> DataFrame:
    """Median over targets per run and mean over runs, raw and ceiled, as (metric, stat, value) rows.

    All statistics are melted to rows first, so one median pass serves them all.
    """
    if ceilings is not None:
        scores = scores.join(ceilings, "target", "left")
    stats = []
    for v in values:
        ceiled = F.try_divide(F.col(v), F.col("ceiling")) if ceilings is not None else F.col(v)
        stats += [
            F.struct(F.lit(f"final_unceiled_{v}").alias("stat"), F.col(v).alias("v")),
            F.struct(F.lit(f"final_{v}").alias("stat"), ceiled.alias("v")),
        ]
    long = scores.select(run, F.explode(F.array(*stats)).alias("_s")).select(run, "_s.*")
    med = grouped_median(long, [run, "stat"], "v", "m")
    return med.groupBy("stat").agg(F.avg("m").alias("value")).select(F.lit(metric).alias("metric"), "stat", "value")


def score_run(inp: MetricInput, metric: str, model: str, layer: str, benchmark: str, path: str | None = None, **params) -> DataFrame:
    """One offline score: fit, score every target, ceiling, roll up and (optionally) append."""
    scores = cut_lineage(get_metric(metric)(inp, **params))
    if "pearson" in scores.columns:
        table = roll(scores, inp.ceiling, metric)
    else:  # one score, or one for each method: the mean over runs
        stat = F.concat(F.lit("final_"), F.col("method")) if "method" in scores.columns else F.lit("final_score")
        table = scores.groupBy(stat.alias("stat")).agg(F.avg("score").alias("value")).select(F.lit(metric).alias("metric"), "stat", "value")
    out = table.select(F.lit(model).alias("model"), F.lit(layer).alias("layer"), F.lit(benchmark).alias("benchmark"), "*")
    if path is not None:
        append_scores(out, path)
    return out


def measured(b: Benchmark, assembly: Assembly) -> tuple[DataFrame, DataFrame | None]:
    """Responses cut to the units of the benchmark's regions whose ceiling passes, and the ceilings by position in the cut vector.

    The chosen positions are one array per query, gathered from every response vector.
    """
    responses, ceilings = assembly.responses, assembly.ceilings
    if not b.regions and b.ceiling_threshold is None:
        return responses, None if ceilings is None else ceilings.select(F.col("unit").alias("target"), "ceiling")
    units = assembly.units.where(F.col("region").isin(*b.regions)) if b.regions else ceilings
    units = units.select("unit").distinct()
    if b.ceiling_threshold is not None:
        units = mask_by_ceiling(units, ceilings, b.ceiling_threshold)
    units = cut_lineage(units)
    if units.isEmpty():
        raise ValueError(f"no unit of {b.name} lies in {b.regions} above ceiling {b.ceiling_threshold}")
    listed = units.agg(F.sort_array(F.collect_list("unit")).alias("units"))
    responses = responses.withColumn("_units", listed.scalar())
    responses = responses.withColumn("y", F.transform("_units", lambda u: F.get("y", u.cast("int")))).drop("_units")
    if ceilings is not None:
        ceilings = listed.select(F.posexplode("units").alias("target", "unit")).join(ceilings, "unit").select("target", "ceiling")
    return responses, ceilings


def run_benchmark(b: Benchmark, features: DataFrame, assembly: Assembly, model: str, path: str | None = None) -> DataFrame:
    """Every layer of ``features`` (layer, key, x) under every metric of the benchmark, as (model, layer, benchmark, metric, stat, value).

    Unknown metrics raise before anything runs.  A metric that fails among others is warned of and the others go on; a single one raises.
    """
    for metric in b.metrics:
        get_metric(metric)
    responses, ceilings = measured(b, assembly)
    wanted = [b.key, "y", *dict.fromkeys(c for c in (b.split, b.stratify) if c)]
    out = None
    for layer in sorted(r["layer"] for r in features.select("layer").distinct().collect()):
        one = features.where(F.col("layer") == layer).select(b.key, "x")
        rows = cut_lineage(align(one, responses.select(*wanted), [b.key]))  # read by all metrics, several times by each
        inp = MetricInput(rows, b.key, split=b.split, stratify=b.stratify, ceiling=ceilings, folds=b.folds)
        for metric in b.metrics:
            try:
                table = cut_lineage(score_run(inp, metric, model, layer, b.name, **b.params.get(metric, {})))
            except Exception as failure:
                if len(b.metrics) == 1:
                    raise
                warnings.warn(f"{metric} failed on {layer}: {failure}", stacklevel=2)
                continue
            out = table if out is None else out.unionByName(table)
    if out is None:
        raise ValueError(f"{b.name}: no layer, or no metric that ran")
    if path is not None:
        append_scores(out, path)
    return out


def assembly_to_assembly(source: DataFrame, target: DataFrame, key: str, regions: Sequence[tuple[str, str]], metric: str = "ridge", folds: int = 10, **params) -> DataFrame:
    """One subject's responses predict another's, for every listed (source, target) region pair.

    ``source``/``target``: (key, region, vec).  Each pair is its own fit, because widths differ.
    """
    out = None
    for s, t in regions:
        rows = source.where(F.col("region") == s).select(key, F.col("vec").alias("x")).join(
            target.where(F.col("region") == t).select(key, F.col("vec").alias("y")), key
        )
        one = get_metric(metric)(MetricInput(rows, key=key, folds=folds), **params).select(
            F.lit(s).alias("source_region"), F.lit(t).alias("target_region"), "run", "target", "pearson", "r2"
        )
        out = one if out is None else out.unionByName(one)
    return out


@dataclass
class StoryFit:
    """Group-held-out fit of a time-resolved run: labelled rows, sizes and weights of every fold."""

    rows: DataFrame
    weights: DataFrame
    dim_x: int
    dim_y: int


def story_fit(aligned: DataFrame, story: str, x: str, y: str, folds: int = 5, alphas: Sequence[float] = L.GROUP_ALPHAS) -> StoryFit:
    """Ridge with whole stories held out and one leave-one-out alpha per fold.

    ``aligned`` has one row per (story, t) with x and y vectors.  The weights are small and read by
    every later step, so they are checkpointed.
    """
    rows = group_kfold(aligned, story, folds)
    rows = cut_lineage(rows.withColumn("part", F.col("fold").cast("string")))  # read by four later scans
    k = rows.agg(F.count_distinct("fold")).first()[0]
    m = moments(rows, "part", x, y, parts=k)
    weights = L.ridge_loo(rows, "part", x, y, m, L.cv_design(aligned.sparkSession, k), alphas, shared=True)
    return StoryFit(rows, cut_lineage(weights), m.dim_x, m.dim_y)


def story_units(fit: StoryFit, ceilings: DataFrame) -> DataFrame:
    """Median over folds of every unit's r and R2, with the ceiled r."""
    per_unit = grouped_median(fit.weights, ["target"], "pearson", "pearson").join(
        grouped_median(fit.weights, ["target"], "r2", "r2"), "target"
    )
    return apply_ceiling(per_unit, ceilings, ["target"], "pearson")


def story_predictions(fit: StoryFit, key: str, story: str, t: str, x: str, y: str) -> DataFrame:
    """Held-out predictions as long (story, t, unit, y, p) rows."""
    pred = L.predict(fit.rows, [key, story, t], x, fit.weights, fit.dim_x, fit.dim_y, run_of="part")
    return L.long_predictions(pred, [key, story, t], fit.rows, y).select(
        F.col(story).alias("story"), F.col(t).alias("t"), F.col("target").alias("unit"), "y", "p"
    )


def vector_rows(df: DataFrame, key: str, vec: str, split_at: int) -> DataFrame:
    """(key, x, y) with the first ``split_at`` entries as features and the rest as responses."""
    v = A.as_double(vec)
    return df.select(key, F.slice(v, 1, split_at).alias("x"), F.slice(v, F.lit(split_at + 1), F.size(v) - split_at).alias("y"))
