"""Temperature mixing of sources, with DataFrame operations only.

Source token shares are raised to an exponent in [0, 1] (1 keeps the shares, 0 levels the sources).  The exponent is
found by bisection: the largest one whose mix reaches a share of the greatest entropy, raised again as far as the
repetition limit asks.  The normalised weights are realised within a token budget: a source's documents lie in
``blocks`` hash blocks; whole passes take them all, the last pass takes blocks in that pass's permutation
until the source's budget is spent, the block on the border document by document.
One scan makes sums per (source, block); everything else is decided on those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, others, settle

HALVINGS = 40
ADDED = ("epoch", "block", "n_tokens")
OWN = ("_source", "_passes", "_whole", "_border", "_run")
FEW_SOURCES = 4000  # decisions on so many sources (8 KB each) are broadcast, more are joined; the rows are the same


def count_tokens(text: Column) -> Column:
    """Words: runs without [\\x20\\x09-\\x0D]; a text without any counts as one token."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))).cast("long")


def _hash(*parts: Column) -> Column:
    """A 32-bit number from md5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def _powers(a: Column) -> Column:
    return F.aggregate("_all", F.lit(0.0), lambda s, t: s + F.pow(t, a))


def _entropy(a: Column) -> Column:
    """Entropy of the mix at exponent ``a``, as a share of the greatest; 1 for a single source."""
    total = _powers(a)
    terms = F.aggregate("_all", F.lit(0.0), lambda s, t: s - F.pow(t, a) / total * F.ln(F.pow(t, a) / total))
    return F.when(F.size("_all") < 2, F.lit(1.0)).otherwise(terms / F.ln(F.size("_all")))


def _bisect(holds) -> Column:
    """The border in [0, 1] below which ``holds``: halved HALVINGS times, rounded to six digits."""
    first = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        return F.when(holds(mid), F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    return F.round(F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), first, halve)["lo"], 6)


def weights(totals: DataFrame, entropy: float, repeats: float, budget: float | None) -> DataFrame:
    """(_source, tokens) with exponent, weight and goal (tokens the mix takes from the source).

    The sums of all sources meet in one row, which grows with the number of sources and not with documents.
    """
    one = totals.agg(F.array_sort(F.collect_list(F.col("tokens").cast("double"))).alias("_all"))
    one = one.withColumn("_total", F.aggregate("_all", F.lit(0.0), lambda s, t: s + t))
    one = one.withColumn("_top", F.array_max("_all")).withColumn("_all", F.transform("_all", lambda t: t / F.col("_total")))
    rare, top = F.array_min("_all"), F.array_max("_all")

    def passes(a: Column) -> Column:
        """Passes over the rarest source, which is repeated most."""
        return F.pow(top / rare, 1 - a) if budget is None else F.pow(rare, a) / _powers(a) * budget / rare

    even = F.when(_entropy(F.lit(1.0)) >= entropy, F.lit(1.0)).otherwise(_bisect(lambda a: _entropy(a) >= entropy))
    often = F.when(passes(F.lit(0.0)) <= repeats, F.lit(0.0)).otherwise(F.least(F.lit(1.0), _bisect(lambda a: passes(a) > repeats) + 1e-6))
    one = one.withColumn("exponent", F.greatest(even, often)).withColumn("_sum", _powers(F.col("exponent"))).drop("_all")
    weight = F.round(F.pow(F.col("tokens") / F.col("_total"), F.col("exponent")) / F.col("_sum"), 9)
    if budget is None:
        goal = F.floor(F.col("tokens") * F.round(F.pow(F.col("_top") / F.col("tokens"), 1 - F.col("exponent")), 9))
    else:
        goal = F.floor(weight * F.col("_total") * budget)
    return totals.join(F.broadcast(one)).select(*totals.columns, "exponent", weight.alias("weight"), goal.alias("goal"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    entropy: float = 0.9, repeats: float = 4.0, budget: float | None = None, blocks: int = 1024, seed: int = 42,
) -> DataFrame:
    """The rows of the mix: a row of ``docs`` comes once for every pass that takes it, with epoch, block and n_tokens.

    ``entropy``: share of the greatest entropy that the weights must reach, as far as the limit allows;
    ``repeats``: most passes over a source; ``budget``: tokens of the mix as a multiple of those given, or None for
    the smallest budget that takes every document at least once (then nothing is left out, rarer sources are repeated).
    A null source is a source of its own; a null or empty text counts one token; a null id is hashed like an empty one;
    repeated rows lie in one block and are taken in turn.  Columns epoch, block, n_tokens are replaced, columns named like those of OWN go.  An empty table
    gives an empty table.
    """
    key = F.coalesce(F.concat(F.lit("="), col(source_col).cast("string")), F.lit(""))
    ident = F.coalesce(col(id_col).cast("string"), F.lit(""))
    rest = others(docs, *ADDED, *OWN)
    block = F.pmod(_hash(F.lit(seed), ident), F.lit(blocks))
    rows = docs.select(*[col(c) for c in rest], count_tokens(col(text_col)).alias("n_tokens"), key.alias("_source"), block.alias("block"))
    sums = settle(rows.groupBy("_source", "block").agg(F.sum("n_tokens").alias("_in_block")))
    goal = weights(sums.groupBy("_source").agg(F.sum("_in_block").alias("tokens")), entropy, repeats, budget)
    goal = goal.withColumn("_passes", F.floor(F.col("goal") / F.col("tokens"))).withColumn("_left", F.col("goal") - F.col("_passes") * F.col("tokens"))
    order = Window.partitionBy("_source").orderBy(_hash(F.lit(seed), F.lit("pass"), F.col("_passes"), F.col("block")), "block")
    spent = sums.join(goal, "_source").withColumn("_after", F.sum("_in_block").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spent = spent.withColumn("_before", F.col("_after") - F.col("_in_block"))
    border = (F.col("_before") < F.col("_left")) & (F.col("_after") > F.col("_left"))
    last = spent.groupBy("_source").agg(
        F.first("_passes").alias("_passes"),
        F.collect_list(F.when(F.col("_after") <= F.col("_left"), F.col("block"))).alias("_whole"),
        F.max(F.when(border, F.struct("block", (F.col("_left") - F.col("_before")).alias("room")))).alias("_border"),
    )
    last = settle(last)
    taken = rows.join(F.broadcast(last) if last.count() <= FEW_SOURCES else last, "_source")
    times = F.col("_passes") + F.array_contains("_whole", F.col("block")).cast("long")
    full = taken.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    line = Window.partitionBy("_source").orderBy(_hash(F.lit(seed), F.col("_passes"), ident), ident).rowsBetween(Window.unboundedPreceding, 0)
    cut = taken.where(F.col("block") == F.col("_border.block")).withColumn("_run", F.sum("n_tokens").over(line))
    cut = cut.where(F.col("_run") <= F.col("_border.room")).withColumn("epoch", F.col("_passes"))
    out = [*[col(c) for c in rest], F.col("epoch").cast("long").alias("epoch"), F.col("block").cast("long").alias("block"), "n_tokens"]
    return full.select(*out).unionByName(cut.select(*out))
