"""Toxicity by a chain of linear classifiers.

The categories are predicted in order.  Every model of the chain sees the words of the text and the probabilities of
the categories before it.  While training, those probabilities come from models that did not see the row (out of fold),
so that later models learn from what earlier ones are worth on new texts.  The threshold of the last category is
the one that does best on out-of-fold probabilities.

Training takes a bounded sample of labelled documents; the fits of a category (one per fold, one on all folds) run side by side,
each in a task.  Scoring is one pass over all documents without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, id_key, others, settle

SAMPLE = 20_000  # most labelled documents to train on, in hash order; scoring covers all documents
FEATURES = 1 << 18
FOLDS = 3
PENALTY = 1e-3
RARE = 2  # words in fewer training documents carry no weight
STEPS = 100
PIECE = re.compile(r"[^\W_]+")
REMEMBERED = 300_000  # word numbers kept in a worker; more are hashed again


@dataclass
class Model:
    """Weights of the hashed words, of the earlier categories' probabilities, and the constant."""

    words: np.ndarray
    rest: np.ndarray
    bias: float

    def probability(self, found: list[np.ndarray], before: np.ndarray) -> np.ndarray:
        z = np.array([self.words[f].sum() for f in found]) + before @ self.rest + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Chain:
    """Models by category, in order, and the threshold of the last."""

    models: dict[str, Model]
    threshold: float


def word_numbers(text: str, known: dict[str, int]) -> np.ndarray:
    """Distinct hashed words (letters and digits, lower case) of a text."""
    own = set(PIECE.findall(text.lower()))
    if len(known) > REMEMBERED:
        known.clear()
    for w in own:
        if w not in known:
            known[w] = xxhash.xxh32_intdigest(w) % FEATURES
    return np.array(sorted({known[w] for w in own}), np.int32)


def minimise(cost, start: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with halved steps; ``cost`` returns value and gradient."""
    x, (value, slope) = start, cost(start)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, back = slope.copy(), []
        for s, y, r in reversed(moves):
            back.append(r * (s @ q))
            q -= back[-1] * y
        if moves:
            s, y, r = moves[-1]
            q /= r * (y @ y)
        for (s, y, r), a in zip(moves, reversed(back)):
            q += s * (a - r * (y @ q))
        size, gain = 1.0 if moves else 1.0 / max(1.0, float(np.abs(slope).sum())), float(q @ slope)
        if gain < 1e-10:
            break
        while True:
            new, (now, after) = x - size * q, cost(x - size * q)
            if now <= value - 1e-4 * size * gain or size < 1e-10:
                break
            size /= 2
        s, y = new - x, after - slope
        if s @ y > 1e-14:
            moves = [*moves[1 - memory :], (s, y, 1 / (s @ y))] if memory > 1 else []
        if value - now < 1e-9 * abs(value):
            x = new
            break
        x, value, slope = new, now, after
    return x


def logistic(found: list[np.ndarray], before: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> Model:
    """Penalised logistic regression on words scaled by their log count ratio; without both labels a constant, without rows zero."""
    width = before.shape[1]
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(FEATURES), np.zeros(width), 500.0 if len(y) and y[0] else -500.0)
    flat = np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(y)), [len(f) for f in found])
    n = len(y)
    held, pos = np.bincount(flat, minlength=FEATURES), np.bincount(flat, y[row], FEATURES)
    ratio = np.log((pos + 1) / (y.sum() + 2)) - np.log((held - pos + 1) / (n - y.sum() + 2))
    ratio[held < RARE] = 0
    scale = ratio[flat]

    def cost(w: np.ndarray):
        z = np.bincount(row, w[flat] * scale, n) + before @ w[FEATURES:-1] + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        off = (p - y) / n
        value = (np.logaddexp(0, z) - y * z).mean() + penalty / 2 * (w[:-1] @ w[:-1])
        slope = np.concatenate([np.bincount(flat, off[row] * scale, FEATURES), off @ before, [off.sum()]])
        slope[:-1] += penalty * w[:-1]
        return value, slope

    w = minimise(cost, np.zeros(FEATURES + width + 1), STEPS)
    return Model(w[:FEATURES] * ratio, w[FEATURES:-1], float(w[-1]))


def _unpack(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in column.to_pylist()]


def _before(t, names: list[str]) -> np.ndarray:
    return np.stack([t.column(n).to_numpy() for n in names], 1) if names else np.empty((t.num_rows, 0))


def _number(batches):
    known: dict[str, int] = {}
    for b in batches:
        found = [word_numbers(t or "", known).tobytes() for t in b.column("_text").to_pylist()]
        own = [c for c in b.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(found, pa.binary())], [*own, "_words"])


def _fit(label: str, before: list[str]):
    def run(t: pa.Table) -> pa.Table:
        t = t.filter(pa.array(np.isin(t.column(label).to_numpy(zero_copy_only=False), (0, 1))))
        t = t.sort_by("_id")
        m = logistic(_unpack(t.column("_words")), _before(t, before), t.column(label).to_numpy().astype(float))
        return pa.table({"words": pa.array([m.words.tobytes()], pa.binary()), "rest": pa.array([m.rest.tobytes()], pa.binary()), "bias": [m.bias]})

    def keyed(key, t):
        return run(t).append_column("fit", pa.array([key[0].as_py()], pa.int64()))

    return keyed


def _unseen(models: list[Model], before: list[str], out: str):
    """Probabilities from the model that did not see the row's fold."""

    def run(batches):
        for b in batches:
            found, rest, fold = _unpack(b.column("_words")), _before(b, before), b.column("_fold").to_numpy()
            p = np.zeros(b.num_rows)
            for k, m in enumerate(models):
                own = np.flatnonzero(fold == k)
                p[own] = m.probability([found[i] for i in own], rest[own]) if len(own) else 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], [*b.schema.names, out])

    return run


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the highest F1, in the middle of the gap below the last row it takes; above 1 without positive rows."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + max(y.sum(), 1)) if len(y) else np.zeros(1)
    f1[: len(p)][np.append(p[1:] == p[:-1], False)] = 0  # equal probabilities go together
    i = int(f1.argmax())
    if f1[i] == 0:
        return 1.01
    return float((p[i] + (p[i + 1] if i + 1 < len(p) else 0)) / 2)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Chain:
    """A chain for ``categories`` (name -> 0/1 column of ``labels``), in their order.

    At most ``sample`` labelled ids are used, chosen by hash.  Rows without an id or with another label than 0 or 1 are left out of a
    category's model; an id labelled or written more than once counts once.  Without rows, or with one label only, a model is constant.
    """
    chosen = labels.select(id_key(id_col).alias("_id"), *[c.cast("int").alias(f"_{n}") for n, c in categories.items()]).where(F.col("_id") > F.lit(-(2**63)))
    chosen = chosen.groupBy("_id").agg(*[F.coalesce(F.max(f"_{n}"), F.lit(-1)).cast("long").alias(f"_{n}") for n in categories])
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample).withColumn("_fold", F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(FOLDS)))
    kinds = ", ".join(["_id long", *[f"_{n} long" for n in categories], "_fold long"])
    rows = docs.select(id_key(id_col).alias("_id"), col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), "_id")
    rows = rows.select("_id", *[f"_{n}" for n in categories], "_fold", "_text").mapInArrow(_number, f"{kinds}, _words binary")
    rows = settle(rows.groupBy(*[c for c in rows.columns if c != "_words"]).agg(F.min("_words").alias("_words")))
    models: dict[str, Model] = {}
    before: list[str] = []
    for name in categories:
        fits = rows.withColumn("_fit", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FOLDS).cast("long")))).where("_fit <> _fold")
        fits = fits.groupBy("_fit").applyInArrow(_fit(f"_{name}", before), "words binary, rest binary, bias double, fit long").collect()  # FOLDS + 1 rows
        got = {r["fit"]: Model(np.frombuffer(r["words"]), np.frombuffer(r["rest"]), r["bias"]) for r in fits}
        none = Model(np.zeros(FEATURES), np.zeros(len(before)), -500.0)
        models[name] = got.get(FOLDS, none)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
        rows = settle(rows.mapInArrow(_unseen([got.get(k, none) for k in range(FOLDS)], before, f"p_{name}"), f"{schema}, p_{name} double"))
        before.append(f"p_{name}")
    last = list(categories)[-1]
    seen = rows.where(col(f"_{last}").isin(0, 1)).select(f"p_{last}", f"_{last}").collect()  # at most ``sample`` pairs of numbers
    return Chain(models, best_threshold(np.array([r[0] for r in seen]), np.array([float(r[1]) for r in seen])))


def _score(chain: Chain, text_col: str, names: list[str]):
    def run(batches):
        known: dict[str, int] = {}
        for b in batches:
            found = [word_numbers(t or "", known) for t in b.column(text_col).cast(pa.string()).to_pylist()]
            before = np.empty((b.num_rows, 0))
            for m in chain.models.values():
                before = np.column_stack([before, m.probability(found, before)])
            new = [*(pa.array(before[:, i]) for i in range(before.shape[1])), pa.array(before[:, -1] >= chain.threshold)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *new], [*names, *(f"p_{c}" for c in chain.models), "flagged"])

    return run


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with p_<category> for every category, and flagged: the last one reaches the threshold.

    A null text is scored as an empty one.  Rows are judged one by one, repeated rows alike; columns with the names of the new ones are replaced,
    all others stay.  An empty table gives an empty table.
    """
    added = [f"p_{c}" for c in chain.models]
    names = others(docs, *added, "flagged")
    kept = docs.select(*[col(c) for c in names])
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(_score(chain, text_col, names), ", ".join([schema, *(f"{a} double" for a in added), "flagged boolean"]))
