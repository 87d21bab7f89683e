"""Periodic runs of words in whole texts, and texts with the repeats of every run collapsed.

A run is a stretch of words with smallest period q that is long enough and extends no further.  Candidates lie on a harmonic grid:
for every period p the places 0, p, 2p, ... .  A run of three periods holds three neighbouring grid places, so a candidate whose
words a period apart differ is no run.  What is left is extended exactly by longest common extensions (LCE) of the two places to both sides.

Extensions are asked of a run-length grammar made by recompression: rounds of block compression (a symbol repeated in
a row becomes one) and pair compression (every symbol takes a side, a left one and the right one after it become one).  Equal stretches are
cut alike but for their ends, so an extension takes few steps a round, climbing to longer symbols and down again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, mix, others, texts, words

TABLE = 4096  # words up to which a text's grid comes from a table; longer texts walk the periods
TOGETHER = 1 << 18  # words of the texts searched together (or one longer text), and candidates extended together
ADDED = ("n_runs", "runs", "best")
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Grammar:
    """Recompression of a sequence of symbols; ``right`` and ``left`` give common extensions of places."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.rounds = []  # (starts, symbols, equal symbols from here on, equal symbols up to here, length of the symbol)
        n = len(symbols)
        start, sym = np.arange(n, dtype=np.int64), symbols.astype(np.int64)
        self.top = np.zeros(n + 1, np.int8)  # last round in which a place is a border
        while True:
            ends = np.append(start[1:], n)
            change = np.flatnonzero(np.append(True, sym[1:] != sym[:-1]))  # first of every block
            count = np.diff(np.append(change, len(sym)))
            within = np.arange(len(sym)) - np.repeat(change, count)
            self.rounds.append(tuple(x.astype(np.int32) for x in (start, sym, np.repeat(count, count) - within, within + 1, ends - start)))
            if len(change) <= 1 or len(self.rounds) >= 100 or (ends - start).min() > longest:
                break
            # a block is named by symbol and count, a pair by its two blocks
            named = np.unique(sym[change] * (int(count.max()) + 1) + count, return_inverse=True)[1]
            side = (mix(named.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(self.rounds))) & np.uint64(1)).astype(bool)
            ahead, back = ~side[:-1] & side[1:], side[:-1] & ~side[1:]
            pair = ahead if ahead.sum() >= back.sum() else back
            joined = np.append(False, pair)  # second of a pair: no border
            first = np.flatnonzero(~joined)
            second = np.where(np.append(pair, False)[first], np.append(named, -1)[first + 1], -1)
            start = start[change][first]
            sym = np.unique(named[first] * (int(named.max()) + 2) + second + 1, return_inverse=True)[1]
            self.top[start] = len(self.rounds)
        self.top[n] = len(self.rounds) - 1

    def _extend(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """Common words after (or before) the borders a < b of every pair."""
        n = len(self.top) - 1
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(b < n) if forward else np.flatnonzero(a > 0)
        level = np.minimum(self.top[a[live]], self.top[b[live]]).astype(np.int64)
        sign = 1 if forward else -1
        while len(live):
            x, y = a[live] + sign * out[live], b[live] + sign * out[live]
            step = np.zeros(len(live), np.int64)
            for t in np.unique(level):
                start, sym, rest, past, long = self.rounds[t]
                here = np.flatnonzero(level == t)
                i, j = np.searchsorted(start, x[here]), np.searchsorted(start, y[here])
                if not forward:
                    i, j = i - 1, j - 1
                run = rest if forward else past
                step[here] = np.where(sym[i] == sym[j], np.minimum(run[i], run[j]) * long[i].astype(np.int64), 0)
            out[live] += step
            moved = step > 0
            x, y = x + sign * step, y + sign * step
            inside = (y < n) if forward else (x > 0)
            level = np.where(moved, np.minimum(self.top[np.minimum(x, n)], self.top[np.minimum(y, n)]), level - 1)
            go = np.where(moved, inside, level >= 0)
            live, level = live[go], level[go]
        return out

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._extend(a, b, True)

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._extend(a, b, False)


@lru_cache(1)
def _grid(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(third place, place, period) of all grid places below ``n``, by third place."""
    parts = [(np.arange(0, n - 2 * p, p), p) for p in range(1, (n - 1) // 2 + 1)]
    place = np.concatenate([a for a, _ in parts])
    period = np.repeat(np.array([p for _, p in parts]), [len(a) for a, _ in parts])
    third = place + 2 * period
    order = np.argsort(third, kind="stable")
    return third[order], place[order], period[order]


def _fits(w: np.ndarray, i: np.ndarray, p) -> np.ndarray:
    """Words between the first two grid places of a run equal those a period later; four of them are compared."""
    at = i[w[i] == w[i + p]] if np.isscalar(p) else None
    if at is not None:
        at = at[w[at + p] == w[at + 2 * p]]
        at = at[w[at + 1] == w[at + 1 + p]]
        return at[w[at + p // 2] == w[at + p // 2 + p]]
    keep = np.flatnonzero(w[i] == w[i + p])
    for d in (p, np.ones_like(p), p // 2):
        x = i[keep] + d[keep]
        keep = keep[w[x] == w[x + p[keep]]]
    return keep


def _stretches(docs: list[np.ndarray], asked: list[tuple], least: int, periods: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches (start, end, period) around the candidates (places, periods) of every text that are long enough, and their texts."""
    starts = np.cumsum([0, *[len(d) + 1 for d in docs]])
    names = max(int(d.max(initial=0)) for d in docs) + 1
    closed = [part for k, d in enumerate(docs) for part in (d, [names + k])]  # extensions end at a text's closing symbol
    grammar = Grammar(np.concatenate(closed), max(map(len, docs)))
    place = np.concatenate([i + s for (i, _), s in zip(asked, starts)])
    period = np.concatenate([p for _, p in asked])
    found = []
    for k in range(0, len(place), TOGETHER):
        i, p = place[k : k + TOGETHER], period[k : k + TOGETHER]
        start, end = i - grammar.left(i, i + p), i + p + grammar.right(i, i + p)
        long = end - start >= np.maximum(least, periods * p)
        found.append(np.unique(np.stack([start[long], end[long], p[long]], 1), axis=0))
    rows = np.unique(np.concatenate(found), axis=0)
    which = np.searchsorted(starts, rows[:, 0], "right") - 1
    rows[:, :2] -= starts[which][:, None]
    return rows, which


def _walk(d: np.ndarray, least: int, periods: int) -> np.ndarray:
    """Stretches of a long text, period by period; candidates within a run of a divisor of their period give it again and are left out."""
    got, held, size = np.zeros((0, 3), np.int64), [], 0
    grammar = []
    for p in range(1, len(d) // periods + 1):
        at = _fits(d, np.arange(0, len(d) - 2 * p, p), p)
        known = got[p % got[:, 2] == 0] if len(at) else got[:0]
        if len(known):
            known = known[np.argsort(known[:, 0], kind="stable")]
            reach = np.maximum.accumulate(known[:, 1])
            k = np.searchsorted(known[:, 0], at, "right") - 1
            at = at[(k < 0) | (reach[np.maximum(k, 0)] < at + 2 * p)]
        if len(at):
            held.append((at, np.full(len(at), p)))
            size += len(at)
        if held and (size >= TOGETHER or p < 32 or p == len(d) // periods):
            i, q = map(np.concatenate, zip(*held))
            grammar = grammar or [Grammar(d, len(d))]
            start, end = i - grammar[0].left(i, i + q), i + q + grammar[0].right(i, i + q)
            long = end - start >= np.maximum(least, periods * q)
            got = np.unique(np.concatenate([got, np.stack([start[long], end[long], q[long]], 1)]), axis=0)
            held, size = [], 0
    return got


def runs_of(docs: list[np.ndarray], least: int = 24, periods: int = 3) -> list[np.ndarray]:
    """Runs of every sequence of word numbers: rows (start, length, period) by start, then period."""
    third, place, period = _grid(TABLE)
    found = [np.zeros((0, 3), np.int64) for _ in docs]
    some, asked = [], []
    for k, d in enumerate(docs):
        if len(d) > TABLE:
            found[k] = _walk(d, least, periods)
        elif len(d) >= least:
            upto = int(np.searchsorted(third, len(d)))
            keep = _fits(d, place[:upto], period[:upto])
            if len(keep):
                some.append(k)
                asked.append((place[keep], period[keep]))
    if some:
        rows, which = _stretches([docs[k] for k in some], asked, least, periods)
        for j, k in enumerate(some):
            found[k] = rows[which == j]
    for k, rows in enumerate(found):
        if len(rows):  # of one stretch the smallest period
            rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))]
            rows = np.stack([rows[:, 0], rows[:, 1] - rows[:, 0], rows[:, 2]], 1)
            found[k] = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return found


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, ties to the smaller start, then period."""
    if not len(runs):
        return None
    return min(((int(a), int(b), int(c)) for a, b, c in runs), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those in no run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:n] == 0


def _numbers(parts: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in parts), np.int64, len(parts))


def _batch(least: int, periods: int, id_col: str, text_col: str, names: list[str], types: pa.Schema, edit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [words(t) for t in texts(b.column(text_col))]
            if edit is not None:
                parts = [edit(i, p) for i, p in zip(b.column(id_col).to_pylist(), parts)]
            found: list[np.ndarray] = []
            group: list[np.ndarray] = []
            for k, p in enumerate(parts):
                group.append(_numbers(p))
                if k + 1 == len(parts) or sum(map(len, group)) + len(parts[k + 1]) > TOGETHER:
                    found += runs_of(group, least, periods)
                    group = []
            left = [b" ".join(p if not len(r) else [p[i] for i in np.flatnonzero(kept(len(p), r))]).decode() for p, r in zip(parts, found)]
            listed = [[{"start": a, "length": c, "period": q} for a, c, q in r.tolist()] for r in found]
            tops = [t and dict(zip(("start", "length", "period"), t)) for t in map(strongest, found)]
            new = {text_col: left, "n_runs": [len(r) for r in found], "runs": listed, "best": tops}
            yield pa.RecordBatch.from_arrays([pa.array(new[n], types.field(n).type) if n in new else b.column(n) for n in names], names)

    return run


def collapse_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, periods: int = 3, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """Every row of ``docs`` with its text's words joined by one space, without the repeats of its runs, and n_runs, runs, best.

    A run has at least ``least`` words and ``periods`` periods; the words after its first period go.  ``runs`` holds (start, length, period)
    by start, then period, places counted in words of the whole text; ``best`` is the run with the most periods, null without a run.
    ``edit`` may change the words of a text first; it is given the row's id.  A null or empty text has no words and
    comes back empty.  Ids may be null or of any type, repeated rows are judged one by one; columns named n_runs, runs, best are replaced,
    all others stay.  An empty table gives an empty table.
    """
    rest = others(docs, *ADDED)
    names = [*rest, *ADDED]
    base = docs.select(*[col(c).cast("string").alias(c) if c.lower() == text_col.lower() else col(c) for c in rest])
    types = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    text_col = next(c for c in rest if c.lower() == text_col.lower())
    id_col = next((c for c in rest if c.lower() == id_col.lower()), id_col)
    types |= {"n_runs": "bigint", "runs": f"array<{RUN}>", "best": RUN}
    schema = ", ".join(f"`{n.replace('`', '``')}` {types[n]}" for n in names)
    one = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
    arrow = pa.schema([(text_col, pa.string()), ("n_runs", pa.int64()), ("runs", pa.list_(one)), ("best", one)])
    return base.mapInArrow(_batch(least, periods, id_col, text_col, names, arrow, edit), schema)


def listed(runs: str) -> Column:
    """``start,length,period`` and a line feed for every run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
