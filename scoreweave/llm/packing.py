"""Best-fit packing of tokenised documents into fixed-length sequences.

Tokens are counted where the text lies; only (document, piece, length) rows are shuffled.  Bin packing sees nothing but
the histogram of lengths, at most ``max_len`` rows at any corpus size: Martello-Toth dominance fixes sets of
one to three lengths that provably belong to an optimal packing, as often as both counts allow, and best-fit
decreasing packs the rest.  The plan is a list of patterns with multiplicities; every
piece finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, settle, texts, words

END = b"\x00\x00\x00\x00"  # id 0 closes a document
CACHED_WORDS = 400_000  # words remembered in a Python worker, twice; others are coded again
MARKS = b".,;:!?#$%&*"
DOCUMENTS = 500  # documents whose words are held at once
SHARE = 250  # pieces of one length that are numbered together


def _reduce(count: dict[int, int], cap: int) -> list[tuple[tuple[int, ...], int]]:
    """Take provably dominating sets out of ``count`` (length -> how many); returns (lengths, times)."""
    fixed: list[tuple[tuple[int, ...], int]] = []
    present = sorted(count)

    def fix(*lengths: int) -> None:
        need = Counter(lengths)
        times = min(count[x] // n for x, n in need.items())
        for x, n in need.items():
            count[x] -= n * times
            if not count[x]:
                present.remove(x)
                del count[x]
        fixed.append((lengths, times))

    def smallest(n: int, but: int) -> list[int]:
        """The n smallest items left when one item of length ``but`` is taken away."""
        out: list[int] = []
        for x in present:
            out += [x] * min(n, count[x] - (x == but))
            if len(out) >= n:
                break
        return out[:n]

    def largest(limit: int, *without: int) -> int:
        """The largest item of at most ``limit`` besides those taken away; 0 if there is none."""
        i = bisect_right(present, limit) - 1
        while i >= 0 and count[present[i]] <= without.count(present[i]):
            i -= 1
        return present[i] if i >= 0 else 0

    changed = True
    while changed:
        changed = False
        for x in sorted(present, reverse=True):
            while x in count:
                room, small = cap - x, smallest(3, x)
                best = largest(room, x)
                if not best:  # nothing fits beside it
                    fix(x)
                elif best == room or x + sum(small[:2]) > cap or len(small) < 2:  # a full pair, or one partner at most
                    fix(x, best)
                elif x + sum(small) > cap or len(small) < 3:  # two partners at most
                    second = largest(room - best, x, best)
                    half = largest(room // 2, x)  # no second partner is longer than this
                    if not second and _pair(present, count, room, x) <= best:
                        fix(x, best)
                    elif second and second >= half:
                        fix(x, best, second)
                    else:
                        break
                else:
                    break
                changed = True
    return fixed


def _pair(present: list[int], count: dict[int, int], room: int, x: int) -> int:
    """The largest sum of two items within ``room`` when one ``x`` is taken away."""
    best, lo, hi = 0, 0, len(present) - 1
    while lo <= hi:
        a, b = present[lo], present[hi]
        if a + b > room or count[b] <= (b == x):
            hi -= 1
        else:
            best = max(best, a + b) if count[a] - (a == x) >= (2 if a == b else 1) else best
            lo += 1
    return best


def _best_fit(count: dict[int, int], cap: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counted lengths: equal bins are filled together."""
    open_bins: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], times: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append([lengths, times])

    for x in sorted(count, reverse=True):
        left = count[x]
        while left:
            i = bisect_left(rooms, x)
            room = rooms[i] if i < len(rooms) else cap
            each = min(room // x, left)
            if i < len(rooms):
                lengths, have = open_bins[room][-1]
                times = min(have, left // each)
                open_bins[room][-1][1] -= times
                if not open_bins[room][-1][1]:
                    open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(i)
            else:
                lengths, times = (), left // each
            put(room - each * x, lengths + (x,) * each, times)
            left -= times * each
    return [(tuple(p), t) for groups in open_bins.values() for p, t in groups]


def plan(count: dict[int, int], cap: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence) with their numbers of sequences for a histogram of lengths."""
    left = {x: n for x, n in count.items() if n}
    if any(x < 1 or x > cap for x in left):
        raise ValueError(f"lengths must lie in 1..{cap}")
    return [*_reduce(left, cap), *_best_fit(left, cap)]


def _places(patterns: list[tuple[tuple[int, ...], int]], count: dict[int, int]) -> tuple[dict[int, int], np.ndarray]:
    """Where ranks lie: first rank of each length, and rows (first rank, first sequence, items a sequence, offset, length)."""
    first, total = {}, 0
    for x in sorted(count):
        first[x], total = total, total + count[x]
    used, rows, sequence = dict(first), [], 0
    for lengths, times in patterns:
        offset = 0
        for x, each in sorted(Counter(lengths).items(), reverse=True):
            rows.append((used[x], sequence, each, offset, x))
            used[x] += each * times
            offset += each * x
        sequence += times
    return first, np.array(sorted(rows), np.int64).reshape(-1, 5)


_own = [*range(33, 127), *range(161, 173), *range(174, 256)]
_other = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _own)}  # bytes that a byte-level model does not write as themselves
LETTERS = {chr(c): "".join(chr(_other.get(b, b)) for b in chr(c).encode()) for c in range(0x250)}
LATIN = "\u0250"  # below it composing and lower case are the same in every Unicode version
PROBES = (b"word", "na\u00efvet\u00e9".encode(), "\u0142\u00e0n".encode(), "ouanqu\u00ea\u00ff".encode())


def _letters(word: str) -> str | None:
    """The word as the tokenizer sees it, if that is letters only: composed and lower-cased, some letters end in a mark that would join the marks behind."""
    if not word.isalpha():
        return None
    seen = unicodedata.normalize("NFC", word).lower()
    return seen if seen.isalpha() else None


def _byte_level(seen: str) -> str:
    """A Latin word in the letters of a byte-level model."""
    return seen if seen.isascii() else "".join([LETTERS[c] for c in seen])


class _WordIds:
    """Ids of words as little-endian bytes, remembered while they are in use.

    The tokenizer sees letters and marks apart and ignores the case of ASCII letters, so a word of letters with closing marks
    is the ids of both.  Latin letters go to the tokenizer's model at once, where this gives what the whole tokenizer does;
    all else goes through its normaliser and splitter."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(tokenizer)
        self.model = self.coder.model
        self.ids: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self._code(set(PROBES))
        self.direct = all(self._model_ids(_byte_level(w.decode())) == self.ids[w] for w in PROBES)

    def _model_ids(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _code(self, wanted: set[bytes]) -> None:
        """Ids of ``wanted`` as they are."""
        fresh = []
        for w in wanted:
            if w not in self.ids:
                if w in self.older:
                    self.ids[w] = self.older[w]
                else:
                    fresh.append(w)
        for w, e in zip(fresh, self.coder.encode_batch([w.decode() for w in fresh], add_special_tokens=False)):
            self.ids[w] = np.array(e.ids, "<u4").tobytes()

    def learn(self, wanted: set[bytes]) -> dict[bytes, bytes]:
        """A dictionary that has the ids of all ``wanted``."""
        if len(self.ids) > CACHED_WORDS:
            self.older, self.ids = self.ids, {}
        whole, split = set(), {}
        for w in wanted:
            if w in self.ids:
                continue
            if w in self.older:
                self.ids[w] = self.older[w]
                continue
            core = w.lower().rstrip(MARKS)  # bytes: A-Z only
            seen = core.decode() if core.isalpha() else _letters(core.decode())
            if seen is None:
                whole.add(w)
                continue
            if self.direct and core not in self.ids and (seen.isascii() or max(seen) < LATIN):
                self.ids[core] = self.older[core] if core in self.older else self._model_ids(_byte_level(seen))
            if core != w:
                split[w] = (core, w[len(core) :])
            elif w not in self.ids:
                whole.add(w)
        self._code(whole | {p for parts in split.values() for p in parts if p})
        for w, (core, marks) in split.items():
            self.ids[w] = self.ids[core] + (self.ids[marks] if marks else b"")
        return self.ids


def _pieces(tokenizer: str, max_len: int, keep_ids: bool):
    def run(batches):
        coder = _WordIds(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, DOCUMENTS):
                b = whole.slice(at, DOCUMENTS)
                out: tuple[list, ...] = ([], [], [], [], [], [])
                parts = [words(t) for t in texts(b.column("_text"))]
                known = coder.learn({w for p in parts for w in p})
                for doc, p in zip(b.column("_id").to_pylist(), parts):
                    ids = b"".join([known[w] for w in p]) + END
                    for k, start in enumerate(range(0, len(ids), 4 * max_len)):
                        own = ids[start : start + 4 * max_len]
                        for c, v in zip(out, (doc, k, start // 4, len(own) // 4, zlib.crc32(own), own if keep_ids else None)):
                            c.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return run


def _seat(rows: np.ndarray):
    """Sequence and offset of every rank."""

    def run(batches):
        for b in batches:
            rank = b.column("_rank").to_numpy()
            own = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
            at = rank - own[:, 0]
            new = [pa.array(own[:, 1] + at // own[:, 2]), pa.array(own[:, 3] + at % own[:, 2] * own[:, 4])]
            keep = [n for n in b.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), *new], [*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = 2048, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-endian, on request).

    A document is its token ids and a closing 0, so a null or empty text is one id; only longer ones than
    ``max_len`` are cut.  The tokenizer drops white space and sees no further than a word, so words are coded one by one.
    Repeated rows are packed as often as they come; a null id stays null; other columns are ignored;
    an empty table gives an empty table.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    cut = docs.select(col(id_col).cast("long").alias("_id"), col(text_col).cast("string").alias("_text"))
    cut = cut.mapInArrow(_pieces(tokenizer, max_len, keep_ids), schema)
    cut = settle(cut if keep_ids else cut.drop("ids"))
    count = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most max_len rows
    first, rows = _places(plan(count, max_len), count)
    sizes = cut.sparkSession.createDataFrame([(x, first[x], -(-n // SHARE)) for x, n in count.items()], "length long, _first long, _shares long")
    ident = [F.coalesce("doc_id", F.lit(0)), "piece", "ids_crc32"]
    dealt = cut.join(F.broadcast(sizes), "length").withColumn("_share", F.pmod(F.xxhash64(*ident), F.col("_shares")))
    each = dealt.groupBy("length", "_share").agg(F.count(F.lit(1)).alias("_n"), F.first("_first").alias("_first"))
    before = Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("length", "_share", (F.col("_first") + F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_before"))
    numbered = dealt.join(each, ["length", "_share"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(Window.partitionBy("length", "_share").orderBy(*ident)) - 1
    )
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    kinds = {"piece": "int", "ids": "binary"}
    out = ", ".join(f"{c} {kinds.get(c, 'long')}" for c in keep) + ", sequence_id long, offset long"
    return numbered.select(*keep, "_rank").mapInArrow(_seat(rows), out)
