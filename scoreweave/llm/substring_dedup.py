"""Passages of 20 or more words that repeat anywhere in the corpus are removed but for their first occurrence.

Suffixes of all documents are split by prefixes into groups that fit a task, and the tree of each group shows what repeats.

* Suffixes are sampled: in every window the five-word prefix with the smallest hash (its minimizer) is the one by
  which the window is dealt.  Equal windows have equal minimizers, so all copies of a window meet in the group of that prefix, and
  neighbouring windows with one minimizer travel together as one suffix with the words they cover.
* Prefixes that occur once in the corpus head no repeat and go no further.
* Prefixes have variable length: one that holds over 1 / HOT_SHARE of all sampled suffixes is too large for a group, so
  its windows are dealt one by one under the longest prefix they have, the whole window.  There are at most HOT_SHARE such prefixes.
* The tree of a group is built down to the window length by naming: prefixes of 1, 2, 4, 8, 16 words get the same name if and
  only if their words are equal.  Names are the nodes of the tree; nodes at the window length with several
  leaves are its deep internal nodes, the maximal repeats.  All leaves but the earliest are repeats.
* Copies are combined where the texts lie: of equal suffixes in one batch only the earliest is dealt, so a passage in a
  third of all documents reaches its group once per batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, col, gram_hashes, id_key, others, settle, texts, word_hashes, words

WINDOW = 20
PREFIX = 5
GROUP_BYTES = 4 << 20  # bytes of corpus text for one group of prefixes
HOT_SHARE = 4096
TOGETHER = 5000  # documents whose equal suffixes are combined before they are dealt
SUFFIX_BYTES = 50  # bytes of text for one sampled suffix, about


def minimizers(hashes: np.ndarray, window: int = WINDOW, prefix: int = PREFIX) -> np.ndarray:
    """For every window, the position of its leftmost prefix with the smallest hash."""
    g = gram_hashes(hashes, prefix)
    span = window - prefix + 1
    n = len(g) - span + 1
    if n < 1:
        return np.empty(0, np.int64)
    best = np.arange(len(g))
    width = 1
    while width < span:  # smallest over doubling widths; the last step overlaps
        step = min(width, span - width)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(g[b] < g[a], b, a)
        width += step
    return best[:n]


def runs(text: bytes, window: int, prefix: int):
    """Words of a text and its runs of windows with one minimizer: (words, prefix hash, first window, number of windows)."""
    w = words(text)
    h = word_hashes(w)
    at = minimizers(h, window, prefix)
    if not len(at):
        return w, np.empty(0, np.uint64), at, at
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return w, gram_hashes(h, prefix)[at[first]], first, np.diff(np.append(first, len(at)))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h * STEP) >> np.uint64(33)).astype(np.int64) % buckets


def _batch_rows(kinds, names, rows):
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)


def _deal_prefixes(buckets: int, window: int, prefix: int):
    """Rows of packed arrays (bucket, hash, key, tag, first).

    Per bucket the prefixes that occur once in the batch, with their places, and one entry for each that occurs more often, with
    minus its count for a place.  The places of the latter repeat already: they are passed on by document, without hashes."""
    names, kinds = ["bucket", "hash", "key", "tag", "first"], (pa.int64(), *[pa.binary()] * 4)

    def run(batches):
        for b in batches:
            ids, tags = (np.array(b.column(c).to_pylist(), np.int64) for c in ("_key", "_tag"))
            found = [runs(t, window, prefix)[1:3] for t in texts(b.column("_text"))]
            size = [len(h) for h, _ in found]
            if not sum(size):
                continue
            h, first = (np.concatenate([f[i] for f in found]).astype(t) for i, t in ((0, np.uint64), (1, np.int32)))
            doc = np.repeat(np.arange(len(size)), size)
            _, lead, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            known = np.flatnonzero(count[inverse] > 1)
            edge = np.flatnonzero(np.append(True, np.diff(doc[known]) > 0)) if len(known) else []
            rows = []
            for at in np.split(known, edge[1:]) if len(known) else []:
                d = doc[at[:1]]
                rows.append((int(ids[d[0]] % buckets), b"", ids[d].tobytes(), tags[d].tobytes(), first[at].tobytes()))
            lead = lead[np.argsort(_bucket(h[lead], buckets), kind="stable")]
            place, where = _bucket(h[lead], buckets), np.where(count[inverse[lead]] > 1, -count[inverse[lead]], first[lead]).astype(np.int32)
            edge = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            for at, w in zip(np.split(lead, edge[1:]), np.split(where, edge[1:])):
                rows.append((int(_bucket(h[at[:1]], buckets)[0]), h[at].tobytes(), ids[doc[at]].tobytes(), tags[doc[at]].tobytes(), w.tobytes()))
            yield _batch_rows(kinds, names, rows)

    return run


def _repeated(hot: int):
    """Documents of a bucket with the first windows of the runs whose prefix occurs more than once; prefixes with more
    than ``hot`` occurrences (_hot, in rows without a document)."""

    def run(t: pa.Table) -> pa.Table:
        packed = [[np.frombuffer(x, d) for x in t.column(c).to_pylist()] for c, d in (("hash", np.uint64), ("key", np.int64), ("tag", np.int64), ("first", np.int32))]
        keys, tags, firsts, heavy = [], [], [], []
        dealt = [i for i, h in enumerate(packed[0]) if len(h)]
        for i, h in enumerate(packed[0]):
            if not len(h):
                keys.append(int(packed[1][i][0]))
                tags.append(int(packed[2][i][0]))
                firsts.append(packed[3][i].tolist())
        if dealt:
            h, key, tag, first = (np.concatenate([p[i] for i in dealt]) for p in packed)
            _, inverse = np.unique(h, return_inverse=True)
            count = np.bincount(inverse, np.where(first < 0, -first, 1))
            heavy = np.unique(h[count[inverse] > hot]).astype(np.int64).tolist()
            again = np.flatnonzero((count[inverse] > 1) & (first >= 0))
            again = again[np.lexsort((first[again], tag[again], key[again]))]
            if len(again):
                k, g, f = key[again], tag[again], first[again]
                edge = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (g[1:] != g[:-1])))
                keys += k[edge].tolist()
                tags += g[edge].tolist()
                firsts += [x.tolist() for x in np.split(f, edge[1:])]
        none = [None] * len(heavy)
        return pa.table({
            "_key": pa.array([*keys, *none], pa.int64()), "_tag": pa.array([*tags, *none], pa.int64()),
            "_first": pa.array([*firsts, *none], pa.list_(pa.int32())), "_hot": pa.array([*[None] * len(keys), *heavy], pa.int64()),
        })

    return run


def _deal_suffixes(buckets: int, window: int, prefix: int, hot: np.ndarray, text_col: str):
    """(bucket, _key, _tag, start, n, words): windows that may repeat, n to a suffix, with the words they cover.

    Of equal suffixes in a batch the earliest is dealt; later ones are repeats and are passed on without words."""
    names, kinds = ["bucket", "_key", "_tag", "start", "n", "words"], (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())

    def suffixes(text: bytes, firsts: list):
        w, h, first, n = runs(text, window, prefix)
        use = np.isin(first, np.concatenate([np.asarray(f, np.int64) for f in firsts]))
        for value, big, f, k in zip(h[use], np.isin(h[use], hot), first[use].tolist(), n[use].tolist()):
            if not big:
                yield int(_bucket(value[None], buckets)[0]), f, k, b" ".join(w[f : f + k + window - 1])
                continue
            for at in range(f, f + k):  # the whole window as a longer prefix
                content = w[at : at + window]
                yield int(_bucket(gram_hashes(word_hashes(content), window), buckets)[0]), at, 1, b" ".join(content)

    def run(batches):
        for b in (whole.slice(at, TOGETHER) for whole in batches for at in range(0, whole.num_rows, TOGETHER)):
            earliest: dict[tuple, list] = {}
            rows = []
            for key, tag, t, firsts in zip(*(b.column(c).to_pylist() for c in ("_key", "_tag")), texts(b.column(text_col)), b.column("_firsts").to_pylist()):
                for bucket, start, n, content in suffixes(t, firsts) if firsts else ():
                    own = (key, start, tag, n)
                    old = earliest.get((bucket, content))
                    if old is None or own[:2] < old[0][:2]:
                        rows += [(k % buckets, k, g, s, m, None) for k, s, g, m in old or ()]
                        earliest[bucket, content] = [own]
                    elif own[:2] == old[0][:2]:  # rows with one id and one text: the same place
                        old.append(own)
                    else:
                        rows.append((key % buckets, key, tag, start, n, None))
            rows += [(bucket, k, g, s, m, content.decode()) for (bucket, content), owners in earliest.items() for k, s, g, m in owners]
            yield _batch_rows(kinds, names, rows)

    return run


def names_of(ids: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of all runs of ``depth`` ids, equal if and only if the runs are: tree nodes at this depth, found by doubling."""
    name, size = ids, 1
    while size < depth:
        step = min(size, depth - size)
        after = np.append(name[step:], np.zeros(min(step, len(name)), name.dtype))
        pair = name.astype(np.uint64) * np.uint64(int(name.max(initial=0)) + 1) + after.astype(np.uint64)
        name = np.unique(pair, return_inverse=True)[1]
        size += step
    return name


def deep_nodes(runs_of: list[bytes], key: np.ndarray, start: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """For all windows of the runs in turn: whether an equal window starts earlier (smaller key, then smaller start)."""
    split = [r.split() for r in runs_of]
    ids = pa.array([w for r in split for w in r], pa.binary()).dictionary_encode().indices.to_numpy()
    size = np.array([len(r) for r in split], np.int64)
    own = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    node = names_of(ids, window)[(np.cumsum(size) - size)[own] + within]
    k, s = key[own], start[own] + within
    order = np.lexsort((s, k, node))
    lead = np.flatnonzero(np.append(True, np.diff(node[order]) != 0))
    first = order[np.repeat(lead, np.diff(np.append(lead, len(order))))]
    later = np.empty(len(own), bool)
    later[order] = (k[order] != k[first]) | (s[order] != s[first])
    return later


def _subtree(window: int):
    """Repeated windows of a group as (_key, _tag, starts, lengths) of stretches."""

    def run(t: pa.Table) -> pa.Table:
        key, tag, start, n = (t.column(c).to_numpy().astype(np.int64) for c in ("_key", "_tag", "start", "n"))
        dealt = t.column("words").is_valid().to_numpy()
        at = np.flatnonzero(dealt)
        found = [(key[~dealt], tag[~dealt], start[~dealt], n[~dealt])]
        if len(at):
            later = deep_nodes(t.column("words").take(pa.array(at)).cast(pa.binary()).to_pylist(), key[at], start[at], n[at], window)
            own = np.repeat(np.arange(len(at)), n[at])
            within = np.arange(len(own)) - np.repeat(np.cumsum(n[at]) - n[at], n[at])
            own, within = own[later], within[later]
            edge = np.flatnonzero(np.append(True, (np.diff(own) != 0) | (np.diff(within) != 1))) if len(own) else np.empty(0, np.int64)
            size, o = np.diff(np.append(edge, len(own))), at[own[edge]]
            found.append((key[o], tag[o], start[o] + within[edge], size))
        key, tag, start, n = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((start, tag, key))
        key, tag, start, n = key[order], tag[order], start[order], n[order]
        edge = np.flatnonzero(np.append(True, (np.diff(key) != 0) | (np.diff(tag) != 0))) if len(key) else np.empty(0, np.int64)
        lists = [[x.tolist() for x in np.split(c, edge[1:])] if len(key) else [] for c in (start, n)]
        kinds = pa.list_(pa.int32())
        return pa.table({"_key": pa.array(key[edge]), "_tag": pa.array(tag[edge]), "_start": pa.array(lists[0], kinds), "_n": pa.array(lists[1], kinds)})

    return run


def _cut(window: int, text_col: str, names: list[str]):
    """Texts without the words that repeated windows cover."""

    def run(batches):
        for b in batches:
            kept, n_words, n_removed = [], [], []
            for t, starts, sizes in zip(texts(b.column(text_col)), b.column("_starts").to_pylist(), b.column("_sizes").to_pylist()):
                w = words(t)
                gone = np.zeros(len(w) + 1, np.int64)
                for s, n in zip(starts or (), sizes or ()):
                    s, n = np.asarray(s), np.asarray(n)
                    np.add.at(gone, s, 1)
                    np.add.at(gone, s + n - 1 + window, -1)
                left = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                kept.append(b" ".join([w[i] for i in left.tolist()] if len(left) < len(w) else w).decode())
                n_words.append(len(w))
                n_removed.append(len(w) - len(left))
            new = {text_col: pa.array(kept, pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else b.column(n) for n in names], names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with words of repeated windows removed from the texts (kept words joined by one space), n_words and n_removed.

    Words are runs without [\\x20\\x09-\\x0D].  A word goes if a window that covers it starts earlier too: in a smaller id, or in the same
    document before.  Windows are judged on the input.  A null or empty text has no words and comes back empty; a text shorter than a window stays
    (white space joined).  A null id is smaller than all others.  Rows with one id are one document: equal starts in them
    are the same place, so repeated rows keep the same words.  Columns named n_words or n_removed are replaced, all
    others stay.  An empty table gives an empty table.
    """
    if window < PREFIX + 1:
        raise ValueError(f"windows of more than {PREFIX} words")
    rest = others(docs, "n_words", "n_removed", "_key", "_tag", "_firsts", "_starts", "_sizes")
    text = col(text_col).cast("string")
    place = [id_key(id_col).alias("_key"), F.xxhash64(text).alias("_tag")]  # rows with one id may hold different texts
    plain = docs.select(*place, text.alias("_text"))
    size = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(16, -(-size // GROUP_BYTES))
    schema = "bucket long, hash binary, key binary, tag binary, first binary"
    marks = plain.mapInArrow(_deal_prefixes(buckets, window, PREFIX), schema).groupBy("bucket")
    marks = settle(marks.applyInArrow(_repeated(max(1000, size // SUFFIX_BYTES // HOT_SHARE)), "_key long, _tag long, _first array<int>, _hot long"))
    hot = marks.where("_hot is not null").select("_hot").distinct().collect()  # a share of all: at most about HOT_SHARE
    hot = np.array([r["_hot"] for r in hot], np.int64).astype(np.uint64)
    marks = marks.where("_hot is null").groupBy("_key", "_tag").agg(F.collect_list("_first").alias("_firsts"))
    base = docs.select(*[col(c) for c in rest], *place)
    schema = "bucket long, _key long, _tag long, start int, n int, words string"
    on = ["_key", "_tag"]
    # all columns go along, so that this join and the last one share one shuffle of the texts
    dealt = base.join(marks, on).mapInArrow(_deal_suffixes(buckets, window, PREFIX, hot, text_col), schema)
    gone = dealt.groupBy("bucket").applyInArrow(_subtree(window), "_key long, _tag long, _start array<int>, _n array<int>")
    gone = gone.groupBy(*on).agg(F.collect_list("_start").alias("_starts"), F.collect_list("_n").alias("_sizes"))
    names = [*rest, "n_words", "n_removed"]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields} | {text_col: "string", "n_words": "bigint", "n_removed": "bigint"}
    out = ", ".join(f"`{n.replace('`', '``')}` {types[n]}" for n in names)
    return base.join(gone, on, "left").drop(*on).mapInArrow(_cut(window, text_col, names), out)
