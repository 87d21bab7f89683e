"""Near-duplicate documents by chosen-path set similarity join.

Documents are sets of five-word shingles.  Equal sets are one class.  In each of several independent trees the classes
are dealt by the minwise token of a randomly chosen hash function.  A node with few members is compared exhaustively; a larger one branches:
its members are dealt again by one or two further functions chosen from the path (one over the
threshold on average, the chosen-path rate), until nodes are small or all their members are known to belong together.
What nodes compare are sketches; every link between different components is then confirmed on the full sets.
Independent trees are repeated to the target recall: the deeper the paths went, the more of them.

Groups of copies do not blow up: equal sets are one class, members of a large node are compared with its
smallest member at once, nodes whose members share one component are closed, a small node gives a forest of its
pairs first; where confirming the forest leaves ends in different components, its members in doubt meet again with their full sets
and the node's task gives a forest of confirmed links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, gram_hashes, id_key, mix, settle, short_shuffles, texts, word_hashes, words
from .components import components

SHINGLE = 5
FUNCTIONS = 128
LEAF, LEAF_MOST = 1024, 2048  # members compared exhaustively: at the roots, doubling with each level up to the second
CHAIN = 8192  # members in doubt that meet once, however many nodes they share
TOGETHER = 2_000_000  # shingles of members that meet in one task with their full sets
SURE = 106  # of FUNCTIONS equal: taken as linked while branching, confirmed in the end
_rng = np.random.Generator(np.random.PCG64(20240607))
FACTORS = _rng.integers(0, 2**64, FUNCTIONS, dtype=np.uint64) | np.uint64(1)
OFFSETS = _rng.integers(0, 2**64, FUNCTIONS, dtype=np.uint64)


START = 2 / 3  # of the pairs at the threshold are taken to stay together on the paths of the first trees


def branch_share(similarity: float) -> float:
    """Share of the nodes that pick two functions: one picked function over the threshold on average."""
    return min(1.0, round(1000 * (1 / similarity - 1)) / 1000)


def kept(similarity: float, depth: int) -> float:
    """Probability that a pair at the threshold is together on some path after ``depth`` times branching."""
    x, q = 1.0, branch_share(similarity)
    for _ in range(depth):
        x = (1 - q) * similarity * x + q * (1 - (1 - similarity * x) ** 2)
    return x


def trees_for(similarity: float, recall: float, share: float = START) -> int:
    """Trees so that a pair at the threshold meets in one of them with probability ``recall``:
    it survives the first function with probability ``similarity``, and branching keeps this share of such pairs."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity * share)))


def shingles(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text with fewer words is one shingle, without words none."""
    w = words(text.lower())  # bytes: A-Z only
    if not w:
        return np.empty(0, np.uint64)
    h = word_hashes(w)
    return np.unique(gram_hashes(h, min(n, len(h))))


def signature(s: np.ndarray) -> np.ndarray:
    """Smallest value of every hash function over the set, as 32 bits."""
    low = np.full(FUNCTIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        low = np.minimum(low, (s[i : i + 2048, None] * FACTORS + OFFSETS).min(0))
    return (mix(low) >> np.uint64(32)).astype("<u4")


def _keys(batches):
    """Id, size of the set, 128-bit key of the set."""
    for b in batches:
        n, key = [], []
        for s in map(shingles, texts(b.column("_text"))):
            n.append(len(s))
            key.append(xxhash.xxh3_128_digest(s.tobytes()))
        yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary())], ["_id", "n", "key"])


def _sets(batches):
    """The same with the signature, for texts with words."""
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for i, t in zip(b.column("_id").to_pylist(), texts(b.column("_text"))):
            s = shingles(t)
            if len(s):
                for c, v in zip(out, (i, len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s).tobytes())):
                    c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["_id", "n", "key", "sig"])


def _sketches(batches):
    """One byte of every function in place of the signature, the last column."""
    for b in batches:
        sketch = [np.frombuffer(x, "<u4").astype(np.uint8).tobytes() for x in b.column("sig").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sketch, pa.binary())], [*b.schema.names[:-1], "sketch"])


def _brief(sets: DataFrame, *more: str) -> DataFrame:
    kept = ["rep", "n", *more]
    return sets.select(*kept, "sig").mapInArrow(_sketches, ", ".join(f"{c} long" for c in kept) + ", sketch binary")


def spanning(pairs: np.ndarray, n: int, sure: int) -> np.ndarray:
    """Of pairs (i, j, same): a forest of those at least ``sure``, made of the most similar ones, and a forest of all others
    over its trees.  Where nothing can be ``sure`` (more than FUNCTIONS), all pairs."""
    if sure > FUNCTIONS:
        return pairs
    i, j, same = pairs = pairs[:, np.argsort(-pairs[2], kind="stable")]
    label, kept = np.arange(n), np.zeros(len(i), bool)
    for part in (same >= sure, same < sure):
        while True:
            cross = np.flatnonzero(part & (label[i] != label[j]))
            if not len(cross):
                break
            _, best = np.unique(np.stack([label[i[cross]], label[j[cross]]], 1).ravel(), return_index=True)
            kept[cross[best // 2]] = True  # the most similar pair of every tree
            x, y = i[kept], j[kept]
            while True:
                low = label.copy()
                np.minimum.at(low, x, label[y])
                np.minimum.at(low, y, label[x])
                low = low[low]
                if (low == label).all():
                    break
                label = low
    return pairs[:, kept]


def _fixed(column: pa.Array) -> np.ndarray:
    """Bytes of a binary column whose values are equally long, one row each."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(column), -1)


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal bytes of every two sketches: eight at a time are added as one number, no byte of which overflows."""
    eights = (a == b).view(np.uint64)
    return ((eights.sum(1, dtype=np.uint64) * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)


def _near(order: np.ndarray, comp: np.ndarray, n: np.ndarray, sk: np.ndarray, rows: range, similarity: float, least: int) -> np.ndarray:
    """(i, j, same): pairs of ``rows`` with later ones of other components, where sizes and sketches allow the similarity."""
    at = slice(rows.start, rows.stop)
    i, j = np.nonzero((order[at, None] < order) & (comp[at, None] != comp) & (np.minimum(n[at, None], n) >= similarity * np.maximum(n[at, None], n) - 1e-9))
    i += rows.start
    same = _equal(sk[i], sk[j])
    return np.stack([i, j, same])[:, same >= least]


def _leaf_pairs(similarity: float, least: int, sure: int):
    """Pairs of a small node from different components whose sizes and sketches allow the similarity: a forest that
    spans them, not each with each.  In a part of a large node: its smallest member with the others."""

    def run(batches):
        for b in batches:
            lists = b.column("members")
            rep, comp, n, sk = lists.flatten().flatten()
            rep, comp, n, sk = rep.to_numpy(), comp.to_numpy(), n.to_numpy(), _fixed(sk)
            ends = np.cumsum(lists.value_lengths().to_numpy())
            found: tuple[list, ...] = ([], [], [])
            for lo, hi, star in zip([0, *ends[:-1]], ends, b.column("star").to_pylist()):
                own = [x[lo:hi] for x in (rep, comp, n, sk)]
                low = int(own[0].argmin())
                blocks = [range(low, low + 1)] if star else [range(k, min(k + 64, hi - lo)) for k in range(0, hi - lo, 64)]  # some rows against all
                pairs = np.empty((3, 0), np.int64)
                for rows in blocks:  # a forest of the pairs so far and the next ones: never all pairs at once
                    more = _near(*own, rows, similarity, least)
                    if more.shape[1]:
                        pairs = spanning(np.concatenate([pairs, more], 1), hi - lo, min(sure, FUNCTIONS))
                i, j, same = pairs
                for c, v in zip(found, (own[0][i], own[0][j], same)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in found], ["a", "b", "same"])

    return run


def _runs(batches, key: str):
    """Tables of rows with equal ``key``, of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and last != k[lo]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(b.slice(lo, hi - lo))
            last = k[lo]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


OPEN = "node long, rep long, comp long, n long, sketch binary, low long"


def _open_members(similarity: float, least: int):
    """Members of a node that may be linked with a member of another component, so that they need their full sets,
    each with the smallest member that a chain of such pairs leads to."""

    def run(batches):
        for b in _runs(batches, "node"):
            own = [b.column(c).to_numpy() for c in ("rep", "comp", "n")] + [_fixed(b.column("sketch"))]
            pairs, asked = np.empty((3, 0), np.int64), np.zeros(b.num_rows, bool)
            for k in range(0, b.num_rows, 64):  # a forest of the pairs holds the same chains
                more = _near(*own, range(k, min(k + 64, b.num_rows)), similarity, least)
                if more.shape[1]:
                    asked[more[:2].ravel()] = True
                    pairs = spanning(np.concatenate([pairs, more], 1), b.num_rows, 0)
            if not asked.any():
                continue
            i, j, _ = pairs
            low, was = own[0].copy(), None
            while was is None or (low != was).any():
                was = low.copy()
                np.minimum.at(low, j, low[i])
                np.minimum.at(low, i, low[j])
            yield b.append_column("low", pa.array(low)).filter(pa.array(asked))

    return run


class _Overlap:
    """Sizes of intersections between the full sets of a node's members."""

    def __init__(self, column: pa.Array):
        self.sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in column]
        self.owner = None

    def _post(self) -> None:
        """Postings: the members that hold a shingle, those of one shingle together."""
        size = [len(s) for s in self.sets]
        every, self.ids = np.unique(np.concatenate(self.sets), return_inverse=True)
        self.from_ = np.concatenate([[0], np.cumsum(size)])
        order = np.argsort(self.ids, kind="stable")
        self.owner = np.repeat(np.arange(len(size), dtype=np.int32), size)[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.ids, minlength=len(every)))])

    def __call__(self, i: int, js: np.ndarray) -> np.ndarray:
        if len(js) <= 8 and self.owner is None:
            return np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for j in js])
        if self.owner is None:
            self._post()
        own = self.ids[self.from_[i] : self.from_[i + 1]]
        start, many = self.first[own], self.first[own + 1] - self.first[own]
        at = np.repeat(start - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        return np.bincount(self.owner[at], minlength=len(self.sets))[js]


def _node_links(similarity: float, least: int, percent: int):
    """(a, b, ca, cb): confirmed links that join the components of a node's members, a forest of them; every pair in doubt is decided on the full sets."""

    def run(batches):
        for b in _runs(batches, "key"):
            rep, comp, n, part = (b.column(c).to_numpy() for c in ("rep", "comp", "n", "part"))
            sk, mixed, both = _fixed(b.column("sketch")), b.column("mixed").to_numpy(zero_copy_only=False), _Overlap(b.column("full"))
            label, size = np.unique(comp, return_inverse=True, return_counts=True)[1:]
            order = np.empty(len(rep), np.int64)
            order[np.lexsort((rep, label, size[label]))] = np.arange(len(rep))  # members of small components ask those of large ones
            links = []
            for k in range(0, len(rep), 64):
                i, j, _ = _near(order, comp, n, sk, range(k, min(k + 64, len(rep))), similarity, least)
                fits = ~(mixed[i] & (part[i] == part[j]))
                i, j = i[fits], j[fits]
                for x in np.unique(i).tolist():
                    js = j[i == x]
                    js = js[label[js] != label[x]]
                    if not len(js):
                        continue
                    shared = both(x, js)
                    for y in js[100 * shared >= percent * (n[x] + n[js] - shared)].tolist():
                        if label[x] != label[y]:
                            links.append((x, y))
                            label[label == label[y]] = label[x]
            if links:
                x, y = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (rep[x], rep[y], comp[x], comp[y])], ["a", "b", "ca", "cb"])

    return run


def _star_pairs(similarity: float, least: int):
    """Members of a node with another member beside them."""

    def run(batches):
        for b in batches:
            n, m = (b.column(c).to_numpy() for c in ("n", "pn"))
            sk, pk = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("sketch", "psketch"))
            same = (sk == pk).sum(1)
            ok = (same >= least) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9)
            cols = (b.column("pivot").to_numpy()[ok], b.column("rep").to_numpy()[ok], same[ok])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "same"])

    return run


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("fa").to_pylist(), b.column("fb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("a", "b", "ca", "cb")), pa.array(ok, pa.bool_())], ["a", "b", "ca", "cb", "ok"])

    return run


def _least(similarity: float) -> int:
    """Equal functions that a pair must show to be confirmed: 4.5 deviations below the threshold."""
    return int(FUNCTIONS * (similarity - 4.5 * math.sqrt(similarity * (1 - similarity) / FUNCTIONS)))


def _candidates(sets: DataFrame, similarity: float, trees: range, sure: int) -> tuple[DataFrame, DataFrame, int]:
    """(a, b, same): pairs of classes found in the trees, whose ends were not known to be linked already (``comp`` of ``sets``, if any);
    the small nodes (node, rep) they were found in; how often the deepest path branched.  A small node gives a forest of its pairs; the others are looked at again (``_second_look``)."""
    least = _least(similarity)
    pairs = "a long, b long, same long"
    token = lambda pos: F.substring("sig", 4 * pos + 1, 4)
    roots = F.explode(F.array(*[F.xxhash64(F.lit(t), F.substring("sig", 4 * (t % FUNCTIONS) + 1, 4)) for t in trees]))
    if "comp" not in sets.columns:
        sets = sets.withColumn("comp", F.col("rep"))
    nodes = sets.select("rep", "comp", roots.alias("node"))
    found: list[DataFrame] = []
    leaves: list[DataFrame] = []
    for level in range(1, FUNCTIONS):
        stats = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("pivot"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        live = settle(nodes.join(stats.where("size > 1 and lo < hi").select("node", "size", "pivot"), "node"))
        limit = min(LEAF_MOST, LEAF << (level - 1))
        small, large = live.where(F.col("size") <= limit), live.where(F.col("size") > limit)
        leaves.append(small.select(F.xxhash64("node", F.lit(level)).alias("node"), "rep"))
        # a large node is met in parts, its smallest member in all of them
        parts = F.ceil(F.col("size") / LEAF_MOST)
        own = F.when(F.col("rep") == F.col("pivot"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), parts)))
        at = F.when(F.col("size") <= limit, F.array("node")).otherwise(F.transform(own, lambda k: F.xxhash64("node", k)))
        meets = live.withColumn("at", F.explode(at)).select("rep", "comp", F.struct("at", (F.col("size") > limit).alias("star")).alias("at"))
        # a class meets its sketch once, with the list of its nodes (one for each path that it is on)
        brief = _brief(sets)
        meets = meets.groupBy("rep").agg(F.min("comp").alias("comp"), F.collect_set("at").alias("at")).join(brief, "rep").withColumn("at", F.explode("at"))
        meets = meets.groupBy("at").agg(F.collect_list(F.struct("rep", "comp", "n", "sketch")).alias("members")).select("members", "at.star")
        fresh = settle(meets.mapInArrow(_leaf_pairs(similarity, least, sure), pairs))
        found.append(fresh)
        if large.isEmpty():
            depth = level - 1
            break
        label = _labels(fresh.where(F.col("same") >= sure), sets)
        # chosen path: every node picks one function, or two, from its own path
        second = F.pmod(F.xxhash64("node", F.lit(level), F.lit(2)), F.lit(1000)) < round(1000 * branch_share(similarity))
        picks = F.when(second, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        pos = F.pmod(F.xxhash64("node", F.lit(level), "pick"), F.lit(FUNCTIONS)).cast("int")
        sets = large.groupBy("rep").agg(F.collect_set("node").alias("nodes")).join(sets.select("rep", "n", "sig"), "rep")  # the rest of the paths needs no others
        sets = settle(sets.join(label, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")))
        nodes = sets.select("rep", "comp", "sig", F.explode("nodes").alias("node")).withColumn("pick", F.explode(picks)).withColumn("pos", pos)
        nodes = nodes.select("rep", "comp", F.xxhash64("node", "pos", token(F.col("pos"))).alias("node"))
    else:  # paths through all functions: what is still together is compared whole
        depth = FUNCTIONS - 1
        left = large.select("node", "rep", "comp").join(brief, "rep")
        other = left.select("node", *[F.col(c).alias("p" + c) for c in ("comp", "n", "sketch")], F.col("rep").alias("pivot"))
        rest = left.join(other, "node").where("rep > pivot and comp <> pcomp").select("rep", "n", "sketch", "pivot", "pn", "psketch")
        found.append(settle(rest.mapInArrow(_star_pairs(similarity, least), pairs).distinct()))
    out, small_nodes = found[0], leaves[0]
    for f in found[1:]:
        out = out.unionByName(f)
    for f in leaves[1:]:
        small_nodes = small_nodes.unionByName(f)
    return out.groupBy("a", "b").agg(F.max("same").alias("same")), small_nodes, depth


def _second_look(leaves: DataFrame, sets: DataFrame, groups: DataFrame, full: DataFrame, similarity: float) -> DataFrame:
    """(node, component): ``groups`` joined by all links in the small nodes that the confirmed forests left out.

    Nodes whose members still lie in different components are compared again by sketches.  Members in doubt meet with their full sets, once if
    the chains of doubtful pairs that hold them span at most ``CHAIN`` members, else in each of their nodes; the task confirms pairs and gives
    a forest of links, so no pair leaves it unconfirmed.  Where more than ``TOGETHER`` shingles meet, they are dealt in parts, every two of which meet."""
    known = leaves.join(groups.select(F.col("node").alias("rep"), F.col("component").alias("comp")), "rep", "left")
    known = known.select("node", "rep", F.coalesce("comp", "rep").alias("comp"))
    torn = known.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("node")
    again = known.join(torn, "node").groupBy("rep").agg(F.min("comp").alias("comp"), F.collect_set("node").alias("nodes")).join(_brief(sets), "rep")
    again = again.select(F.explode("nodes").alias("node"), "rep", "comp", "n", "sketch").repartition("node").sortWithinPartitions("node")
    asked = settle(again.mapInArrow(_open_members(similarity, _least(similarity)), OPEN))
    if asked.isEmpty():
        return groups
    chains = components(asked.select(F.col("rep").alias("a"), F.col("low").alias("b")).where("a <> b").distinct())
    spans = chains.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") <= CHAIN)
    short = chains.join(spans, "component").select(F.col("node").alias("rep"), F.xxhash64("component", F.lit("chain")).alias("chain"))
    asked = asked.join(short, "rep", "left").withColumn("node", F.coalesce("chain", "node"))
    asked = settle(asked.select("node", "rep", "comp", "n", "sketch").dropDuplicates(["node", "rep"]))
    parts = asked.groupBy("node").agg(F.ceil(F.sum("n") / TOGETHER).alias("parts"))
    dealt = asked.join(parts, "node").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = F.xxhash64("node", F.least("part", "with"), F.greatest("part", "with"))
    # two parts that meet leave pairs inside a part to the part's own meeting
    dealt = dealt.select(key.alias("key"), "rep", "comp", "n", "sketch", "part", (F.col("part") != F.col("with")).alias("mixed"))
    dealt = dealt.join(full, "rep").repartition("key").sortWithinPartitions("key")
    links = dealt.mapInArrow(_node_links(similarity, _least(similarity), round(100 * similarity)), "a long, b long, ca long, cb long")
    return _merged(groups, settle(links))


def _labels(links: DataFrame, known: DataFrame) -> DataFrame:
    """(rep, comp): a smaller class that each class is linked with by a few steps; part of the components is enough for pruning."""
    step = links.select(F.col("b").alias("rep"), F.col("a").alias("comp")).unionByName(known.where("comp <> rep").select("rep", "comp"))
    step = step.groupBy("rep").agg(F.min("comp").alias("comp"))
    for _ in range(2):
        ahead = step.select(F.col("rep").alias("comp"), F.col("comp").alias("ahead"))
        step = step.join(ahead, "comp", "left").select("rep", F.coalesce("ahead", "comp").alias("comp"))
    return step


def _roots(parents: DataFrame) -> DataFrame:
    """(node, component): the roots above all nodes but the roots, in a forest (a, b) that has every b once, under a smaller a.  Steps double each round."""
    step = settle(parents.select(F.col("b").alias("node"), F.col("a").alias("component")))
    while True:
        ahead = step.select(F.col("node").alias("component"), F.col("component").alias("ahead"))
        step = step.join(ahead, "component", "left")
        step = settle(step.select("node", F.coalesce("ahead", "component").alias("component"), F.col("ahead").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return step.select("node", "component")
        step = step.drop("moved")


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component), again without the roots: ``groups`` joined by confirmed links, whose ``ca`` and ``cb`` are the components they lie in."""
    if links.isEmpty():
        return groups
    top = settle(components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).where("node <> component"))
    up = groups.join(top.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    return settle(up.select("node", F.coalesce("top", "component").alias("component")).unionByName(top))


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components, with those as ``ca`` and ``cb``."""
    for x in "ab":
        own = groups.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        pairs = pairs.join(own, x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
    return pairs.where("ca <> cb")


def _checked(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(a, b, ca, cb, ok) by the full sets."""
    both = pairs.select("a", "b", "ca", "cb").join(full.select(F.col("rep").alias("a"), F.col("full").alias("fa")), "a")
    both = both.join(full.select(F.col("rep").alias("b"), F.col("full").alias("fb")), "b").select("a", "b", "ca", "cb", "fa", "fb")
    return settle(both.mapInArrow(_confirm(percent), "a long, b long, ca long, cb long, ok boolean"))


def _confirmed(cand: DataFrame, full: DataFrame, percent: int, groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Components (node, component; roots are left out) by the candidates' confirmed links on top of ``groups``, and the tested pairs (a, b, ok).

    The most similar link of every class is confirmed first; then all pairs that still lie in different components."""
    best = cand.groupBy("b").agg(F.max(F.struct("same", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b")
    if groups is None:
        first = _checked(best.withColumns({"ca": F.col("a"), "cb": F.col("b")}), full, percent)
        groups = _roots(first.where("ok"))
    else:
        first = _checked(_apart(best, groups), full, percent)
        groups = _merged(groups, first.where("ok"))
    second = _checked(_apart(cand.join(first.select("a", "b"), ["a", "b"], "left_anti"), groups), full, percent)
    return _merged(groups, second.where("ok")), first.unionByName(second).select("a", "b", "ok")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.75, recall: float = 0.9999) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Links join documents whose shingle sets have at least this Jaccard similarity (a whole number of hundredths), confirmed on the full sets;
    a pair at the threshold is met with probability ``recall``, however deep the nodes of its family branch (as far as the hash
    functions are independent), more similar ones more surely.  Component: the smallest id reachable; kept: the id is it.
    Documents without words (null and empty texts) link with nothing.  Rows that share an id are one
    node with the links of all of them.  A null id is a document of its own below all others, returned as null.  Other columns are
    ignored.  An empty table gives an empty table.
    """
    with short_shuffles(docs.sparkSession):
        found = _groups(docs, id_col, text_col, similarity, recall)
    return _answer(*found, id_col)


def _groups(docs: DataFrame, id_col: str, text_col: str, similarity: float, recall: float) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Sets of all rows, classes of their members, components of the classes, and whether rows share an id."""
    plain = docs.select(id_key(id_col).alias("_id"), col(text_col).cast("string").alias("_text"))
    all_sets = settle(plain.mapInArrow(_keys, "_id long, n long, key binary"))
    some = all_sets.where("n > 0")
    # signatures are written once per class; the texts are cut into shingles again rather than keep those of every row
    signed = plain.mapInArrow(_sets, "_id long, n long, key binary, sig binary")
    sets = classes = settle(signed.groupBy("key").agg(F.min("_id").alias("rep"), F.min("n").alias("n"), F.min("sig").alias("sig")))
    repeated = not classes.groupBy("rep").count().where("count > 1").isEmpty()
    member = some.select("_id", "key").join(classes.select("key", "rep"), "key")
    if repeated:  # rows with one id and different texts: every set stands for itself, the ids are joined at the end
        sets = classes.select(F.xxhash64("key").alias("rep"), "key", "n", "sig")
        member = some.select("_id", "key").withColumn("rep", F.xxhash64("key"))
    trees, percent = trees_for(similarity, recall), round(100 * similarity)
    cand, leaves, depth = _candidates(sets, similarity, range(trees), SURE)
    cand = settle(cand)
    full = _full(plain, all_sets, sets, cand)
    groups, tested = _confirmed(cand, full, percent)
    groups = _second_look(leaves, sets, groups, full, similarity)  # members in doubt are among the candidates' ends
    while (needed := trees_for(similarity, recall, kept(similarity, depth))) > trees:  # paths went deeper than the trees so far allow for
        own = groups.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
        known = settle(sets.join(own, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")))
        new, leaves, reached = _candidates(known, similarity, range(trees, needed), SURE)
        new = settle(new.join(tested.select("a", "b"), ["a", "b"], "left_anti"))
        full = full.unionByName(_full(plain, all_sets, sets, new, full))
        groups, further = _confirmed(new, full, percent, groups)
        tested = settle(tested.unionByName(further))
        groups = _second_look(leaves, sets, groups, full, similarity)
        cand, trees, depth = cand.unionByName(new), needed, max(depth, reached)
    doubt = settle(_apart(tested.where("not ok").join(cand.where(F.col("same") >= SURE), ["a", "b"], "left_semi"), groups))
    if not doubt.isEmpty():  # pairs taken as linked were not: the components they hold together branch again without such pruning
        torn = settle(components(doubt.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
        inner = groups.withColumnRenamed("component", "own").join(torn.select(F.col("node").alias("own"), "component"), "own")
        again = inner.select(F.col("node").alias("rep"), "own", "component").unionByName(torn.select(F.col("node").alias("rep"), F.col("node").alias("own"), "component"))
        # small parts are compared exhaustively at once, large ones by trees
        size = again.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        member_of = settle(again.join(size, "component").join(sets, "rep").select("rep", "n", "sig", "own", "component", "size"))
        small = member_of.where(F.col("size") <= LEAF_MOST).select(F.col("component").alias("node"), "rep")
        large = member_of.where(F.col("size") > LEAF_MOST).select("rep", "n", "sig", F.col("own").alias("comp"))  # confirmed components stay closed
        groups = _second_look(small, sets, groups, full, similarity)
        if not large.isEmpty():
            large, done = settle(large), 0
            while done < trees:
                new, leaves, depth = _candidates(large, similarity, range(done, trees), FUNCTIONS + 1)
                groups, _ = _confirmed(settle(new), full, percent, groups)
                groups, done = _second_look(leaves, sets, groups, full, similarity), trees
                trees = max(trees, trees_for(similarity, recall, kept(similarity, depth)))
    return all_sets, member, groups, repeated


def _full(plain: DataFrame, all_sets: DataFrame, sets: DataFrame, pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(rep, full): the sets of all classes in ``pairs`` but those ``known``, from the texts."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(sets.select("rep", "key"), "rep")
    if known is not None:
        keys = keys.join(known.select("rep"), "rep", "left_anti")
    one = all_sets.select("_id", "key").join(keys, "key").groupBy("rep", "key").agg(F.min("_id").alias("_id"))
    found = plain.join(one, "_id").select("rep", "key", "_text").mapInArrow(_full_sets_of, "rep long, key binary, full binary")
    return settle(found.where("full is not null").select("rep", "full").dropDuplicates(["rep"]))


def _full_sets_of(batches):
    """Full sets of texts whose key is the one asked for (an id may hold several texts)."""
    for b in batches:
        out = []
        for key, t in zip(b.column("key").to_pylist(), texts(b.column("_text"))):
            s = shingles(t).tobytes()
            out.append(s if xxhash.xxh3_128_digest(s) == key else None)
        yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("key"), pa.array(out, pa.binary())], ["rep", "key", "full"])


def _answer(all_sets: DataFrame, member: DataFrame, groups: DataFrame, repeated: bool, id_col: str) -> DataFrame:
    if repeated:
        group = member.join(groups, F.col("rep") == F.col("node"), "left").select("_id", F.coalesce("component", "rep").alias("g"))
        least = group.groupBy("g").agg(F.min("_id").alias("least"))
        edges = group.join(least, "g").select(F.col("_id").alias("a"), F.col("least").alias("b"))
        own = components(edges).select(F.col("node").alias("_id"), "component")
    else:
        own = member.select("_id", "rep").distinct().join(groups, F.col("rep") == F.col("node"), "left")
        own = own.select("_id", F.coalesce("component", "rep").alias("component"))
    out = all_sets.select("_id", "n").join(own, "_id", "left").withColumn("component", F.coalesce("component", "_id"))
    null = F.lit(-(2**63))
    return out.select(
        F.nullif("_id", null).alias(id_col), F.col("n").alias("n_shingles"), F.nullif("component", null).alias("component_id"), (F.col("_id") == F.col("component")).alias("kept")
    )
