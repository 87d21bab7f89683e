"""URL verdicts from sorted digest arrays.

A list of entries is a sorted array of 64-bit xxhash keys with the full strings beside it.  Lookups are
vectorised binary searches, and a hit counts only if the stored string is equal, so equal hashes of
different strings do no harm.  Rules (host, path prefix) are few and travel with the tasks; a block list may be of
any size: it is dealt by hash range into shards, every shard's array lies in a memory-mapped file of its
task and is probed with the distinct hosts whose keys fall into that range.  Where those are many, they are dealt by host to
several tasks, each with the shard's entries.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, others

MAX_RULES = 100_000  # rules travel with every task; longer lists belong into the block list
SHARD = 2_000_000  # entries of the block list in one shard
PROBES = 500_000  # hosts and domains above them that one task looks up in a shard, about
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))


class DigestArray:
    """Sorted 64-bit keys in a memory-mapped file, with their strings in the same order."""

    def __init__(self, entries: list[bytes], hashed=digest):
        entries = list(dict.fromkeys(entries))
        keys = hashed(entries)
        order = np.argsort(keys, kind="stable")
        self.hashed, self.strings, self.order = hashed, [entries[i] for i in order], order
        if len(keys):
            with tempfile.NamedTemporaryFile() as f:
                keys[order].tofile(f.name)
                self.keys = np.memmap(f.name, np.uint64, "r")  # the mapping outlives the name; nothing is left on disk
        else:
            self.keys = keys

    def find(self, probes: list[bytes]) -> np.ndarray:
        """Index of the entry equal to each probe, else -1."""
        keys = self.hashed(probes)
        at = np.searchsorted(self.keys, keys)
        found = np.full(len(probes), -1)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == keys[hit]
        for i in np.flatnonzero(hit):
            k = at[i]
            while k < len(self.keys) and self.keys[k] == keys[i]:  # different strings may share a key
                if self.strings[k] == probes[i]:
                    found[i] = self.order[k]
                    break
                k += 1
        return found


def suffixes(host: str) -> list[str]:
    """The host and all domains above it."""
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))] if host else []


def _judge(rules: list[tuple[str, str, str]]):
    def run(batches):
        keys = [f"{h}\n{p}".encode() for h, p, _ in rules]
        array = DigestArray(keys)
        lengths = sorted({len(p) for _, p, _ in rules})
        for b in batches:
            probes, owner = [], []
            above: dict[str, list[str]] = {}
            for i, (host, path) in enumerate(zip(b.column("host").to_pylist(), b.column("path").to_pylist())):
                if host not in above:
                    above[host] = suffixes(host)
                for n in lengths:
                    if n <= len(path):
                        probes += [f"{s}\n{path[:n]}".encode() for s in above[host]]
                        owner += [i] * len(above[host])
            best: list[int] = [-1] * b.num_rows
            size = [-1] * b.num_rows
            found = array.find(probes)
            for j in np.flatnonzero(found >= 0):
                i, r = owner[j], int(found[j])
                n = len(rules[r][0]) + len(rules[r][1])
                if n > size[i] or n == size[i] and r < best[i]:
                    best[i], size[i] = r, n
            named = pa.array([rules[r][0] + rules[r][1] if r >= 0 else None for r in best], pa.string())
            said = pa.array([rules[r][2] if r >= 0 else None for r in best], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, named, said], [*b.schema.names, "rule", "verdict"])

    return run


def _probe_shard(hosts: pa.Table, entries: pa.Table) -> pa.Table:
    """Hosts of one hash range that stand in the same range of the block list."""
    array = DigestArray([e.encode() for e in entries.column("_entry").to_pylist()])
    found = array.find([k.encode() for k in hosts.column("_entry").to_pylist()])
    return pa.table({"_host": hosts.column("_host").filter(pa.array(found >= 0))})


def _keyed(parts):
    """Rows with the strings that ``parts`` gives for the first column, and the place of their keys in the hash range [0, 1)."""

    def run(batches):
        for b in batches:
            own, keys = [], []
            for value in b.column(0).to_pylist():
                found = parts(value)
                own += [value] * len(found)
                keys += found
            at = digest([k.encode() for k in keys]) / 2.0**64
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(keys, pa.string()), pa.array(at)], ["_host", "_entry", "_at"])

    return run


def listed_hosts(hosts: DataFrame, blocked: DataFrame, entry_col: str) -> DataFrame:
    """(_host) of ``hosts`` (_host, distinct) that stand in ``blocked`` themselves or below one of its entries."""
    entries = blocked.select(F.translate(col(entry_col).cast("string"), UPPER, LOWER).alias("_entry")).where("_entry <> ''").distinct()
    shards = -(-max(entries.count(), 1) // SHARD)
    shard = F.least(F.floor(F.col("_at") * shards), F.lit(shards - 1)).cast("int")
    keyed = "_host string, _entry string, _at double"
    entries = entries.mapInArrow(_keyed(lambda e: [e]), keyed).select("_entry", shard.alias("_shard"))
    probes = hosts.mapInArrow(_keyed(suffixes), keyed).select("_host", "_entry", shard.alias("_shard"))
    # one row per shard; a domain above very many hosts makes its shard a hot one, so every shard has its own number of tasks
    tasks = [1] * shards
    for r in probes.groupBy("_shard").count().collect():
        tasks[r["_shard"]] = -(-r["count"] // PROBES)
    dealt = F.element_at(F.array(*[F.lit(n) for n in tasks]), F.col("_shard") + 1)
    probes = probes.withColumn("_task", F.pmod(F.xxhash64("_host"), dealt))
    entries = entries.withColumn("_task", F.explode(F.sequence(F.lit(0).cast("long"), dealt - F.lit(1).cast("long"))))
    pairs = probes.groupBy("_shard", "_task").cogroup(entries.groupBy("_shard", "_task"))
    return pairs.applyInArrow(_probe_shard, "_host string").distinct()


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], blocked: DataFrame | None = None, url_col: str = "url", entry_col: str = "host") -> DataFrame:
    """``pages`` with host, path, rule (host and path of the longest rule that fits, else null) and verdict.

    ``rules``: (host, path prefix, verdict), at most MAX_RULES; a rule fits its host and all subdomains.
    Pages without a rule are blocked if their host or a domain above it stands in ``blocked``, else allowed.
    Null urls and those without :// have an empty host and path, fit no rule and are allowed.  Among equally
    long rules the first wins; repeated rows are judged alike; columns named host, path, rule, verdict are replaced, _host and _said go.
    An empty table gives an empty table, an empty list blocks nothing.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules; put more into the block list")
    rest = others(pages, "host", "path", "rule", "verdict", "_host", "_said")
    url = col(url_col).cast("string")
    named = pages.select(*[col(c) for c in rest], url_host(url).alias("host"), url_path(url).alias("path"))
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in named.schema.fields)
    judged = named.mapInArrow(_judge(rules), f"{schema}, rule string, verdict string")
    if blocked is None:
        return judged.withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    hosts = pages.select(url_host(url).alias("_host")).where("_host <> ''").distinct()
    listed = listed_hosts(hosts, blocked, entry_col).select("_host", F.lit("block").alias("_said"))
    listed = listed.repartition(F.xxhash64("_host"))  # both sides of the join are shuffled for it, so a hot host's pages can be split
    out = judged.join(listed, F.col("host") == F.col("_host"), "left")
    return out.withColumn("verdict", F.coalesce("verdict", "_said", F.lit("allow"))).drop("_host", "_said")

