"""Lines that many documents share are kept in one document only.

Explode the normalised lines of every document, hash them (128 bits), count distinct documents per hash,
drop frequent lines everywhere but in the largest id that holds them, reassemble by position.
Only hashes and ids are shuffled for the count; a line in a third of the documents is pre-aggregated
before its shuffle, and the way back is a sort-merge join that adaptive execution splits.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, id_key, others, texts

SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """White space [\\x20\\x09-\\x0D] stripped, A-Z lower-cased."""
    return line.strip(SPACE).lower()


def _hashes(text: bytes, min_chars: int) -> list[bytes | None]:
    """128-bit hash of every line's key; None where the key is shorter than ``min_chars`` code points."""
    out = []
    for line in text.split(b"\n"):
        key = line_key(line)
        long = len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def _explode(min_chars: int):
    def run(batches):
        for b in batches:
            ids, found = [], []
            for i, t in zip(b.column("_id").to_pylist(), texts(b.column("_text"))):
                own = {h for h in _hashes(t, min_chars) if h}
                found += own
                ids += [i] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["_id", "_line"])

    return run


def _reassemble(min_chars: int, text_col: str, names: list[str]):
    def run(batches):
        for b in batches:
            kept, n_lines, n_dropped = [], [], []
            for t, drop in zip(texts(b.column(text_col)), b.column("_drop").to_pylist()):
                lines, gone = t.split(b"\n"), set(drop or ())
                left = [x for x, h in zip(lines, _hashes(t, min_chars)) if h not in gone] if gone else lines
                kept.append(b"\n".join(left).decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            new = {text_col: pa.array(kept, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else b.column(n) for n in names], names)

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Every row of ``docs`` with the shared lines taken out of its text, and n_lines, n_dropped.

    A null or empty text is one empty line and comes back empty.  Rows with one id are one document (null is
    an id of its own, below all others); the largest id keeps all its copies of the line.  Columns named
    n_lines, n_dropped, _key or _drop are replaced, all others stay.  An empty table gives an empty table.
    """
    rest = others(docs, "n_lines", "n_dropped", "_key", "_drop")
    base = docs.select(*[col(c) for c in rest], id_key(id_col).alias("_key"))
    lines = docs.select(id_key(id_col).alias("_id"), col(text_col).cast("string").alias("_text"))
    lines = lines.mapInArrow(_explode(min_chars), "_id long, _line binary")
    frequent = (
        lines.groupBy("_line").agg(F.countDistinct("_id").alias("_n"), F.max("_id").alias("_keep")).where(F.col("_n") >= min_docs).drop("_n")
    )
    frequent = frequent.repartition("_keep")  # both sides of the join are shuffled for it, so a hot line's rows can be split
    drops = lines.join(frequent, "_line").where(F.col("_id") != F.col("_keep")).groupBy(F.col("_id").alias("_key")).agg(F.collect_set("_line").alias("_drop"))
    joined = base.join(drops, "_key", "left").drop("_key")
    names = [*rest, "n_lines", "n_dropped"]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields} | {text_col: "string", "n_lines": "bigint", "n_dropped": "bigint"}
    schema = ", ".join(f"`{n.replace('`', '``')}` {types[n]}" for n in names)
    return joined.mapInArrow(_reassemble(min_chars, text_col, names), schema)
