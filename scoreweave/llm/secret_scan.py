"""Secrets in texts and in the layers encoded inside them.

Every whole text is scanned for three kinds of spans.  Then a worklist unwraps what is encoded: runs with URL escapes, with
Unicode escapes, base64 runs (of one line or wrapped over several), and zlib or gzip data inside base64.  A run is decoded
from each of its first four letters, since what stands before the encoded part may belong to the same alphabet, and every
stretch of valid UTF-8 in what comes out is a layer.  Each new layer is scanned and unwrapped
again until nothing new appears.  A layer is entered once for every place it comes from: only one with the same text from the
same characters is not entered again, as it would add the same spans, so cycles end and repeats are all reported.  Spans found
in a layer are mapped back to the characters of the original text that encode them.
"""

from __future__ import annotations

import binascii
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import col, others

# fixed patterns: kind, expression, group whose length counts, least length
KINDS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
HEX_RUN = re.compile(r"[0-9a-f]{24,}")
URL_RUN = re.compile(r"[^\s%]*(?:%[0-9A-Fa-f]{2}[^\s%]*)+")
UNICODE_RUN = re.compile(r"\\u[0-9A-Fa-f]{4}")
UNICODE_TOKEN = re.compile(r"\S*\\u[0-9A-Fa-f]{4}\S*")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
BASE64_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t>]*+[A-Za-z0-9+/_-]++)+={0,2}")
LETTERS = re.compile(r"[A-Za-z0-9+/_-]+")
PACKED = re.compile(rb"\x1f\x8b|\x78[\x01\x5e\x9c\xda]")
# the shortest secret (token=123456) has 12 characters, the shortest run of base64 that may hold one 16: shorter layers hold none
UTF8 = re.compile(
    rb"(?:[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){12,}"
)
ORDER = {kind: i for i, (kind, *_) in enumerate(KINDS)}


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret in a text: leftmost, non-overlapping per kind; too short ones are dropped."""
    found = []
    for kind, pattern, group, least in KINDS:
        if kind == "hex":
            pattern = HEX_RUN  # the same runs: a maximal run of 24 or more
        elif kind == "access" and "AKIA" not in text:
            continue
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return found


class Layer:
    """A text with, for each character, the first and the last original character (exclusive) it comes from."""

    def __init__(self, text: str, lo: np.ndarray, hi: np.ndarray):
        self.text, self.lo, self.hi = text, lo, hi

    def place(self) -> tuple[str, bytes]:
        """The text and the characters it comes from; all that the spans below this layer depend on."""
        return self.text, xxhash.xxh3_128_digest(self.lo.tobytes() + self.hi.tobytes())

    def from_bytes(self, data: bytes, lo: np.ndarray, hi: np.ndarray):
        """The layers that the stretches of valid UTF-8 in decoded bytes spell."""
        for m in UTF8.finditer(data):
            raw = np.frombuffer(m.group(), np.uint8)
            first = np.flatnonzero((raw & 0xC0) != 0x80)
            last = np.append(first[1:], len(raw)) - 1
            yield Layer(m.group().decode(), lo[m.start() + first], hi[m.start() + last])

    def url(self):
        for m in URL_RUN.finditer(self.text):
            data, at, i = bytearray(), [], m.start()
            while i < m.end():
                esc = self.text[i] == "%"
                new = bytes([int(self.text[i + 1 : i + 3], 16)]) if esc else self.text[i].encode("utf-8", "surrogatepass")
                step = 3 if esc else 1
                data += new
                at += [(self.lo[i], self.hi[i + step - 1])] * len(new)
                i += step
            lo, hi = np.array(at, np.int64).T
            yield from self.from_bytes(bytes(data), lo, hi)

    def unicode(self):
        for m in UNICODE_TOKEN.finditer(self.text):
            out, lo, hi, i = [], [], [], m.start()
            while i < m.end():
                e = UNICODE_RUN.match(self.text, i, m.end())
                step = 6 if e else 1
                out.append(chr(int(self.text[i + 2 : i + 6], 16)) if e else self.text[i])
                lo.append(self.lo[i])
                hi.append(self.hi[i + step - 1])
                i += step
            yield Layer("".join(out), np.array(lo, np.int64), np.array(hi, np.int64))

    def base64(self):
        for m in BASE64_RUN.finditer(self.text):
            yield from self.decoded(m.group().rstrip("="), [(m.start(), m.end())])
        if "\n" in self.text:
            for m in BASE64_LINES.finditer(self.text):
                lines = [x.span() for x in LETTERS.finditer(self.text, m.start(), m.end())]
                if sum(e - s for s, e in lines) >= 16:
                    yield from self.decoded("".join(self.text[s:e] for s, e in lines), [*lines[:-1], (lines[-1][0], m.end())])

    def decoded(self, letters: str, parts: list[tuple[int, int]]):
        """Layers in base64 letters that stand in these parts of the text; padding after them belongs to the last part."""
        letters = letters.replace("-", "+").replace("_", "/")
        at = None
        for k in range(4):
            run = letters[k:]
            run = run[: len(run) - (len(run) % 4 == 1)]  # one letter over encodes nothing
            data = binascii.a2b_base64(run + "=" * (-len(run) % 4))
            packed, plain = list(_unpack(data)), UTF8.search(data)
            if not packed and not plain:
                continue
            if at is None:
                at = np.concatenate([np.arange(s, e) for s, e in parts])
            n = np.arange(len(data))
            first = k + n // 3 * 4 + n % 3  # letter with the first bits of every byte
            for start, end, out in packed:
                lo, hi = self.lo[at[first[start]]], self.hi[at[-1] if end == len(data) else at[first[end - 1] + 1]]
                yield from self.from_bytes(out, np.full(len(out), lo), np.full(len(out), hi))
            if plain:
                yield from self.from_bytes(data, self.lo[at[first]], self.hi[at[np.minimum(first + 1, len(at) - 1)]])

    def inner(self):
        """Layers encoded in this one."""
        if "%" in self.text:
            yield from self.url()
        if "\\u" in self.text:
            yield from self.unicode()
        yield from self.base64()


def _member(data: memoryview) -> tuple[bytes, memoryview | None]:
    """Contents of one zlib or gzip member as far as they can be read, and what follows it (None if it has no proper end)."""
    one = zlib.decompressobj(47)
    try:
        out = one.decompress(data)
        return out, data[len(data) - len(one.unused_data) :] if one.eof else None
    except zlib.error:
        one, out = zlib.decompressobj(47), bytearray()
        try:
            for i in range(len(data)):
                out += one.decompress(data[i : i + 1])
        except zlib.error:
            pass
        return bytes(out), None


def _unpack(data: bytes):
    """(start, end, contents) of zlib or gzip data, wherever it starts; members that follow each other are read together."""
    done = 0
    for m in PACKED.finditer(data):
        if m.start() < done:
            continue
        out, rest = _member(memoryview(data)[m.start() :])
        end = len(data)
        while rest is not None:
            end = done = len(data) - len(rest)
            zeros = len(rest) - len(bytes(rest).lstrip(b"\0"))
            if not PACKED.match(rest, zeros):
                break
            more, rest = _member(rest[zeros:])
            out += more
            end = len(data)
        if out:
            yield m.start(), end, out


def spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Spans of the text itself, and those added by its encoded layers, both by start, then kind, then end."""
    by = lambda s: (s[0], ORDER[s[2]], s[1])
    base = sorted(scan(text), key=by)
    whole = np.arange(len(text), dtype=np.int64)
    top = Layer(text, whole, whole + 1)
    added, seen, work = set(), {top.place()}, [top]
    while work:
        for layer in work.pop().inner():
            if (place := layer.place()) in seen:
                continue
            seen.add(place)
            added.update((int(layer.lo[s]), int(layer.hi[e - 1]), kind) for s, e, kind in scan(layer.text))
            work.append(layer)
    return base, sorted(added - set(base), key=by)


SPAN = "array<struct<start: long, `end`: long, kind: string>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def _scan(text_col: str, names: list[str]):
    def run(batches):
        for b in batches:
            both = [spans(t or "") for t in b.column(text_col).cast(pa.string()).to_pylist()]
            new = [pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in x[i]] for x in both], _SPANS) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *new], [*names, "base_spans", "added_spans"])

    return run


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with base_spans and added_spans: (start, end, kind) in code points, end exclusive.

    A null text is scanned as an empty one.  A span that a layer finds where the text itself has the same one is not
    added again; an encoded secret that stands several times in a text has a span in each place.  Rows are judged one by one, so repeated rows and
    nulls in other columns play no part; columns named base_spans or added_spans are replaced.  No shuffle.
    """
    names = others(docs, "base_spans", "added_spans")
    kept = docs.select(*[col(c) for c in names])
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(_scan(text_col, names), f"{schema}, base_spans {SPAN}, added_spans {SPAN}")
