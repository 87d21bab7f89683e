"""Periodic runs, hard negatives and spot signatures against brute force, on small tables with nulls, ties, repeated rows and odd columns."""

import hashlib
import random
from fractions import Fraction
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scoreweave.llm import hard_negatives, mixing, packing, periodic_runs, queries, spotsigs, url_filter

SF = "/root/testdata/sf0.001"


def brute_runs(words, least=24, periods=3):
    found, n = {}, len(words)
    for p in range(1, n // periods + 1):
        j = 0
        while j + p < n:
            start = j
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > start and j + p - start >= max(least, periods * p):
                found.setdefault((start, j + p), p)
            j += 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def periodic_texts(count, seed):
    rnd = random.Random(seed)
    for _ in range(count):
        kinds, n = rnd.choice([1, 2, 3, 50]), rnd.randrange(0, 160)
        words = [rnd.randrange(kinds) for _ in range(n)]
        for _ in range(rnd.randrange(3)):
            at, p = rnd.randrange(n + 1), rnd.randrange(1, 20)
            for i in range(at + p, min(n, at + rnd.randrange(1, 100))):
                words[i] = words[i - p]
        yield words


@pytest.mark.parametrize("table", [periodic_runs.TABLE, 20])
@pytest.mark.parametrize("least", [24, 5])
def test_runs_brute_force(monkeypatch, table, least):
    """Both ways to the candidates give all runs, alone and in company."""
    monkeypatch.setattr(periodic_runs, "TABLE", table)
    docs = list(periodic_texts(600, least))
    got = periodic_runs.runs_of([np.array(d, np.int64) for d in docs], least)
    assert [list(map(tuple, g.tolist())) for g in got] == [brute_runs(d, least) for d in docs]
    assert sum(map(len, got)) > 100


def test_grammar_extensions():
    rng = np.random.default_rng(3)
    for kinds in (1, 2, 4):
        seq = np.tile(rng.integers(0, kinds, 37), 12)
        seq[200] = kinds
        g = periodic_runs.Grammar(seq, len(seq))
        a, b = rng.integers(0, len(seq), (2, 300))
        a, b = np.minimum(a, b), np.maximum(a, b)
        a, b = a[a < b], b[a < b]
        right, left = g.right(a, b), g.left(a, b)
        for i, j, r, l in zip(a, b, right, left):
            assert (seq[i : i + r] == seq[j : j + r]).all() and (j + r == len(seq) or seq[i + r] != seq[j + r])
            assert (seq[i - l : i] == seq[j - l : j]).all() and (i == l or seq[i - l - 1] != seq[j - l - 1])
    assert len(periodic_runs.Grammar(np.zeros(100_000, np.int64), 100_000).rounds) == 1


def test_long_text_of_one_word():
    n = 100_000
    assert periodic_runs.runs_of([np.zeros(n, np.int64)])[0].tolist() == [[0, n, 1]]


def test_runs_query(spark):
    """All columns of the query, from the texts, on a whole small table."""
    texts = {r["doc_id"]: (r["text"] or "").encode().split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op11_periodic_runs(spark, SF).collect()
    assert len(rows) == len(texts)
    some = 0
    for r in rows:
        words = list(texts[r["doc_id"]])
        h = crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if len(words) > 3000:
            continue
        runs = brute_runs(words)
        some += len(runs)
        top = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *top)
        assert r["exponent_milli"] == (None if top[0] is None else 1000 * top[1] // top[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
    assert some > 5


def test_runs_odd_rows(spark):
    rows = [(None, None, "a", 1), (1, "", "b", 2), (2, "x " * 30, "c", 3), (2, "x " * 30, "c", 3), (3, "\t\n \x0b", "d", 4), (4, "ü " * 23, "e", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, epoch int")
    out = sorted(periodic_runs.collapse_runs(docs).collect(), key=lambda r: r["epoch"])
    assert [r["n_runs"] for r in out] == [0, 0, 1, 1, 0, 0] and [r["epoch"] for r in out] == [1, 2, 3, 3, 4, 5]
    assert out[2]["text"] == "x" and out[2]["best"].asDict() == {"start": 0, "length": 30, "period": 1} and out[0]["best"] is None
    assert out[0]["text"] == "" and out[5]["text"] == " ".join("ü" * 23)
    assert periodic_runs.collapse_runs(docs.limit(0)).collect() == []
    assert queries.periodic_tail(None, [b"a"]) == [b"a"]


def brute_negatives(rows, positives, negatives, low, high, every):
    quant = {}
    for i, v, label in sorted(rows, key=lambda r: (r[0] is None, r[0], r[2] is None, r[2], r[1] is None)):
        if i is None or label is None or v is None or any(x is None or x - x != 0 for x in v):
            continue
        q = [int(np.floor(256 * float(x))) for x in v]
        if i not in quant or (label, q) < quant[i]:
            quant[i] = (label, q)
    out = []
    for a, (label, q) in quant.items():
        if a % every:
            continue
        near = sorted((-sum(x * y for x, y in zip(q, w)), i, l) for i, (l, w) in quant.items() if i != a)
        for s, p, _ in [x for x in near if x[2] == label][:positives]:
            window = [(t, i) for t, i, l in near if l != label and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, k, i, -s, -t) for k, (t, i) in enumerate(window[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard,block", [(hard_negatives.SHARD, hard_negatives.BLOCK), (37, 3)])
def test_negatives_brute_force(spark, monkeypatch, shard, block):
    """Ties, negative scores, repeated ids and odd vectors; also over many shards and blocks."""
    monkeypatch.setattr(hard_negatives, "SHARD", shard)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.5, 1.0, 0.26]) for _ in range(rnd.choice([4, 4, 5]))], rnd.randrange(3)) for i in range(200)]
    rows += [(i, [1.0, 1.0, 1.0, 1.0], i % 3) for i in range(200, 300)]  # one very common vector
    rows += [(300, None, 1), (301, [1.0, None], 1), (302, [float("nan")] * 4, 1), (303, [float("inf")] * 4, 1), (304, [], 1), (305, [1.0] * 4, None)]
    rows += [(None, [1.0] * 4, 1), (50, [9.0] * 4, 2), (50, [9.0] * 4, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "vec_id AS anchor_id", "'x' AS slot")
    got = sorted(map(tuple, hard_negatives.mine(df, every=10).collect()))
    want = brute_negatives(rows, 5, 3, 50, 95, 10)
    assert got == want and len(want) > 100


def test_negatives_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(none).collect() == []
    one = spark.createDataFrame([(0, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(one).collect() == []


def brute_spots(text):
    words = [w for w in "".join(c if ord(c) > 127 or c.isalnum() else " " for c in text.lower()).split(" ") if w]
    content = [i for i, w in enumerate(words) if w not in spotsigs.COMMON]
    chain = {i: " ".join(words[j] for j in content[k : k + 2]) for k, i in enumerate(content)}
    spots = [f"{words[i - 1]} {c}" for i, c in chain.items() if i and words[i - 1] in spotsigs.COMMON]
    return sorted({hashlib.md5(s.encode()).hexdigest()[:16] for s in spots or chain.values()})


def brute_likeness(a, b, least=0.05):
    if not a or not b:
        return float(a == b)
    if min(len(a), len(b)) < max(len(a), len(b)) * least:
        return 0.0
    shared = len(set(a) & set(b))
    return shared / (len(a) + len(b) - shared)


@pytest.mark.parametrize("part", [spotsigs.PART, 40])
def test_spots_brute_force(spark, monkeypatch, part):
    """Neighbours across many ranges, repeated rows, ids without a text and texts without an id; clashing columns."""
    monkeypatch.setattr(spotsigs, "PART", part)
    monkeypatch.setattr(spotsigs, "FAN", 3)
    if part == 40:
        monkeypatch.setattr(spotsigs, "MOST", 11)
    rnd = random.Random(4)
    vocabulary = ["the", "of", "is", "une", "der", "Haus,", "été", "cat.", "RUNS", "x1", "ñ-o", "y"]
    rows = [(rnd.choice([i, i, 7]), " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(40)))) for i in range(-20, 60)]
    rows += [(100, None), (101, ""), (102, "haus cat"), (103, "the of"), (104, "😀 the 😀😀 cat"), (None, "text without an id"), (None, "another")] + [(5, "the same row")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _range", "2 AS signatures", "'a' AS next_text")
    order = sorted(((-(2**63) if i is None else i, hashlib.md5((t or "").encode()).hexdigest(), t or "") for i, t in rows), reverse=True)
    want = []
    for k, (i, _, t) in enumerate(order):
        follows = order[(k + 1) % len(order)][2]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + follows[:cut]
        a, b = brute_spots(t), brute_spots(edited)
        want.append((None if i == -(2**63) else i, t, len(t), edited, a, b, brute_likeness(a, b), brute_likeness(a, brute_spots(follows))))
    key = lambda r: tuple(map(repr, r))
    got = sorted(map(tuple, spotsigs.fingerprints(df).collect()), key=key)
    assert got == sorted(want, key=key)


def test_spots_small_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spotsigs.fingerprints(none).collect() == []
    alone = spotsigs.fingerprints(spark.createDataFrame([(1, "the cat runs")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0 and alone[0]["edited_text"] == "the cat the "


def test_spots_use_no_python(spark):
    plan = queries.op13_spotsigs(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Pandas" not in plan


def test_spots_tell_edits_from_strangers(spark):
    rows = queries.op13_spotsigs(spark, SF).collect()
    long = [r for r in rows if r["n_chars"] > 300]
    assert sum(r["near_edited"] > r["near_next"] for r in long) / len(long) > 0.98
    assert sum(r["near_edited"] for r in long) / len(long) > 0.4 > sum(r["near_next"] for r in long) / len(long)


def test_packing_words_of_any_script():
    """Word by word or whole, the ids are the tokenizer's: letters that end in marks once composed or lower-cased, capitals, signs."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coder = Tokenizer.from_file(path)
    rnd = random.Random(11)
    signs = ["İ", "I", "ı", "Σ", "ς", "ß", "ﬁ", "é", "e\u0301", "\u0958", "क", "़", "漢", "ά", "A", "z", "'", "s", "9", "-", "😀", "\u0130\u0307"]
    texts = ["bu TARİHİ. TURİZMİ, İ!"] + ["".join(rnd.choice(signs) for _ in range(rnd.randrange(1, 6))) + rnd.choice(["", ".", "?!", ",;", ":", "..."]) for _ in range(3000)]
    own = packing._WordIds(path)
    for t in texts:
        words = t.encode().split()
        known = own.learn(set(words))
        assert np.frombuffer(b"".join(known[w] for w in words), "<u4").tolist() == coder.encode(t, add_special_tokens=False).ids, t


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 3}", 1) for i in range(30)], "doc_id long, text string, source string, epoch int")
    names = ["_passes", "_whole", "_border", "_run", "_source", "Block"]
    mixed = mixing.mix_sources(docs.selectExpr("*", *[f"'x' AS {n}" for n in names]))
    assert {r["doc_id"] for r in mixed.collect()} == set(range(30)) and "Block" not in mixed.columns
    pages = spark.createDataFrame([(1, "https://ads.example.com/fr/x"), (2, None)], "page_id long, url string")
    hosts = spark.createDataFrame([("example.com",)], "host string")
    out = url_filter.filter_urls(pages.selectExpr("*", *[f"1 AS {n}" for n in ("_said", "_host", "Rule", "_entry", "_shard")]), [], hosts).collect()
    assert {r["page_id"]: r["verdict"] for r in out} == {1: "block", 2: "allow"}
