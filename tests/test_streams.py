"""Streams: several files, a replayed batch, restarts, late rows, compaction, and two writers."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scoreweave.operators.gram import moments
from scoreweave.streaming import online
from scoreweave.streaming.tables import StreamTable, latest


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert [v if isinstance(w, float) else (v == w) for v, w in zip(x, y)] == [pytest.approx(w, rel=1e-9) if isinstance(w, float) else True for w in y]


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(["a", "b", None]), f"2024-01-0{rnd.randrange(1, 9)} {rnd.randrange(24):02d}:15:00", rnd.choice([None, rnd.gauss(1e6, 1.0)])) for _ in range(300)]
    rows.append(("only null", "2024-01-01 00:00:00", None))
    return spark.createDataFrame(rows, "k string, ts string, v double").withColumn("ts", F.to_timestamp("ts"))


@pytest.mark.parametrize("most", [1, 100])
def test_batches_in_any_order_equal_the_whole(spark, events, tmp_path, most):
    """Late rows count, a replayed batch counts once, merged or not."""
    parts = events.randomSplit([1.0] * 5, 3)
    keys = ["k"]
    stats = StreamTable(spark, str(tmp_path / "stats"), online.merge_stats(keys), most=most)
    bins = StreamTable(spark, str(tmp_path / "bins"), online.merge_windows(keys), most=most)
    for i in (0, 1, 1, 2, 3, 2, 4):
        stats.commit(i, online.partial_stats(parts[i], keys, "v"))
        bins.commit(i, online.partial_windows(parts[i], "ts", "2 days", keys, "v", "1 day"))
    assert (len(stats.manifest()[1]) == 1) == (most == 1)
    want = events.groupBy("k").agg(F.count("v"), F.avg("v"), F.stddev_samp("v"))
    close(rows_of(online.finish_stats(stats.read(), keys)), rows_of(want))
    want = online.finish_windows(online.partial_windows(events, "ts", "2 days", keys, "v", "1 day"))
    close(rows_of(online.finish_windows(bins.read())), rows_of(want))


def test_failed_batch_and_second_writer(spark, events, tmp_path):
    """Pieces that no manifest lists do not count, and of two writers of a version the second fails."""
    path = str(tmp_path / "t")
    t = StreamTable(spark, path, online.merge_stats(["k"]), schema="k string, n long, mean double, m2 double")
    assert t.read().collect() == []
    with pytest.raises(ValueError, match="no batch"):
        StreamTable(spark, path, online.merge_stats(["k"])).read()
    rows = online.partial_stats(events, ["k"], "v")
    t.commit(0, rows)
    rows.withColumn("batch", F.lit(1).cast("long")).write.parquet(f"{path}/data/batch=1-lost")
    assert sum(r["n"] for r in t.read().collect()) == events.where("v is not null").count()
    with pytest.raises(PySparkException):
        t._publish(1, t.manifest()[1])


def run(spark, folder, checkpoint, schema, write):
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    write(rows).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_stream_restarts_and_replays(spark, events, tmp_path):
    """Three files; the query stops between them, and its last batch is run again as after a crash before the commit."""
    folder, checkpoint = str(tmp_path / "in"), tmp_path / "ck"
    t = StreamTable(spark, str(tmp_path / "t"), online.merge_stats(["k"]))
    for part in events.randomSplit([1.0] * 3, 1):
        part.coalesce(1).write.mode("append").parquet(folder)
        run(spark, folder, str(checkpoint), events.schema, lambda df: online.into(df, t, lambda b: online.partial_stats(b, ["k"], "v")))
    version = t.manifest()[0]
    newest = max((checkpoint / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (newest, newest.with_name(f".{newest.name}.crc")):
        p.unlink(missing_ok=True)
    run(spark, folder, str(checkpoint), events.schema, lambda df: online.into(df, t, lambda b: online.partial_stats(b, ["k"], "v")))
    assert t.manifest()[0] == version + 1 and len(t.manifest()[1]) == 3  # written again, in place of the first time
    want = events.groupBy("k").agg(F.count("v"), F.avg("v"), F.stddev_samp("v"))
    close(rows_of(online.finish_stats(t.read(), ["k"])), rows_of(want))


def test_moments_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = [(str(i % 2), rng.normal(size=3).tolist(), rng.normal(size=2).tolist()) for i in range(90)]
    df = spark.createDataFrame(data, "part string, x array<double>, y array<double>")
    t = StreamTable(spark, str(tmp_path / "t"), online.merge_moments, most=2)
    partial = online.partial_moments("x", "y", (3, 2))
    for i, part in enumerate([*df.randomSplit([1.0] * 3, 2), df.limit(0)]):
        t.commit(i, partial(part))
        t.commit(i, partial(part))
    want = {(r["part"], r["g"]): r for r in moments(df, "part", "x", "y", shift=np.zeros(5)).df.collect()}
    got = {(r["part"], r["g"]): r for r in online.read_moments(t, (3, 2)).df.collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert r["n"] == want[k]["n"] and [r["s"], r["ss"], *r["xr"]] == pytest.approx([want[k]["s"], want[k]["ss"], *want[k]["xr"]])


def context(words, width, most):
    """Brute force: the last words up to every bin."""
    out = {}
    for story in {w[0] for w in words}:
        own = sorted(w for w in words if w[0] == story)
        bins = int(np.ceil(max(w[4] for w in own) / width))
        for b in range(bins):
            out[story, b] = [w[2] for w in own if (w[3] + w[4]) / 2 // width <= b][-most:]
    return out


def test_word_context(spark, tmp_path):
    """Bins that later files fill again, gaps, and stories that rest for some files."""
    rnd = random.Random(6)
    words, clock = [], {"a": 0.0, "b": 0.0, "c": 5.0}
    for i in range(120):
        story = rnd.choice("ab" if i % 50 > 20 else "abc")
        clock[story] += rnd.choice([0.1, 0.5, 0.9, 4.0])
        words.append((story, i, f"w{i}", clock[story], clock[story] + rnd.choice([0.2, 0.3])))
    schema = "story string, seq long, word string, t0 double, t1 double"
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "ck")
    t = StreamTable(spark, str(tmp_path / "t"), latest("story", "bin"), most=2)
    for start in range(0, 120, 30):
        spark.createDataFrame(words[start : start + 30], schema).coalesce(1).write.mode("append").parquet(folder)
        run(spark, folder, checkpoint, schema, lambda df: online.into(online.word_context(df, "story", 1.0, 4), t, mode="update"))
    got = {(r["story"], r["bin"]): r["words"] for r in t.read().collect()}
    assert got == context(words, 1.0, 4)
    spark.createDataFrame(words[:1], schema).coalesce(1).write.mode("append").parquet(folder)
    with pytest.raises(PySparkException, match="comes after word"):
        run(spark, folder, checkpoint, schema, lambda df: online.into(online.word_context(df, "story", 1.0, 4), t, mode="update"))


def test_arrivals_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    """An arrival is one micro-batch however many files it has, and no task writes all of it."""
    from scoreweave.catalog import streams

    monkeypatch.setattr(streams, "scratch", lambda s, name: str(tmp_path / name))
    df = spark.range(400).withColumn("v", F.lit(1.0)).repartition(4)
    t = StreamTable(spark, str(tmp_path / "t"), latest("id"), "id long, v double", 9)
    streams.stream(df, "id", t, lambda rows: online.into(rows, t))
    assert len(list((tmp_path / "arrivals").glob("part-*.parquet"))) == 4 * streams.FILES
    assert t.read().count() == 400 and len(t.manifest()[1]) == streams.FILES
