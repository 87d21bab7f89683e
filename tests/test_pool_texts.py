"""Pieces pooled within their text, next to pooling them as rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreweave.operators import transforms


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_pooled_without_a_shuffle(spark):
    """As ``pool_words``: pieces before the first start are word 0; null and empty texts have no words."""
    rng = np.random.default_rng(4)
    texts = [(i, [rng.normal(size=2).tolist() for _ in range(n)], [bool(rng.random() < 0.4) for _ in range(n)]) for i, n in enumerate([5, 0, 1, 40, 7])]
    docs = spark.createDataFrame([*texts, (9, None, None)], "doc long, v array<array<double>>, s array<boolean>")
    out = transforms.pool_texts(docs, "doc", F.col("v"), F.col("s"))
    assert "Exchange" not in plan_of(out)
    tokens = docs.select("doc", F.posexplode(F.arrays_zip("v", "s")).alias("pos", "z")).select("doc", "pos", F.col("z.v").alias("vec"), F.col("z.s").alias("s"))
    words = transforms.pool_words(tokens, "doc", "pos", "vec", F.col("s"))
    got, want = ({(r["doc"], r["word_idx"]): (r["n_pieces"], r["vec"]) for r in df.collect()} for df in (out, words))
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] for k in want)
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in want)
    last = {r["doc"]: r["word_idx"] for r in transforms.pool_texts(docs, "doc", F.col("v"), F.col("s"), last=True).collect()}
    assert last == {d: max(k[1] for k in want if k[0] == d) for d in (0, 2, 3, 4)}


def test_texts_that_share_an_id_are_one_text(spark, tmp_path):
    from scoreweave.catalog import vectors

    spark.createDataFrame([(1, "a Bc d"), (1, "Xyz"), (2, "Ab c De"), (None, "q"), (3, None), (4, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["word_idx"]): r["n_pieces"] for r in vectors.pool_subwords(spark, str(tmp_path)).collect()}
    assert got[(2, 1)] == 2 and got[(2, 2)] == 1 and got[(None, 1)] == 1 and got[(4, 1)] == 1
    assert sum(n for (d, _), n in got.items() if d == 1) == 4
    assert {r["doc_id"] for r in vectors.last_subword(spark, str(tmp_path)).collect()} == {1, 2, 4, None}
