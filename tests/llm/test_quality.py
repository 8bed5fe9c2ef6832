"""Quality scores: held-out accuracy, what scores may see, missing labels."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from seasonframe.llm.quality import SPACE, classify, features, fit


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = classify(docs.join(labels.select("doc_id"), "doc_id"), labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([r.predicted == r.quality for r in held]) > 0.98
    assert np.mean([g > b for g in good for b in bad]) > 0.99


def test_scores_see_the_text_alone(spark):
    docs = spark.createDataFrame([(1, "clean words here", "en", "a"), (2, "clean words here", "de", "b"), (3, None, None, None), (4, "", "x", "y"), (None, "!! !!", "x", "y")],
                                 "doc_id long, text string, lang string, source string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert len(out) == 5 and out[1].score == out[2].score and out[3].score == out[4].score and out[None].held_out
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in classify(docs, labels).collect()} == {0.5}
    assert classify(docs.limit(0), labels).count() == 0


def test_features_do_not_depend_on_the_slab(monkeypatch):
    from seasonframe.llm import quality
    texts = [b"a b a b", b"", b"A b!! | x", b"  ", b"one", "é é é".encode()] * 3
    whole = features(texts)
    monkeypatch.setattr(quality, "SLAB_BYTES", 5)
    apart = features(texts)
    assert all(np.array_equal(a, b) for a, b in zip(whole, apart)) and whole[1].max() < SPACE


def test_dual_coordinate_descent_meets_its_conditions():
    """At the optimum no single dual variable can improve the objective by much."""
    rng = np.random.default_rng(1)
    rows = [np.unique(np.append(rng.integers(0, 40, 6), rng.integers(50, 60) if k % 3 else rng.integers(60, 70))) for k in range(120)]
    good = np.array([k % 3 > 0 for k in range(120)])
    model = fit(rows, good, passes=500)
    y = np.where(good, 1, -1)
    values = [model.ratio[r] / np.linalg.norm(model.ratio[r]) for r in rows]
    margins = y * np.array([model.weights[r] @ v + model.bias for r, v in zip(rows, values)])
    assert (margins > 0).mean() > 0.95
