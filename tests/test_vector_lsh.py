"""Approximate vector search: recall against the exact form, exact scores, plan without all pairs."""

import numpy as np
from pyspark.sql import functions as F

from seasonframe.operators.retrieval import vector_search
from seasonframe.operators.vector_lsh import bucket_keys, sketch_limit, sketches, vector_search_lsh

SCHEMA = "id long, v array<double>, model string"


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 32))
    docs = [(i, [float(x) for x in centres[i % 60] + rng.standard_normal(32) * 0.3], "m" if i // 60 % 5 else "n") for i in range(1500)]
    asked = [(i, [float(x) for x in centres[i] * 3], "m") for i in range(60)]
    d = spark.createDataFrame(docs, SCHEMA)
    q = spark.createDataFrame(asked, SCHEMA).select(F.col("id").alias("q"), F.col("v").alias("qv"), "model")
    exact = {(r.q, r.id): r.score for r in vector_search(d, "id", "v", q, "q", "qv", 10).collect()}
    found = vector_search_lsh(d, "id", "v", q, "q", "qv", 10)
    got = {(r.q, r.id): r.score for r in found.collect()}
    assert len(set(got) & set(exact)) >= 0.9 * len(exact)
    assert all(got[k] == exact[k] for k in set(got) & set(exact))
    # Every join is on a bucket or an id.
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert len(joins) == 3 and all("_key" in x or "(id#" in x or "(q#" in x for x in joins)


def test_near_vectors_meet_and_strangers_do_not():
    rng = np.random.default_rng(5)

    def meet(cosine):
        a, b = rng.standard_normal((2, 2000, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        b = cosine * a + np.sqrt(1 - cosine ** 2) * b
        return (bucket_keys(a, 16, 8, 1.2, 12) == bucket_keys(b, 16, 8, 1.2)).any(axis=(1, 2)).mean()

    assert meet(0.98) > 0.999 and meet(0.9) > 0.98 and meet(0.0) < 0.05


def test_odd_vectors(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0], "m"), (2, [0.0, 0.0], "m"), (3, None, "m"), (4, [1.0, 0.0, 0.0], "m"), (5, [1.0, 0.0], None), (6, [2.0, 0.0], "m")], SCHEMA)
    q = spark.createDataFrame([(9, [3.0, 0.0], "m"), (10, None, "m")], SCHEMA).select(F.col("id").alias("q"), F.col("v").alias("qv"), "model")
    out = [(r.q, r.id, r.score, r["rank"]) for r in vector_search_lsh(d, "id", "v", q, "q", "qv", 5, threshold=0.5).collect()]
    assert sorted(out) == [(9, 1, 1.0, 1), (9, 6, 1.0, 2)]
    assert vector_search_lsh(d.limit(0), "id", "v", q, "q", "qv", 5).count() == 0


def test_a_threshold_keeps_strangers_of_a_bucket_out_of_the_pairs(spark):
    rng = np.random.default_rng(6)

    def differing(cosine):
        a, b = rng.standard_normal((2, 4000, 32))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = cosine * a + np.sqrt(1 - cosine ** 2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        return np.bitwise_count((sketches(a * 3) ^ sketches(b)).view(np.uint64)).sum(axis=1)

    assert (differing(0.9) <= sketch_limit(0.9)).all() and (differing(0.0) <= sketch_limit(0.9)).mean() < 0.01
    assert sketch_limit(1.0) == 0 and sketch_limit(0.2) < sketch_limit(0.05) <= 128

    centres = rng.standard_normal((40, 32))
    rows = [(i, [float(x) for x in centres[i % 40] + rng.standard_normal(32) * 0.15], "m") for i in range(400)]
    rows += [(400, [float("nan")] * 32, "m"), (401, [1e-170] * 32, "m"), (402, [0.0] * 32, "m"), (403, [1.0] * 32, "m"), (404, [1e200] * 32, "m")]
    d = spark.createDataFrame(rows, SCHEMA)
    q = d.select(F.col("id").alias("q"), F.col("v").alias("qv"), "model")
    found = vector_search_lsh(d, "id", "v", q, "q", "qv", 500, threshold=0.9)
    plain = vector_search_lsh(d, "id", "v", q, "q", "qv", 500).where("score >= 0.9")
    kept = lambda rows: sorted((r.q, r.id, str(r.score), r["rank"]) for r in rows.collect())
    assert kept(found) == kept(plain)
    # The join of the buckets itself drops them.
    assert any("_key" in x and "bit_count" in x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x)
