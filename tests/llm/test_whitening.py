"""Whitening against exact fractions and a dense reference, and the eigen solver on hard spectra."""

from fractions import Fraction

import numpy as np
import pytest

from seasonframe.llm.eigen import HIGH, symmetric_eigen
from seasonframe.llm.whitening import carried, products, whiten

SCHEMA = "vec_id long, embedding array<double>, label int"


def basis(n, seed):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))[0].astype(HIGH)
    for _ in range(3):
        q = q + q @ (np.eye(n) - q.T @ q) / 2
    return q


@pytest.mark.parametrize("values", [
    np.linspace(1, 100, 40), np.r_[np.linspace(1, 2, 9), 1.5 + 1e-9 * np.arange(1, 6)], np.r_[1 + 1e-13 * np.arange(5), 2.0, 3.0],
    np.r_[1 + 1e-8 * np.arange(3), 1 + 1e-5 + 1e-12 * np.arange(4), 2.0], np.r_[np.ones(6), np.zeros(6), 2.0], 10.0 ** -np.arange(12), np.array([3.0])])
def test_eigenvectors_beyond_double_precision(values):
    n = len(values)
    q = basis(n, 3)
    a = (q * values.astype(HIGH)) @ q.T
    a = (a + a.T) / 2
    value, vector = symmetric_eigen(a)
    size = np.abs(values).max()
    assert np.abs(value - np.sort(values.astype(HIGH))[::-1]).max() < 1e-17 * size
    assert np.abs(vector.T @ vector - np.eye(n)).max() < 1e-17
    assert np.abs(a @ vector - vector * value).max() < 1e-17 * size


def test_products_are_exact():
    rng = np.random.default_rng(0)
    for most in (5, 1 << 20, 1 << 40, 1 << 55):
        y = rng.integers(-most, most, (50, 4))
        planes = carried(products(y), 1 << 40)
        got = sum(p.astype(object) << (21 * i) for i, p in enumerate(planes))
        assert (got == y.astype(object).T @ y.astype(object)).all()


def reference(vectors, k):
    """n, deviations, eigenvalues, projector per eigenvalue group and trace, from exact fractions."""
    x = [[int(np.floor(64 * float(c))) + 1000000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    far = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    cov = np.array([[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n ** 3)) for j in range(d)] for i in range(d)])
    value, vector = np.linalg.eigh(cov)
    centred = np.array([[float(Fraction(n * r[j] - s[j], n)) for j in range(d)] for r in x])
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    return n, far, value, centred @ vector, np.trace(cov)


def check(spark, rows, k=5):
    good = [(i, v) for i, v, _ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    n, far, value, projected, trace = reference([v for _, v in good], k)
    out = {r.vec_id: r for r in whiten(spark.createDataFrame(rows, SCHEMA).repartition(3), components=k).collect()}
    assert sorted(out) == sorted(i for i, _ in good)
    order = [i for i, _ in good]
    got = np.array([out[i].whitened for i in order], dtype=float)
    for c in range(got.shape[1]):
        want = projected[:, c] / np.sqrt(value[c])
        assert min(np.abs(got[:, c] - want).max(), np.abs(got[:, c] + want).max()) < 1e-8
        assert out[order[0]].explained[c] == pytest.approx(value[c] / trace, rel=1e-9)
    assert [int(out[i].deviation) for i in order] == far
    assert {r.n for r in out.values()} == {n} and all(r.identity_error < 1e-9 for r in out.values())


def test_against_fractions(spark):
    rng = np.random.default_rng(5)
    scale = np.array([4, 2, 1.5, 1, 0.5, 0.3, 3.0])
    rows = [(i, [float(c) for c in rng.standard_normal(7) * scale + 2], 0) for i in range(300)]
    check(spark, rows)
    check(spark, [(i, [c * 1e9 for c in v], 0) for i, v, _ in rows[:60]])


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in rng.standard_normal(3)], None) for i in range(40)]
    rows += [(100, None, 1), (101, [None, 1.0, 2.0], 1), (102, [float("nan"), 1.0, 2.0], 1), (103, [float("inf"), 1.0, 2.0], 1)]
    check(spark, rows, 3)
    # Another length and entries beyond 64 bits go; repeated and null ids stay.
    more = rows[:40] + [(200, [1.0], 1), (201, [], 1), (202, [1e300, 0.0, 0.0], 1), (None, [0.5, 0.5, 0.5], 1), (1, [0.1, 0.2, 0.3], 1)]
    df = spark.createDataFrame(more, SCHEMA).selectExpr("*", "1 AS whitened", "2 AS n", "3 AS place", "4 AS size")
    out = whiten(df).collect()
    assert len(out) == 42 and out[0].n == 42 and len(out[0].whitened) == 3


def test_without_variance(spark):
    out = whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [3.0, 2.0], 0)], SCHEMA)).orderBy("vec_id").collect()
    assert [[abs(r.whitened[0]), r.whitened[1]] for r in out] == [[1.0, None]] * 2 and out[0].explained == [1.0, 0.0]
    one = whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)).collect()
    assert [(r.whitened, r.explained, int(r.deviation), r.identity_error) for r in one] == [([None, None], [None, None], 0, 0.0)]
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, None, 0), (2, [], 0)], SCHEMA)).count() == 0


def test_query(spark):
    from seasonframe.llm.queries import QUERIES, load_all
    load_all()
    sf = "/root/testdata/sf0.001"
    out = QUERIES["op11_embedding_whitening"](spark, sf).toPandas()
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    n, far, value, projected, trace = reference([r.embedding for r in rows], 32)
    assert len(out) == 32 * n and set(out.component) == set(range(1, 33)) and out.identity_error.max() < 1e-9
    wide = out.pivot(index="vec_id", columns="component", values="whitened")
    for c in range(32):
        want = projected[:, c] / np.sqrt(value[c])
        assert min(np.abs(wide[c + 1].to_numpy() - want).max(), np.abs(wide[c + 1].to_numpy() + want).max()) < 1e-8
    assert out.drop_duplicates("vec_id").sort_values("vec_id").deviation.tolist() == far
