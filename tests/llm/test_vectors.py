"""Vector near-duplicates against all pairs."""

import math

import numpy as np
import pytest

from seasonframe.llm.vectors import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    usable = {}
    for k, (vec_id, v, label) in enumerate(rows):
        if vec_id is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable[k] = np.array(v, dtype=np.float32).astype(np.float64)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    keys = list(usable)
    for n, i in enumerate(keys):
        for j in keys[n + 1:]:
            a, b = usable[i], usable[j]
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= 0.98:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    names = {}
    for i in usable:
        names[find(i)] = min(names.get(find(i), rows[i][0]), rows[i][0])
    return sorted((r[0] if r[0] is not None else -1, links[k], (names[find(k)] if k in usable else r[0]) or -1) for k, r in enumerate(rows))


def check(spark, rows, **options):
    out = near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4), **options).collect()
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id or -1) for r in out) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


@pytest.mark.parametrize("cell", [7, 1024])
def test_groups_copies_and_chains(spark, cell):
    rng = np.random.default_rng(1)
    rows, n = [], 1
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 12))):
                v = (centre + rng.standard_normal(16) * rng.choice([0, 0.05, 0.12, 0.3])).astype(np.float32)
                rows.append((n, [float(x) for x in v * rng.choice([1, 5])], label))
                n += 1
    angle = np.deg2rad(np.arange(0, 60, 8))
    rows += [(n + i, [float(np.cos(a)), float(np.sin(a))], 5) for i, a in enumerate(angle)]
    check(spark, rows, cell=cell)


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, None, 1), (3, [], 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1),
            (7, [float("inf"), 1.0], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 2), (10, [1.0, 0.0, 0.0], 1), (11, [3.0, 0.0], 1),
            (12, [1e30, 1e25], 1), (13, [-0.0, 1.0], 1), (14, [0.0, 1.0], 1), (None, [1.0, 0.0], 1), (16, [1.0, 0.0], 1)]
    check(spark, rows)


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_labels_of_any_type(spark):
    v = [1.0, 0.5]
    for kind, labels in (("double", [0.2, 0.7, 0.2]), ("string", ["a", "b", "a"]), ("struct<x:int,y:string>", [(1, "a"), (1, "b"), (1, "a")])):
        df = spark.createDataFrame([(i, v if i else [1.0, 0.51], x) for i, x in enumerate(labels)], f"vec_id long, embedding array<float>, label {kind}")
        out = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df).collect()}
        assert out == {0: (1, 0), 1: (0, 1), 2: (1, 0)}
