"""SimHash fingerprints and links against plain loops."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seasonframe.llm.simhash import chain_masks, linked, links, near_duplicates, one_of_each, spanning


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs, distance=3):
    """pairs: (name, fingerprint)"""
    names = [n for n, _ in pairs]
    label = list(range(len(pairs)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= distance:
                label[find(i)] = find(j)
    least = {}
    for i, n in enumerate(names):
        least[find(i)] = min(least.get(find(i), n), n)
    return [least[find(i)] for i in range(len(pairs))]


def test_documents(spark):
    rng = random.Random(5)
    rows = [(0, "A b C"), (1, "a B c"), (2, None), (3, ""), (4, " \t"), (5, "one"), (6, "one two"), (7, "É é x y"), (8, "x " * 3000)]
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(200)) for _ in range(15)]
    for k in range(9, 90):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = f"v{k}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash")).repartition(3)
    got = {r.doc_id: r for r in near_duplicates(df).collect()}
    fps = [(d, slow_fingerprint(t)) for d, t in rows]
    for (d, f), c in zip(fps, slow_components(fps)):
        assert (got[d].fingerprint, got[d].component_id, got[d].kept) == (f"{f:016x}", c, c == d)
    assert len(got) == len(rows)


@pytest.mark.parametrize("distance", [1, 2, 3, 5])
@pytest.mark.parametrize("cell", [20, 4096])
def test_links_connect_exactly_the_close(spark, distance, cell):
    rng = random.Random(distance)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for _ in range(rng.randrange(8)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    pairs = list(enumerate(sorted(fps)))
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in pairs]
    edges = links(spark.createDataFrame(signed, "id long, fingerprint long"), distance, cell).collect()
    by_id = dict(pairs)
    assert all((by_id[e.a] ^ by_id[e.b]).bit_count() <= distance for e in edges)
    label = {i: i for i, _ in pairs}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for e in edges:
        a, b = find(e.a), find(e.b)
        label[max(a, b)] = min(a, b)
    assert [find(i) for i, _ in pairs] == slow_components(pairs, distance)


def test_chain_budgets_prune_only_what_another_chain_finds():
    rng = np.random.default_rng(2)
    for _ in range(300):
        x = rng.integers(0, 1 << 63, dtype=np.uint64)
        y = x
        for b in rng.choice(64, int(rng.integers(0, 6)), replace=False):
            y = y ^ (np.uint64(1) << np.uint64(b))
        close = int(np.bitwise_count(x ^ y)) <= 3
        assert close == any(len(linked(x, np.array([y]), chain_masks(3, i))) for i in range(4))


def test_block_cells_skip_rows_of_one_side():
    fps = np.array([0, 1, 3], dtype=np.uint64)
    assert spanning(fps, np.array([1, 1, 1]), chain_masks(3, 1)) == ([], [])
    assert len(spanning(fps, np.array([1, 2, 1]), chain_masks(3, 1))[0]) == 2


def test_null_ids_repeats_and_empty_table(spark):
    schema = "doc_id long, text string"
    out = near_duplicates(spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "p q r s t")], schema)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in out) == [(-1, -1, True), (-1, 4, False), (4, 4, True), (4, 4, True)]
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_a_repeated_id_links_no_strangers(spark):
    rows = [(1, "a b c d e"), (1, "p q r s t"), (2, "a b c d e"), (3, "p q r s t")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {(r.doc_id, r.fingerprint): r.component_id for r in near_duplicates(df).collect()}
    assert len({f for _, f in prints}) == 2 and set(prints.values()) == {1}
    assert sorted((r.doc_id, r.text) for r in one_of_each(df).collect()) == [(1, "a b c d e"), (1, "p q r s t")]
    apart = spark.createDataFrame([(1, "a b c d e"), (1, "p q r s t"), (0, "a b c d e"), (3, "p q r s t")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(apart).collect() if r.doc_id != 1} == {0: 0, 3: 1}
