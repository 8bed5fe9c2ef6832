"""The prefix trie against a plain walk over all prefixes."""

import hashlib
import random
import zlib

import pytest

from seasonframe.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, role, text[:16], digest, text))
    own = {c: [(t[2], t[5]) for t in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full = own.get(c - c % 20, [])[:h] + turns[h:]
        for d in range(len(full) + 1):
            node = nodes.setdefault(tuple(full[:d]), ([], []))
            node[0].append(c)
            if d == len(full):
                node[1].append(c)
    children = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[c] for c in below) or 1
        saved[path] = sum(saved[c] for c in below) + ((len(nodes[path][0]) - 1) * len(path[-1][1].split()) if path else 0)
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]][0]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest()) for p, (m, e) in nodes.items())


def check(spark, rows, **options):
    out = prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()
    key = lambda r: (r[0], r[1], r[7])
    assert sorted(map(tuple, out), key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("slab_turns", [1, 3, 20, 200_000])
def test_shared_openings_copies_and_long_conversations(spark, slab_turns):
    rng = random.Random(slab_turns)
    rows = []
    for conv in range(240):
        kind = rng.random()
        n = 0 if kind < 0.05 else 40 if kind < 0.07 else rng.randint(1, 6)
        # Every third conversation is a copy; the others share openings.
        seed = random.Random(1 if conv % 3 == 0 else rng.randint(0, 60))
        for turn in range(3 if conv % 3 == 0 else n):
            rows.append((conv, turn, seed.choice(["user", "assistant"]), " ".join(seed.choice("abc") for _ in range(seed.randint(0, 3)))))
    check(spark, rows, slab_turns=slab_turns)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a b"), (1, 0, "user", "a b"), (1, 0, "user", "a"), (2, 5, "us", "era"), (3, 5, "user", "a"),
            (None, 1, "user", "lost"), (20, 1, "x", "1 2 3"), (20, 2, "x", ""), (20, 3, "y", "\t \n"), (21, 1, "x", "own"), (22, 9, "z", "w " * 5000),
            (39, 0, "a", "b"), (39, 1, "a", "c"), (39, 2, "a", "d"), (39, 3, "a", "e"), (10 ** 15, 1, "far", "away")]
    check(spark, rows)
    check(spark, rows, slab_turns=1)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS path", "2 AS family", "3 AS t", "4 AS depth")
    assert prefix_trie(df).count() == len(brute(rows))


def test_empty(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0
