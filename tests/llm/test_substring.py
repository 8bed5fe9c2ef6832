"""Substring deduplication against a dictionary of all windows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from seasonframe.llm import substring
from seasonframe.llm.substring import remove_repeats, super_kmers

SCHEMA = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, window):
    least = {}
    for d, t in rows:
        w = words(t)
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i:i + window])
                least[k] = min(least.get(k, d), d)
    out = []
    for d, t in rows:
        w, gone = words(t), set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if least[tuple(w[i:i + window])] < d:
                    gone |= set(range(i, i + window))
        out.append((d if d is not None else -1, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("window,gram,letters", [(13, 3, 3), (4, 2, 2), (5, 5, 6), (3, 1, 4)])
def test_against_all_windows(spark, monkeypatch, window, gram, letters):
    monkeypatch.setattr(substring, "SLAB_BYTES", 300)
    rng = random.Random(window)
    passages = [" ".join(rng.choice("abcdef"[:letters]) for _ in range(rng.randrange(5, 60))) for _ in range(8)]
    rows = [(None, passages[0]), (7, None), (8, ""), (9, "  \t\n"), (10, "a"), (11, " ".join("a" * 40)), (12, "é ü ü " * 30), (13, "é ü ü " * 9)]
    for d in range(14, 70):
        rows.append((rng.randrange(-5, 200) * 100 + d, " \n".join(rng.choice(passages) for _ in range(rng.randrange(4))) + " " + " ".join(rng.choice("abcdef") for _ in range(rng.randrange(30)))))
    rows += [rows[20], (rows[21][0], passages[3])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_id", F.lit("mine")).withColumn("n_words", F.lit("clash")).repartition(4)
    out = remove_repeats(df, window, gram).collect()
    assert all(r._id == "mine" for r in out)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_text) for r in out) == brute(rows, window)


def test_super_kmers_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(substring, "SLAB_BYTES", 50)
    lines = [b"a b c d e f g h a b c d e", b"x y", b"q r s t u v w", b"a a a a a a a a"]
    seen = []
    for minimiser, line, word, words in super_kmers(lines, 5, 2):
        w = words.split()
        seen += [(line, word + i, tuple(w[i:i + 5]), minimiser) for i in range(len(w) - 4)]
    want = [(n, i, tuple(x.split()[i:i + 5])) for n, x in enumerate(lines) for i in range(len(x.split()) - 4)]
    assert sorted(s[:3] for s in seen) == sorted(want)
    by_window = {}
    for _, _, win, m in seen:
        assert by_window.setdefault(win, m) == m


def test_equal_hashes_are_told_apart(monkeypatch):
    import numpy as np
    monkeypatch.setattr(substring.ByteHasher, "ranges", lambda self, s, e: np.zeros(len(s), dtype=np.uint64))
    owners, first = substring.window_owners([b"a b c", b"d e f", b"a b c"], np.array([5, 2, 9]), 3)
    assert owners.tolist() == [5, 2, 5] and first.tolist() == [0, 1, 2, 3]


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
