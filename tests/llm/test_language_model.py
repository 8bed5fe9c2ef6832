"""LM scores against dictionaries, and the trie against a dictionary."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonframe.llm.elias_fano import EliasFano, Trie, Bits
from seasonframe.llm.language_model import PRIOR, score_documents


@pytest.mark.parametrize("n,contexts,words", [(0, 5, 5), (1, 1, 1), (300, 20, 40), (20000, 700, 5000), (4000, 1, 6000), (64, 64, 1)])
def test_trie(n, contexts, words):
    rng = np.random.default_rng(n)
    key = np.unique(rng.integers(0, contexts * words, n))
    code = rng.integers(1, 65535, len(key)).astype("<u2")
    trie = Trie(key // words, key % words, code, contexts, words)
    asked = np.append(rng.integers(0, contexts * words, 3000), key)
    want = dict(zip(key.tolist(), code.tolist()))
    assert trie.lookup(asked // words, asked % words).tolist() == [want.get(k, 0) for k in asked.tolist()]
    if n == 20000:
        assert trie.bytes / len(key) < 6


@pytest.mark.parametrize("universe", [1, 10, 1000, 1 << 40])
def test_sequence(universe):
    values = np.sort(np.random.default_rng(1).integers(0, universe, 500))
    width, (low, words, ones) = EliasFano.arrays(values, universe)
    sequence = EliasFano(len(values), width, low, Bits(words, ones))
    assert sequence.get(np.arange(500)).tolist() == values.tolist()
    found = sequence.find(values)
    assert (values[found] == values).all()


@pytest.mark.parametrize("batch_bytes", [200, 4_000_000])
def test_scores(spark, batch_bytes):
    rng = random.Random(2)
    rows = [(None, "a b"), (1, None), (2, ""), (3, "A é \t b\n a"), (4, "unseen-" * 3)]
    rows += [(k, " ".join(rng.choice("a b c d e É f".split()) for _ in range(rng.randrange(60)))) for k in range(5, 120)]
    rows += [rows[20], rows[20]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    out = sorted(score_documents(df, batch_bytes=batch_bytes).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))

    def tokens(text):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split() + [None]

    def held(d):
        return d is None or zlib.crc32(str(d).encode()) % 10 == 0

    learned = [tokens(t) for d, t in rows if not held(d)]
    one, two = Counter(w for t in learned for w in t), Counter(p for t in learned for p in zip([None, *t], t))
    total, different = sum(one.values()), len(one)

    def p1(w):
        return (one[w] + 0.1) / (total + 0.1 * (different + 1))

    for r, (d, t) in zip(out, sorted(rows, key=lambda x: (str(x[0]), len(tokens(x[1]))))):
        w = tokens(t)
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d, held(d), len(w), sum(one[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10(p1(x)) for x in w))
        assert r.score == pytest.approx(sum(math.log10((two[a, b] + PRIOR * p1(b)) / (one[a] + PRIOR)) for a, b in zip([None, *w], w)), abs=2e-4 * len(w))


def test_empty(spark):
    assert score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
