"""Benchmark leaks against a direct search, and spans of the original text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from seasonframe.llm.decontamination import find_leaks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item_id, item in items:
        v = words(item)
        if item_id is None or not v:
            continue
        n = min(10, len(v))
        for win in {tuple(v[i:i + n]) for i in range(len(v) - n + 1)}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) == win:
                    hit |= set(range(i, i + n))
                    found.add(str(item_id))
    return len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    vocabulary = ["über", "a", "B", "c3", "d d", "E", "f", "naïve", "x_y", "z"]
    items = [(k, "  ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 9, 10, 11, 25])))) for k in range(12) if k != 1]
    items += [(1, "Über-A"), (50, None), (51, "!!"), (None, "a"), (3, items[2][1]), (3, items[2][1])]
    docs = [(None, "x"), (1, None), (2, ""), (3, "..."), (4, "über a"), (5, "Über,\nA! über a")]
    for k in range(6, 40):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(80)))
        item = rng.choice(items)[1] or ""
        docs.append((k, f"{text}; {item.upper() if rng.random() < .3 else item}.\t{text}"))
    docs.append(docs[-1])
    return docs, items


@pytest.mark.parametrize("bound", [4_000_000, 600])
def test_against_direct_search(spark, data, bound):
    docs, items = data
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash")).withColumn("other", F.lit(7))
    out = find_leaks(df, spark.createDataFrame(items, "item_id long, text string"), automaton_bytes=bound).collect()
    assert sorted((str(r.doc_id), r.text or "", r.n_words, r.n_hit, r.item_ids) for r in out) == \
        sorted((str(d), t or "", *brute(t, items)) for d, t in docs)
    for r in out:
        assert r.other == 7 and r.contaminated == (r.n_hit > 0)
        covered = set()
        for s in r.spans:
            part = r.text[s.start:s.end]
            item = next(i for i in items if str(i[0]) == s.item_id and " ".join(words(part)) in " ".join(words(i[1])))
            assert len(words(part)) == min(10, len(words(item[1])))
            covered |= set(range(s.start, s.end))
        assert bool(covered) == r.contaminated


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in find_leaks(docs, none).collect()] == [(2, 0)]
    assert find_leaks(docs.limit(0), none).count() == 0
