"""The pipeline's stages against brute force on the smallest table, and the registration."""

import corpus_pipeline
from seasonframe.llm.common import written
from seasonframe.llm.quality import classify
from seasonframe.llm.queries import QUERIES, load_all

from test_decontamination import words
from test_simhash import slow_components, slow_fingerprint
from test_substring import brute as slow_repeats

SF = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    load_all()
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert len(QUERIES) == 13 and len(corpus_pipeline.STAGES) == 5


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = written(stages["quality classifier"](spark, docs, SF))
    scored = classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in scored if r.predicted == 1)

    rows = sorted((r.doc_id, r.text) for r in good.collect())
    single = written(stages["SimHash near-dedup"](spark, good, SF))
    names = slow_components([(d, slow_fingerprint(t)) for d, t in rows])
    assert sorted(r.doc_id for r in single.collect()) == [d for (d, _), c in zip(rows, names) if c == d]

    before = sorted((r.doc_id, r.text) for r in single.collect())
    cut = written(stages["substring dedup"](spark, single, SF))
    after = {r.doc_id: r for r in cut.collect()}
    for (d, _, removed, text), (_, whole) in zip(slow_repeats(before, 13), before):
        assert after[d].text == (text if removed else whole) and after[d].n_chars == len(after[d].text)

    clean = written(stages["benchmark decontamination"](spark, cut, SF))
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    marks = {f" {' '.join(w[i:i + min(10, len(w))])} " for w in items for i in range(max(1, len(w) - 9)) if w}
    assert {r.doc_id for r in clean.collect()} == {
        d for d, r in after.items() if not any(m in f" {' '.join(words(r.text))} " for m in marks)}

    last = stages["mixing sources"](spark, clean, SF).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in clean.collect()}
    assert all(r.size == len(after[r.doc_id].text.split()) for r in last)
    for frame in (good, single, cut, clean):
        assert frame.columns == docs.columns


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and {"doc_id", "taken", "target", "first_position"} <= set(out[0].asDict())
    assert corpus_pipeline.ORACLE_SQL is None


SCHEMA = "doc_id long, text string, lang string, source string, score string, n_words string, kept_text int, spans double, n_hit int"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, f"s{k}", f"w{k}", k, k / 2, -k) for k, (i, t, s) in enumerate(rows)], SCHEMA)


def test_stages_keep_columns_nulls_and_clean_rows(spark):
    """Columns named like an operator's own, no n_chars, null ids, texts and sources, repeated rows and ids."""
    long = " ".join(f"word{k}" for k in range(40))
    rows = [(1, long, "a"), (1, long, "a"), (2, "before " + long + " after", "b"), (3, None, None), (4, "", "a"), (None, "one two three four", None),
            (5, "some other words of its own here", "b"), (5, "an id with another text altogether, not like it", "b")]
    docs = odd(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    every = {tuple(r) for r in docs.collect()}
    for name in ("quality classifier", "SimHash near-dedup", "benchmark decontamination"):
        out = stages[name](spark, docs, SF)
        assert out.schema == docs.schema and {tuple(r) for r in out.collect()} <= every
    single = [(r.doc_id, r.text) for r in stages["SimHash near-dedup"](spark, docs, SF).collect()]
    assert sorted(single, key=str) == sorted([
        (1, long), (2, "before " + long + " after"), (3, None), (None, "one two three four"),
        (5, "some other words of its own here"), (5, "an id with another text altogether, not like it")], key=str)
    cut = stages["substring dedup"](spark, docs, SF)
    assert cut.schema == docs.schema
    text = {(r.doc_id, r.score): r.text for r in cut.collect()}
    assert text[2, "s2"] == "before after" and text[3, "s3"] is None and text[1, "s0"] == long and len(text) == len(rows)
    clean = stages["benchmark decontamination"](spark, docs, SF)
    assert clean.count() == len(rows)
    assert stages["mixing sources"](spark, docs, SF).count() == len(rows)
    for stage in stages.values():
        assert stage(spark, docs.limit(0), SF).count() == 0
