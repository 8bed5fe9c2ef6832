"""Readers, writers and the streaming forms, in folders of their own."""

import json

import pytest
from pyspark.sql import functions as F

from seasonframe.operators import incremental as inc
from seasonframe.sources import documents as sd
from seasonframe.sources import provider_json as pj
from seasonframe.sources import tables as st
from seasonframe.streaming import feeds


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_read_table_formats(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    (tmp_path / "a.ndjson").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "a.csv").write_text("a\n1\n2\n")
    for name in ("a.json", "a.ndjson", "a.csv"):
        assert rows(st.read_table(spark, str(tmp_path / name)), "a") == [(1,), (2,)]
    with pytest.raises(ValueError, match="unsupported"):
        st.read_table(spark, str(tmp_path / "a.xlsx"))


def test_historical_snapshot_never_overwrites(spark, tmp_path):
    path = str(tmp_path / "h")
    day = lambda d: spark.createDataFrame([(1, d)], "x int, day string")
    st.write_snapshot(day("2024-01-01"), path, "day", historical=True)
    st.write_snapshot(day("2024-01-02"), path, "day", historical=True)
    with pytest.raises(FileExistsError):
        st.write_snapshot(day("2024-01-02"), path, "day", historical=True)
    assert spark.read.parquet(path).count() == 2


def test_replace_partition_needs_one_season(spark, tmp_path):
    for data in ([(1, 2020), (2, 2021)], [(1, None)], [(1, 2020), (2, None)]):
        with pytest.raises(ValueError):
            st.replace_partition(spark.createDataFrame(data, "x int, season int"), str(tmp_path / "s"), "season")


def test_write_profiled(spark, tmp_path):
    out = st.write_profiled(spark.range(10).toDF("x"), str(tmp_path / "p"), "xs", F.col("x") > 6)
    assert out == {"table": "xs", "columns": ["x"], "n_rows": 10, "n_dropped": 3}


def test_snapshot_chain_checks(spark):
    a, b = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(1,)], "id int")
    with pytest.raises(Exception, match="repeats"):
        st.snapshot_chain([(a, None), (b, None)], "id").collect()
    with pytest.raises(Exception, match="documents found"):
        st.snapshot_chain([(a, 1), (spark.createDataFrame([(2,)], "id int"), 3)], "id").collect()


def test_frontmatter_files(spark, tmp_path):
    head = "\n".join(["id: r1", "title: \"A: b\"", "source: S", "url: u", "published_at: 2024-01-01", "fetched_at: x",
                      "players: [\"P Q\"]", "teams: [\"KC\", \"LV\"]", "season: 2024", "document_type: news", "storyline: s",
                      "content_mode: full"])
    (tmp_path / "a.md").write_text(f"---\n{head}\n---\n\nBody --- text\n\n# Source note\n\nboiler")
    (tmp_path / "b.md").write_text("no header")
    (tmp_path / "c.md").write_text("---\nid r1\n---\nx")
    parsed = sd.read_frontmatter_docs(spark, str(tmp_path / "*.md"))
    r = parsed.accepted.first()
    assert (r["id"], r["title"], r["players"], r["teams"], r["season"], r["body"], r["author"]) == (
        "r1", "A: b", ["P Q"], ["KC", "LV"], 2024, "Body --- text", None)
    assert sorted(x["reason"] for x in parsed.rejected.collect()) == ["bad header line", "no header"]


def test_provider_payloads(spark):
    text = json.dumps({"player_id": 7, "week": "3", "team": "kc", "stats": {"rec": "2", "bad": "x", "n": None},
                       "player": {"first_name": " Kansas ", "last_name": "City", "position": "", "fantasy_positions": ["def"]}})
    df = spark.createDataFrame([(text,), ('{"player": {}}',)], "j string")
    r = pj.projections(df, "j").collect()
    assert len(r) == 1 and (r[0]["display_name"], r[0]["position"], r[0]["week"], r[0]["stats"]) == (
        "Kansas City D/ST", "DEF", 3, {"rec": 2.0})
    bad = spark.createDataFrame([('{"player": {"name": "A", "position": "QB"}, "value": "x"}',)], "j string")
    with pytest.raises(Exception, match="must be an integer"):
        pj.market_values(bad, "j").collect()


def write_batches(spark, batches, schema, path):
    for i, data in enumerate(batches):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_classify_stream(spark, tmp_path):
    schema = "id string, at long, hash string"
    batches = [[("a", 1, "h1"), ("b", 2, "h2"), ("a", 3, "h9"), (None, 4, "h0")], [("a", 5, "h1"), ("b", 6, "h3"), ("c", 7, "h4")]]
    stream = write_batches(spark, batches, schema, str(tmp_path / "in"))
    feeds.classify_stream(stream, str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "cp"), "id", "at", "hash").awaitTermination()
    out = dict(rows(spark.read.parquet(str(tmp_path / "out")).select("at", "change")))
    assert out == {1: "new", 2: "new", 3: "invalid", 4: "invalid", 5: "unchanged", 6: "changed", 7: "new"}


def test_apply_stream_equals_batch(spark, tmp_path):
    schema = "id int, hash string, vec double"
    batches = [[(1, "a", 1.0), (2, "b", 2.0)], [(1, "a", None), (2, "c", None), (3, "d", 3.0)]]

    def to_store(df):
        return inc.ReportStore(
            df.select(F.col("id").alias("report_id"), F.col("hash").alias("content_hash"), F.col("id").alias("first_seen"), F.col("id").alias("last_seen")),
            df.select(F.col("id").alias("report_id"), F.col("hash").alias("source_hash"), F.col("hash").alias("content_hash")),
            df.select(F.col("id").alias("report_id"), F.lit("p").alias("player_id")),
            df.select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), F.col("id").alias("report_id"),
                      F.col("hash").alias("content_hash"), F.col("vec").alias("embedding"), F.when(F.col("vec").isNotNull(), "m").alias("embedding_model")))

    empty = to_store(spark.createDataFrame([], schema))
    stream = write_batches(spark, batches, schema, str(tmp_path / "in"))
    feeds.apply_stream(stream, str(tmp_path / "store"), str(tmp_path / "cp"), to_store, empty).awaitTermination()
    got = feeds.latest_store(spark, str(tmp_path / "store"), empty)
    want = empty
    for data in batches:
        want = inc.apply_documents(want, to_store(spark.createDataFrame(data, schema)))
    for name in inc.ReportStore._fields:
        a, b = getattr(got, name), getattr(want, name)
        assert sorted(map(str, rows(a.select(b.columns)))) == sorted(map(str, rows(b)))
    assert rows(got.chunks.select("chunk_id", "embedding", "embedding_model"), "chunk_id") == [
        ("c1", 1.0, "m"), ("c2", None, None), ("c3", 3.0, "m")]
    assert got.versions.count() == 4


def test_state_change_stream(spark, tmp_path):
    schema = "e string, t timestamp, s string"
    from datetime import datetime

    at = lambda h: datetime(2024, 1, 1 + h // 24, h % 24)
    batches = [[("a", at(1), "Q"), ("a", at(2), "O"), ("b", at(3), "Q")], [("a", at(30), "O"), ("b", at(31), "D")], [("a", at(60), "Q")]]
    stream = write_batches(spark, batches, schema, str(tmp_path / "in"))
    feeds.state_change_stream(stream, str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "cp"), ["e"], "t", ["s"]).awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")).select("e", "previous_s", "s"), "e", "t")
    assert got == [("a", "Q", "O"), ("a", "O", "Q"), ("b", "Q", "D")]


def test_versions_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a")], "id int, h string")
    new = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a")], "id int, h string").withColumn("x", F.lit(1))
    first = st.append_versions(old, new, "id", "h")
    assert rows(first.select("id", "h"), "id", "h") == [(1, "b"), (2, "a")]
    assert st.append_versions(old.unionByName(first.select("id", "h")), new, "id", "h").count() == 0
