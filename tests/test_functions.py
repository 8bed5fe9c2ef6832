"""Column expressions against hand values and the standard library."""

import html
import uuid
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from seasonframe.functions import scalars as S
from seasonframe.functions.formulas import FormulaError, compile_formula


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, a, b, value, status", [
    ("a / b", 6.0, 3.0, 2.0, None),
    ("a / b", 6.0, 0.0, None, "zero"),
    ("a / b", None, 0.0, None, "invalid"),
    ("b / (a - a) + b", 1.0, 2.0, None, "zero"),
    ("(a / b) / b", None, 0.0, None, "invalid"),
    ("1 / (b - b) + a", None, 1.0, None, "zero"),
    ("-a + +b * 2", 1.0, 2.0, 3.0, None),
    ("a * b", 1e200, 1e200, None, "invalid"),
])
def test_formula(spark, text, a, b, value, status):
    f = compile_formula(text, ["a", "b"])
    df = spark.createDataFrame([(a, b)], "a double, b double").select(f.value.alias("v"), f.status.alias("s"))
    assert tuple(df.first()) == (value, status)


@pytest.mark.parametrize("text", [
    "", "1 + 2", "a ** 2", "a % b", "__import__('os')", "c + a", "a if b else a", "a + True", "a +",
    "a" + " + a" * 60, "((((((((((a+1)+1)+1)+1)+1)+1)+1)+1)+1)+1)", "a < b", "'x' + a",
])
def test_formula_rejects(text):
    with pytest.raises(FormulaError):
        compile_formula(text, ["a", "b"])


def test_formula_fields():
    assert compile_formula(" b/a + b ", ["a", "b"]).fields == ("a", "b")


def test_snake(spark):
    assert one(spark, S.snake_pick(F.lit(2), F.lit(10), F.lit(12))) == 15
    assert tuple(one(spark, S.snake_coordinates(F.lit(15), F.lit(12)))) == (2, 10)


def test_boundaries(spark):
    points = one(spark, S.linear_boundaries(F.lit(1130), F.lit(4632)))
    assert (points[0], points[-1], len(points)) == (1475, 4100, 17)
    assert all(p % 25 == 0 for p in points) and points == sorted(set(points))
    bounds = F.array(*[F.lit(850 + 25 * i) for i in range(17)])
    for value, band in [(849.9, 0), (850.0, 1), (1025.0, 8), (1249.9, 16), (1250.0, 17)]:
        assert one(spark, S.band_by_boundaries(F.lit(value), bounds)) == band
    with pytest.raises(Exception, match="strictly increase"):
        one(spark, S.linear_boundaries(F.lit(1), F.lit(30)))


def test_stable_id_is_uuid5(spark):
    ns = "f0cf9ef7-d56d-4a6f-a8e1-197be003c7a8"
    names = ["00-0033873", "é", "", "x" * 200]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(S.stable_id(F.col("n"), ns, "gsis")).collect()
    assert [r[0] for r in got] == [str(uuid.uuid5(uuid.UUID(ns), f"gsis:{n}")) for n in names]


class Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts = []

    def handle_data(self, data):
        self.parts.append(data)


def expected_text(source):
    parser = Text()
    parser.feed(source)
    parser.close()
    return " ".join("".join(parser.parts).split())


def test_clean_html_hand(spark):
    source = "<p>A &amp; B&nbsp;&#233; &lt;i&gt;</p><!-- x --><br/>C  D <b>View Fantasy Impact »</b> "
    assert one(spark, S.clean_html_text(F.lit(source))) == html.unescape("A & B é <i>C D")


def test_clean_html_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(
        "html", S.clean_html_text(F.col("html"), None).alias("text")).collect()
    assert pages
    for row in pages:
        assert row["text"] == expected_text(row["html"])


@pytest.mark.parametrize("name, mode, key", [
    ("A.J. Brown", "ascii", "aj brown"), ("De'Von  Achane", "ascii", "devon achane"),
    ("José Núñez-Ruiz Jr.", "no_suffix", "jose nunez ruiz"), ("Odell Beckham III", "surname", "beckham"),
    ("Ronaldo", "surname", None), ("St. John's!", "compact", "stjohns"), ("A.J. Brown", "spaced", "a j brown"),
])
def test_name_keys(spark, name, mode, key):
    assert one(spark, S.name_key(F.lit(name), mode)) == key


def test_weighted_points(spark):
    stats = S.literal_map({"rec": 5.0, "yds": 100.0, "pts_ppr": 9.0, "pts_half_ppr": 7.0, "pts_std": 5.0})
    cases = [({"rec": 0.5, "yds": 0.1, "td": 6.0}, 12.5), ({"td": 6.0}, 5.0)]
    for weights, points in cases:
        assert one(spark, S.weighted_points(stats, S.literal_map(weights))) == points
    bare = S.literal_map({"pts_ppr": 9.0, "pts_half_ppr": 7.0, "pts_std": 5.0})
    for rec, points in [(1.0, 9.0), (0.75, 9.0), (0.5, 7.0), (0.1, 5.0)]:
        assert one(spark, S.weighted_points(bare, S.literal_map({"rec": rec}))) == points


def test_kickoff(spark):
    day = F.lit("2025-09-07").cast("date")
    for text in ("13:00", "13:00:00", "1:00PM", " 1:00 pm"):
        assert str(one(spark, S.kickoff_utc(day, F.lit(text)))) == "2025-09-07 17:00:00"
    assert one(spark, S.kickoff_utc(day, F.lit("noon"))) is None


def test_season_of(spark):
    for day, season in [("2025-02-28", 2024), ("2025-03-01", 2025), ("2025-12-31", 2025), ("2024-02-29", 2023)]:
        assert one(spark, S.season_of(F.lit(day).cast("date"))) == season


def test_urls(spark):
    for url, key in [("HTTPS://Ex.COM/A/b/?q=1#f", "https://ex.com/A/b?q=1"), ("http://x.org", "http://x.org/"),
                     ("http://x.org///", "http://x.org/"), (" http://x.org/a?b=/c/ ", "http://x.org/a?b=/c/")]:
        assert one(spark, S.normalize_url(F.lit(url))) == key


def test_status(spark):
    for text, code in [(" out ", "O"), ("Injured Reserve", "IR"), ("NFI", "NFI"), ("day-to-day", "DAY-TO-DAY"), ("  ", None), (None, None)]:
        assert one(spark, S.status_code(F.lit(text).cast("string"))) == code


def test_content_hash(spark):
    a, b = '{"b": [1, {"y": 2, "x": 1}], "a": "é"}', '{"a":"é","b":[1,{"x":1,"y":2}]}'
    assert one(spark, S.content_hash(F.lit(a))) == one(spark, S.content_hash(F.lit(b)))
    assert one(spark, S.content_hash(F.lit(a))) != one(spark, S.content_hash(F.lit('{"a":"e"}')))


def test_snippet_and_bounded(spark):
    assert one(spark, S.snippet(F.lit("# T\n\n- one\n  two \n - three\n"))) == "one two - three"
    assert one(spark, S.bounded(F.lit("a  b\n" + "c" * 20), 10)) == "a b ccc..."
    assert one(spark, S.bounded(F.lit("short"), 10)) == "short"


def test_settings(spark):
    slots = lambda *s: F.array(*[F.lit(x) for x in s])
    assert one(spark, S.two_quarterback(slots("QB", "SUPER_FLEX")))
    assert one(spark, S.two_quarterback(slots("QB", "RB", "QB")))
    assert not one(spark, S.two_quarterback(slots("QB", "RB")))
    assert [one(spark, S.scoring_class(F.lit(x))) for x in (1.0, 0.75, 0.5, 0.25, 0.2)] == [
        "ppr", "ppr", "half_ppr", "half_ppr", "standard"]


def test_can_fill(spark):
    fill = lambda group, current, locked, out: one(spark, S.can_fill(
        F.lit("FLEX"), F.lit("FLEX1"), F.array(F.lit("RB"), F.lit("FLEX")), F.lit(group), F.lit(current),
        F.lit(locked), F.lit(out)))
    assert fill("bench", None, False, False) and not fill("bench", None, False, True)
    assert fill("starter", "FLEX1", True, True) and not fill("starter", "RB1", True, False)
    assert not fill("taxi", None, False, False)
