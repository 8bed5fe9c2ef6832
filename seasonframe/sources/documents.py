"""Reader for text documents with a `---` header block."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys a document header must have, and the heading that ends the body.
REQUIRED_KEYS = [
    "id", "title", "source", "url", "published_at", "fetched_at", "players", "teams", "season",
    "document_type", "storyline", "content_mode",
]
SOURCE_NOTE = "\n# Source note"


class ParsedDocs(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def parse_frontmatter(docs: DataFrame, text: str) -> ParsedDocs:
    """Split header and body; a header value that parses as JSON string is unquoted, others stay text.

    Documents without a header, with a header line that has no colon or with a missing key are
    rejected with the reason.
    """
    parts = F.split(F.col(text), "---", 3)
    lines = F.filter(F.split(F.get(parts, 1), "\r\n|\n|\r"), lambda x: F.trim(x) != "")
    well_formed = F.forall(lines, lambda x: x.contains(":"))
    entries = F.transform(F.filter(lines, lambda x: x.contains(":")), lambda x: F.struct(
        F.trim(F.substring_index(x, ":", 1)).alias("key"),
        F.trim(F.substring(x, F.locate(":", x) + 1, F.length(x))).alias("value")))
    # A later line of the same key wins, as in a dictionary; a fold, so the text is split once.
    none = F.create_map().cast("map<string,string>")
    header = F.aggregate(entries, none, lambda m, e: F.map_concat(
        F.map_filter(m, lambda k, v: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))
    out = docs.withColumns({
        "_ok": F.startswith(F.col(text), F.lit("---")) & (F.size(parts) == 3),
        "_wf": well_formed, "header": header,
        "body": F.trim(F.substring_index(_strip(F.get(parts, 2)), SOURCE_NOTE, 1))})
    missing = F.array_except(F.lit(REQUIRED_KEYS), F.map_keys("header"))
    reason = (
        F.when(~F.col("_ok"), "no header").when(~F.col("_wf"), "bad header line")
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(F.array_sort(missing), ", ")))
    )
    out = out.withColumn("reason", reason)
    typed = out.filter(F.col("reason").isNull()).select(
        *[c for c in docs.columns if c != text],
        *[_scalar(k) for k in REQUIRED_KEYS if k not in ("players", "teams", "season")],
        _scalar("author"), _list("players"), _list("teams"), _list("player_ids"),
        _raw("season").try_cast("int").alias("season"), _strip(F.col("body")).alias("body"))
    return ParsedDocs(typed, out.filter(F.col("reason").isNotNull()).select(
        *[c for c in docs.columns if c != text], "reason"))


def _strip(col: Column) -> Column:
    return F.btrim(col, F.lit(" \t\n\r\f\v"))


def _raw(key: str) -> Column:
    return F.try_element_at(F.col("header"), F.lit(key))


def _scalar(key: str) -> Column:
    raw = _raw(key)
    parsed = F.try_parse_json(raw)
    unquoted = F.when(parsed.isNotNull(), F.try_variant_get(parsed, "$", "string")).otherwise(raw)
    return F.when(raw != "null", unquoted).alias(key)


def _list(key: str) -> Column:
    return F.coalesce(F.from_json(_raw(key), "array<string>"), F.array().cast("array<string>")).alias(key)


def read_frontmatter_docs(spark: SparkSession, glob: str) -> ParsedDocs:
    """Read whole text files, one document each, and parse their headers."""
    files = spark.read.text(glob, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value"))
    return parse_frontmatter(files, "value")
