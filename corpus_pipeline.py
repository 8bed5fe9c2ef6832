"""Corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, and the mix of sources.

Each stage takes (spark, docs, sf_dir), works on all rows of `docs` and returns a DataFrame; all but the last
return the columns of `docs`. Stages keep no state: what one decides is what the next one reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonframe.llm.common import table, unused, written
from seasonframe.llm.decontamination import find_leaks
from seasonframe.llm.mixing import mix
from seasonframe.llm.quality import classify
from seasonframe.llm.simhash import one_of_each
from seasonframe.llm.substring import remove_repeats


def beside(docs: DataFrame, added: tuple[str, ...], operator: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, dict[str, str]]:
    """What an operator makes of `docs`, and under which name it has each of their columns: one that is named like a
    column the operator adds goes through it under a name of its own."""
    names = {c: unused(c) if c.lower() in added else c for c in docs.columns}
    return operator(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])), names


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, all columns as they were. Null and empty texts have the score
    of a text without features; repeated rows are judged alike; an empty table stays empty."""
    scored, names = beside(docs, ("held_out", "score", "predicted"), lambda d: classify(d, table(spark, sf_dir, "labels")))
    return scored.where("predicted = 1").select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies, all columns as they were: the one with the smallest id, rows
    without an id last. Rows that repeat one another are near-copies too, so one of them stays; so are all null
    and empty texts. Rows that share an id but not a text are different documents. An empty table stays empty.

    Near means op5's rule: fingerprints of three-word shingles that differ in at most 3 of 64 bits. It misses most
    copies whose five-word shingles have a Jaccard similarity from 0.8 to under 1 (README has the share)."""
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents of smaller ids have; untouched texts stay as they are, nulls
    included. A document that is left without words stays as a row with an empty text; n_chars, where there is such
    a column, follows the text. Rows without an id lose nothing and rows of one id lose nothing to each other; an
    empty table stays empty."""
    found, names = beside(docs, ("n_words", "n_removed", "kept_text"), remove_repeats)
    cut = F.col("n_removed") > 0
    changed = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length("kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[changed.get(c, F.col(f"`{n}`")).alias(c) for c, n in names.items()])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item, all columns as they were. Null and empty texts have no
    words and stay; repeated rows are judged alike; an empty table stays empty."""
    found, names = beside(docs, ("n_words", "n_hit", "item_ids", "spans", "contaminated"),
                          lambda d: find_leaks(d, table(spark, sf_dir, "benchmark")))
    return found.where("not contaminated").select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often and where in training each document is read, in training order; documents that the mix does
    not take come first, with no position. Null and empty texts are among those; repeated rows tie; an empty table
    stays empty; further columns of the documents are ignored."""
    mixed = mix(docs).withColumn("first_position", F.get("positions", F.lit(0)))
    return mixed.orderBy("first_position", "doc_id")


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_copies),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources", source_mix),
]

# The classifier is no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
