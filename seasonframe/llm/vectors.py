"""Embedding near-duplicates: Euclidean p-stable hashing with quantised random projections, exact cosine checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonframe.llm.cells import forest, grouped, whole_groups
from seasonframe.llm.common import mix64, written
from seasonframe.llm.components import block_pairs, components

THRESHOLD = 0.98

# Hash tables, projections per table and quantisation width. Two unit vectors at cosine 0.98 are 0.2 apart and
# share one projection's step with probability 0.92, a whole table with 0.51, some table with 1 - 3e-8; unrelated
# ones share a table with 0.003.
TABLES = 24
PROJECTIONS = 8
STEP = 2.0
SEED = 7

# Vectors of one bucket that one task compares with each other.
CELL = 1024


def codes(unit: np.ndarray, tables: int = TABLES, projections: int = PROJECTIONS, step: float = STEP) -> np.ndarray:
    """A 32-bit bucket number per vector and table: the quantised projections of that table, mixed."""
    rng = np.random.default_rng(SEED)
    directions = rng.standard_normal((unit.shape[1], tables * projections))
    shift = rng.uniform(0, step, tables * projections)
    cells = np.floor((unit @ directions + shift) / step).astype(np.int64).reshape(len(unit), tables, projections)
    out = np.zeros((len(unit), tables), dtype=np.uint64)
    for p in range(projections):
        out = mix64(out + cells[:, :, p].astype(np.uint64) + np.uint64(1))
    return (out >> np.uint64(32)).astype(np.uint32)


def _hashed(distinct: DataFrame, tables: int, projections: int, step: float) -> DataFrame:
    """One row per distinct vector and table: its bucket, with the vector and all its codes as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("bytes").to_pylist()
            n = batch.num_rows
            found = np.zeros((n, tables), dtype=np.uint32)
            sizes = np.array([len(b) for b in blobs])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                found[at] = codes(unit_rows([blobs[i] for i in at]), tables, projections, step)
            packed = [found[i].tobytes() for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("id", "label", "mult", "bytes")] + [
                    pa.array(packed, pa.binary()),
                    pa.array(list(found.astype(np.int64)), pa.list_(pa.int64()))],
                names=["id", "label", "mult", "bytes", "codes", "_codes"])

    flat = distinct.mapInArrow(run, "id long, label string, mult long, bytes binary, codes binary, _codes array<long>")
    return flat.select("id", "label", "mult", "bytes", "codes", F.posexplode("_codes").alias("_table", "_code")).select(
        "id", "label", "mult", "bytes", "codes", "_table",
        F.xxhash64("label", F.length("bytes"), "_table", "_code").alias("_key")).drop("_code")


def unit_rows(blobs: list[bytes]) -> np.ndarray:
    """Equally long vectors of float64 bytes, scaled to length one. The largest part is scaled out first, so that no square overflows."""
    x = np.frombuffer(b"".join(blobs), dtype="<f8").reshape(len(blobs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _compared(cells: DataFrame, threshold: float) -> DataFrame:
    """(id, root, links) per vector and cell: rows linked that no earlier table has in a common bucket,
    and a node of the cell it is connected to. A cell's pairs stay inside the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["_key", "_cell"]):
            out: list[tuple[np.ndarray, ...]] = []
            ids, mult, side = (table.column(c).to_numpy() for c in ("id", "mult", "_side"))
            label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
            at_table = table.column("_table").to_numpy()
            lengths = np.diff(starts)
            for g in np.flatnonzero(lengths > 1):
                s, n = int(starts[g]), int(lengths[g])
                part = table.slice(s, n)
                vectors = part.column("bytes").to_pylist()
                if len({len(v) for v in vectors}) > 1 or len(set(at_table[s:s + n])) > 1:
                    raise ValueError("two buckets share a 64-bit key; choose another SEED")
                unit = unit_rows(vectors)
                code = np.frombuffer(b"".join(part.column("codes").to_pylist()), dtype=np.uint32).reshape(n, -1)
                if side[s]:
                    one, two = np.flatnonzero(side[s:s + n] == 1), np.flatnonzero(side[s:s + n] == 2)
                    i, j = np.nonzero(unit[one] @ unit[two].T >= threshold)
                    i, j = one[i], two[j]
                else:
                    i, j = np.nonzero(np.triu(unit @ unit.T >= threshold, 1))
                t = int(at_table[s])
                fresh = label[s + i] == label[s + j]
                for earlier in range(t):
                    fresh &= code[i, earlier] != code[j, earlier]
                i, j = i[fresh], j[fresh]
                if len(i):
                    links = np.bincount(i, mult[s + j], n) + np.bincount(j, mult[s + i], n)
                    root = forest(n, i, j)
                    used = np.flatnonzero(links)
                    out.append((ids[s + used], ids[s + root[used]], links[used].astype(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["id", "root", "links"])

    return cells.mapInArrow(run, "id long, root long, links long")


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, projections: int = PROJECTIONS,
                 step: float = STEP, cell: int = CELL) -> DataFrame:
    """(vec_id, label, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Vectors link when their labels are equal and their cosine, in double precision, reaches the threshold.
    Equal vectors of a label are one node with a count, so copies are never compared. Nodes meet in the
    buckets of `tables` hash tables; a bucket over `cell` rows is compared in block pairs by many tasks; a
    pair counts in the first table that has it. Cells report counts and a spanning forest, never pairs.

    A row whose vector is null, empty, zero or has null or non-finite parts, whose label is null, or whose
    id is null, links with nothing. Vectors of different length never link. Labels of any type that can be
    grouped by count as equal when Spark's grouping says so. Repeated ids are rows of their own. An empty table gives no rows; other columns are ignored.
    """
    # The finite test holds for exactly the numbers that are neither infinite nor NaN.
    parts = F.col("embedding").cast("array<double>")
    finite = F.forall(parts, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & parts.isNotNull() & finite \
        & F.exists(parts, lambda v: v != 0)
    base = rows.select("vec_id", "label", parts.alias("embedding"), F.coalesce(usable, F.lit(False)).alias("_usable"))
    packed = written(_packed(base))
    distinct = written(packed.where("usable").groupBy("label", "bytes").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("mult")))
    # The label as text, whatever its type: JSON keeps the parts of nested labels apart.
    hashed = _hashed(distinct.select("id", F.to_json(F.struct("label")).alias("label"), "mult", "bytes"),
                     tables, projections, step)
    found = written(_compared(grouped(block_pairs(hashed, "_key", F.xxhash64("id"), cell), "_key", "_cell"), threshold))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("root").alias("a"), F.col("id").alias("b")).where("a <> b").distinct()
    named = distinct.join(counts, "id", "left").join(
        components(edges).withColumnRenamed("node", "id"), "id", "left").select(
        "label", "bytes", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"))
    joined = packed.where("usable").join(named, ["label", "bytes"]).select("vec_id", "label", "n_links", "component_id")
    alone = packed.where("not usable").select(
        "vec_id", "label", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _packed(base: DataFrame) -> DataFrame:
    """Usable vectors as float64 bytes: a key to group by and a compact form to send."""
    kind = base.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<f8")
            blobs = [values[s:e].tobytes() if ok else None
                     for s, e, ok in zip(offsets, offsets[1:], batch.column("_usable").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(blobs, pa.binary()), batch.column("_usable")],
                names=["vec_id", "label", "bytes", "usable"])

    return base.mapInArrow(run, f"vec_id long, label {kind}, bytes binary, usable boolean")
