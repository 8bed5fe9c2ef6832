"""Approximate vector search: bucketed random projections with query-directed probes, exact scores of what they find."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import dot

TABLES = 16
PROJECTIONS = 8
STEP = 1.2
PROBES = 12
SEED = 17
# Bits of a sketch, and how surely a pair at the threshold may fail its test.
BITS = 128
MISS = 1e-9


@functools.lru_cache(maxsize=8)
def _directions(size: int, tables: int, projections: int, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Random directions and shifts of all tables, the same in every task for vectors of one length."""
    rng = np.random.default_rng((SEED, size))
    return rng.standard_normal((size, tables * projections)), rng.uniform(0, step, tables * projections)


def _mixed(cells: np.ndarray) -> np.ndarray:
    """One 64-bit number per row of the last axis."""
    out = np.zeros(cells.shape[:-1], dtype=np.uint64)
    for p in range(cells.shape[-1]):
        out = (out ^ cells[..., p].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def bucket_keys(vectors: np.ndarray, tables: int, projections: int, step: float, probes: int = 0) -> np.ndarray:
    """Per vector, table and probe the number of a bucket. The first is the vector's own; each further one moves the
    vector over the wall of one projection or of two, the nearest walls first."""
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    directions, shift = _directions(vectors.shape[1], tables, projections, step)
    places = ((vectors / np.where(norm > 0, norm, 1)) @ directions + shift) / step
    cells = np.floor(places).astype(np.int64).reshape(len(vectors), tables, projections)
    out = [_mixed(cells)]
    if probes:
        rest = places.reshape(cells.shape) - cells
        # Distance to the nearer wall, and the step over it.
        side = np.where(rest < 0.5, -1, 1)
        wall = np.minimum(rest, 1 - rest) ** 2
        moves = [(p,) for p in range(projections)] + [(p, q) for p in range(projections) for q in range(p)]
        cost = np.stack([wall[..., list(m)].sum(axis=-1) for m in moves], axis=-1)
        order = np.argsort(cost, axis=-1)[..., :probes]
        masks = np.zeros((len(moves), projections), dtype=np.int64)
        for i, m in enumerate(moves):
            masks[i, list(m)] = 1
        for n in range(order.shape[-1]):
            out.append(_mixed(cells + side * masks[order[..., n]]))
    return np.stack(out, axis=-1)


def sketches(vectors: np.ndarray) -> np.ndarray:
    """Per vector two 64-bit numbers: on which side of BITS random planes it lies. The planes are none of the tables'."""
    planes = np.random.default_rng((SEED + 1, vectors.shape[1])).standard_normal((vectors.shape[1], BITS))
    return np.packbits(vectors @ planes > 0, axis=1).view(np.int64)


def sketch_limit(cosine: float) -> int:
    """Differing bits that a pair of this cosine or a higher one exceeds with a probability under MISS."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    tail = 0.0
    for n in range(BITS, 0, -1):
        tail += math.comb(BITS, n) * p ** n * (1 - p) ** (BITS - n)
        if tail > MISS:
            return n
    return 0


def _keyed(rows: DataFrame, row_id: str, model: str, vector: str, tables: int, projections: int, step: float, probes: int,
           sketch: tuple[str, str] | None = None) -> DataFrame:
    """(row_id, model, _table, _key): one row per bucket to stand or to look in; vectors stay behind.

    `sketch` names two more columns, the vector's sketch: null when a component or the norm is not finite or the norm is too
    small for a cosine that can be relied on.
    """
    kind, named = (rows.schema[c].dataType.simpleString() for c in (row_id, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_v")
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            for size in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(at))
                values = part.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                keys = bucket_keys(np.nan_to_num(values), tables, projections, step, probes)
                each = keys.shape[1] * keys.shape[2]
                again = pa.array(np.repeat(np.arange(len(at)), each))
                extra = []
                if sketch:
                    with np.errstate(over="ignore", invalid="ignore"):
                        square = (values * values).sum(axis=1)
                    odd = ~(np.isfinite(square) & (square > 1e-200))
                    bits = sketches(np.where(odd[:, None], 0, values))
                    extra = [pa.array(bits[:, n], mask=odd).take(again) for n in range(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(row_id).take(again), part.column(model).take(again),
                     pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), keys.shape[2]), len(at))), pa.array(keys.ravel()), *extra],
                    names=[row_id, model, "_table", "_key", *(sketch or ())])

    picked = rows.select(row_id, model, F.col(vector).cast("array<double>").alias("_v"))
    return picked.mapInArrow(run, f"`{row_id}` {kind}, `{model}` {named}, _table int, _key long" + "".join(f", {c} long" for c in sketch or ()))


def vector_search_lsh(docs: DataFrame, doc_id: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, k: int,
                      model: str = "model", threshold: float | None = None, tie: str | None = None, tables: int = TABLES,
                      projections: int = PROJECTIONS, step: float = STEP, probes: int = PROBES) -> DataFrame:
    """The result of `vector_search` over those documents that share a bucket with the query.

    A document stands in one bucket of each table; a query looks into its own bucket and the `probes` nearest of
    each table. Only ids and bucket numbers meet, on (model, table, bucket); the distinct pairs then fetch both vectors by
    id and are scored exactly, so what is found has the exact score and order, and what is missed is missing. How
    surely depends on the cosine alone: `tests/test_vector_lsh.py` measures it. For farther neighbours raise `step`
    or `probes`; `vector_search` stays the exact form.

    Strangers share a bucket too (about 2 % of all pairs of 64 dimensions), so their number grows with the square of the rows. With
    a positive threshold every bucket row carries a sketch of 128 bits, and the join hands on only pairs whose sketches differ
    in no more bits than a pair at the threshold does but once in 10**9; vectors without a usable sketch pass. What is shuffled
    then follows the bucket rows and the pairs near the threshold, while the comparing of sketches inside a bucket still
    grows with the square. Without a threshold all pairs of a bucket go on.

    Cosine is 0 when a norm is 0; vectors of unequal length never meet. Rows without a vector, id or model are
    not found. Ids must be unique on both sides.
    """
    if k < 1:
        raise ValueError("k must be positive")
    # Scores are rounded before they meet the threshold.
    limit = sketch_limit(threshold - 1e-6) if threshold is not None and threshold > 0 else BITS
    ours, theirs = (("_d1", "_d2"), ("_q1", "_q2")) if limit < BITS else (None, None)
    stand = _keyed(docs, doc_id, model, vector, tables, projections, step, 0, ours)
    look = _keyed(queries, query_id, model, query_vector, tables, projections, step, probes, theirs)
    pairs = look.join(stand, [model, "_table", "_key"])
    if ours:
        differ = [F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(ours, theirs, strict=True)]
        pairs = pairs.where(F.coalesce(differ[0] + differ[1] <= limit, F.lit(True)))
    pairs = pairs.select(query_id, doc_id).distinct()
    left = docs.select(doc_id, F.col(vector).alias("_d"), *([tie] if tie else []), F.sqrt(dot(F.col(vector), F.col(vector))).alias("_dn"))
    right = queries.select(query_id, F.col(query_vector).alias("_q"), F.sqrt(dot(F.col(query_vector), F.col(query_vector))).alias("_qn"))
    norm = F.col("_dn") * F.col("_qn")
    similarity = F.when(norm == 0, 0.0).otherwise(F.try_divide(dot(F.col("_d"), F.col("_q")), norm))
    scored = pairs.join(left, doc_id).join(right, query_id).where(F.size("_d") == F.size("_q")).select(
        query_id, doc_id, *([tie] if tie else []), F.round(similarity, 6).alias("score"))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    order = Window.partitionBy(query_id).orderBy(F.col("score").desc(), *([F.col(tie).desc()] if tie else []), F.col(doc_id).asc())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        query_id, doc_id, "score", F.col("rank").cast("bigint").alias("rank"))
