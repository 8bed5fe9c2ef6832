"""Embedding whitening: exact distributed covariance, eigenvectors by mixed-precision refinement, projected rows."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonframe.llm.common import written
from seasonframe.llm.eigen import HIGH, symmetric_eigen

COMPONENTS = 32

# Entries become whole numbers floor(SCALE * entry) + SHIFT; entries from LARGEST on have none in 64 bits.
SCALE = 64
SHIFT = 1_000_000
LARGEST = float(1 << 54)

# Whole numbers are multiplied in digits of 21 bits, 2048 rows at a time: every sum of products is then exact in
# a double, so matrix products of doubles give exact integers.
DIGIT = 21
ROWS = 2048

# Rows of the covariance that travel as one value, and first-level sums of tasks.
STRIP = 64
HOPS = 16


def whole(values: np.ndarray, scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    return np.floor(scale * values).astype(np.int64) + shift


def matrix(column: pa.ListArray) -> np.ndarray:
    """Equally long lists of doubles as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def carried(planes: list[np.ndarray], limit: int) -> list[np.ndarray]:
    """Integers in base 2**21, one plane per digit, with digits of `limit` and more carried upwards."""
    out, at = list(planes), 0
    while at < len(out):
        if np.abs(out[at]).max(initial=0) >= limit:
            if at + 1 == len(out):
                out.append(np.zeros_like(out[at]))
            out[at + 1] = out[at + 1] + (out[at] >> DIGIT)
            out[at] = out[at] & ((1 << DIGIT) - 1)
        at += 1
    return out


def added(one: list[np.ndarray], two: list[np.ndarray]) -> list[np.ndarray]:
    if len(one) < len(two):
        one, two = two, one
    return [p + two[i] if i < len(two) else p for i, p in enumerate(one)]


def products(y: np.ndarray) -> list[np.ndarray]:
    """The exact matrix y'y of at most ROWS rows of whole numbers, in planes."""
    digits, rest = [], y
    while True:
        if np.abs(rest).max(initial=0) < 1 << (DIGIT - 1):
            digits.append(rest.astype(np.float64))
            break
        digits.append((rest & ((1 << DIGIT) - 1)).astype(np.float64))
        rest = rest >> DIGIT
    out = [np.zeros((y.shape[1], y.shape[1]), dtype=np.int64) for _ in range(2 * len(digits) - 1)]
    for i, a in enumerate(digits):
        for j, b in enumerate(digits):
            out[i + j] += (a.T @ b).astype(np.int64)
    return out


def _sums(vectors: DataFrame, scale: int, shift: int) -> DataFrame:
    """(size, place, n, high, low) per length and dimension: rows, and the sum as high * 2**32 + low."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            column = batch.column("embedding")
            sizes = column.value_lengths().to_numpy()
            for size in np.unique(sizes):
                x = whole(matrix(column.filter(pa.array(sizes == size))), scale, shift)
                held = totals.setdefault(int(size), [0, np.zeros(size, np.int64), np.zeros(size, np.int64)])
                held[0] += len(x)
                held[1] += (x >> 32).sum(axis=0)
                held[2] += (x & 0xFFFFFFFF).sum(axis=0)
        for size, (n, high, low) in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, v, np.int64)) for v in (size,)] + [
                    pa.array(np.arange(size, dtype=np.int64)), pa.array(np.full(size, n, np.int64)), pa.array(high), pa.array(low)],
                names=["size", "place", "n", "high", "low"])

    rows = vectors.mapInArrow(run, "size long, place long, n long, high long, low long")
    return rows.groupBy("size", "place").agg(
        F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])


def _strips(vectors: DataFrame, centre: np.ndarray, scale: int, shift: int) -> DataFrame:
    """(strip, blob) per task: its part of the sum of products of centred rows, some rows of the matrix a value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] = []
        for batch in batches:
            y = whole(matrix(batch.column("embedding")), scale, shift) - centre
            for s in range(0, len(y), ROWS):
                total = carried(added(total, products(y[s:s + ROWS])), 1 << 58)
        if total:
            yield from _rows_of(dict(enumerate(_cut(total))))

    return vectors.mapInArrow(run, "strip int, blob binary")


def _cut(planes: list[np.ndarray]) -> list[list[np.ndarray]]:
    return [[p[s:s + STRIP] for p in planes] for s in range(0, len(planes[0]), STRIP)]


def _rows_of(strips: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for strip, planes in strips.items():
        # Small digits, so that no number of tasks overflows a sum of them.
        blob = np.stack(carried(planes, 1 << 40)).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([strip], pa.int32()), pa.array([blob], pa.binary())], names=["strip", "blob"])


def _summed(strips: DataFrame, width: int) -> DataFrame:
    """Strips of equal number added up, first in HOPS groups of tasks, then over the groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for strip, blob in zip(batch.column("strip").to_pylist(), batch.column("blob").to_pylist()):
                rows = min(STRIP, width - strip * STRIP)
                planes = list(np.frombuffer(blob, dtype=np.int64).reshape(-1, rows, width))
                held[strip] = added(held[strip], planes) if strip in held else planes
        yield from _rows_of(held)

    salted = strips.withColumn("hop", F.pmod(F.spark_partition_id(), F.lit(HOPS)))
    first = salted.repartition("strip", "hop").select("strip", "blob").mapInArrow(run, "strip int, blob binary")
    return first.repartition("strip").mapInArrow(run, "strip int, blob binary")


class Model:
    """Mean, eigenvalues and whitening directions of the fit list, all of the size of a few matrices d x d."""

    def __init__(self, n: int, sums: list[int], centre: np.ndarray, planes: list[np.ndarray], components: int) -> None:
        self.n, self.centre = n, centre
        # What the whole-number centre leaves of the mean, times n.
        self.rest = [s - n * c for s, c in zip(sums, centre.tolist())]
        gram = sum(p.astype(object) << (DIGIT * i) for i, p in enumerate(planes))
        rest = np.array(self.rest, dtype=object)
        exact = n * gram - np.multiply.outer(rest, rest)
        head = exact.astype(np.float64)
        tail = np.array([int(v) - int(h) for v, h in zip(exact.ravel(), head.ravel())], dtype=object).reshape(head.shape)
        self.covariance = (head.astype(HIGH) + tail.astype(np.float64).astype(HIGH)) / HIGH(n) / HIGH(n)
        value, vector = symmetric_eigen(self.covariance)
        self.value, self.vector = value[:components], vector[:, :components]
        trace = np.trace(self.covariance)
        # An eigenvalue at the rounding of the largest is zero: there is no direction to stretch.
        self.live = self.value > value[0] * len(value) * HIGH(2) ** -58 if len(value) else self.value > 0
        self.explained = [float(max(v, HIGH(0)) / trace) if trace > 0 else None for v in self.value]
        self.directions = np.where(self.live, self.vector / np.sqrt(np.where(self.live, self.value, 1)), 0).astype(np.float64)

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened rows of centred whole numbers; directions without variance give 0."""
        return (y - np.array([r / self.n for r in self.rest])) @ self.directions

    def deviations(self, y: np.ndarray) -> list[int]:
        """Exact sum over dimensions of (n*x - S)**2 of every row."""
        most = int(np.abs(y).max(initial=0)) * self.n + max(map(abs, self.rest), default=0)
        if most >= 1 << 48 or y.shape[1] > 1 << 12:
            return [sum((self.n * v - r) ** 2 for v, r in zip(row, self.rest)) for row in y.tolist()]
        t = self.n * y - np.array(self.rest, dtype=np.int64)
        a, b = t >> 24, t & ((1 << 24) - 1)
        parts = ((a * a).sum(axis=1), (2 * a * b).sum(axis=1), (b * b).sum(axis=1))
        return [(p << 48) + (q << 24) + r for p, q, r in zip(*(v.tolist() for v in parts))]


def _identity_error(vectors: DataFrame, model: Model, scale: int, shift: int) -> float:
    """Largest absolute entry of the covariance of all whitened rows minus the identity, measured on the rows.

    Tasks send count, mean and centred products of their rows; these merge without large numbers cancelling.
    """
    live = np.flatnonzero(model.live)
    k = len(live)
    if not k:
        return 0.0

    def merged(one: tuple, two: tuple) -> tuple:
        n = one[0] + two[0]
        step = two[1] - one[1]
        return n, one[1] + step * (two[0] / n), one[2] + two[2] + np.outer(step, step) * (one[0] * two[0] / n)

    def sent(state: tuple | None) -> Iterator[pa.RecordBatch]:
        if state is not None:
            blob = np.concatenate([[state[0]], state[1], state[2].ravel()]).astype(np.float64).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["blob"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                w = model.project(whole(matrix(batch.column("embedding")), scale, shift) - model.centre)[:, live]
                mean = w.mean(axis=0)
                part = (float(len(w)), mean, (w - mean).T @ (w - mean))
                state = part if state is None else merged(state, part)
        yield from sent(state)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                v = np.frombuffer(blob)
                part = (v[0], v[1:k + 1], v[k + 1:].reshape(k, k))
                state = part if state is None else merged(state, part)
        yield from sent(state)

    parts = vectors.mapInArrow(measure, "blob binary")
    once = parts.repartition(HOPS).mapInArrow(merge, "blob binary").repartition(1).mapInArrow(merge, "blob binary")
    v = np.frombuffer(bytes(once.first()["blob"]))
    return float(np.abs(v[k + 1:].reshape(k, k) / v[0] - np.eye(k)).max())


def fit(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> tuple[Model | None, DataFrame]:
    """The model of a table of usable vectors (`embedding array<double>`) and the rows it covers."""
    sums = written(_sums(vectors, scale, shift))
    most = sums.orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return None, vectors.limit(0)
    rows = sums.where(F.col("size") == most["size"]).orderBy("place").collect()
    covered = vectors.where(F.size("embedding") == int(most["size"]))
    n, totals = int(most["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]
    centre = np.array([(2 * s + n) // (2 * n) for s in totals], dtype=np.int64)
    width = len(totals)
    strips = {r["strip"]: np.frombuffer(bytes(r["blob"]), dtype=np.int64).reshape(-1, min(STRIP, width - r["strip"] * STRIP), width)
              for r in _summed(_strips(covered, centre, scale, shift), width).collect()}
    deep = max(len(s) for s in strips.values())
    planes = [np.concatenate([strips[i][p] if p < len(strips[i]) else np.zeros_like(strips[i][0]) for i in sorted(strips)])
              for p in range(deep)]
    return Model(n, totals, centre, planes, components), covered


def whiten(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error) per usable row of (vec_id, embedding).

    Entries become whole numbers x; all usable rows are the fit list. Its covariance is summed exactly, centred at
    the whole number next to the mean before multiplying, the rest of the mean taken off in exact integers; so it
    does not depend on how Spark deals the rows. Its eigenvectors come from `symmetric_eigen`, on the driver: the
    matrix has the size of the dimension squared, whatever the number of rows. `whitened` and `explained` are
    arrays over the components by falling eigenvalue, at most `components` or the dimension. `deviation` is the exact
    sum over dimensions of (n*x - S)**2, null beyond 38 digits. `identity_error` is measured on all whitened rows.

    A row goes when its vector is null or holds a null or non-finite entry, or one of 2**54 and more in size, whose
    x has no 64-bit form. Where vectors differ in length, the most frequent length counts (the longer of equally
    frequent ones) and rows of other lengths go; empty vectors give nothing. A component without variance has null
    whitened values and no part in identity_error, which is 0 when there is no component; `explained` is null where
    nothing varies. Null and repeated ids are rows like any other; a table without usable rows gives none; other
    columns are ignored.
    """
    parts = F.col("embedding").cast("array<double>")
    usable = F.forall(parts, lambda v: v.isNotNull() & (F.abs(v) < LARGEST)) & (F.size(parts) > 0)
    vectors = rows.select("vec_id", parts.alias("embedding")).where(F.col("embedding").isNotNull() & F.coalesce(usable, F.lit(False)))
    kind = rows.schema["vec_id"].dataType.simpleString()
    shape = f"vec_id {kind}, deviation decimal(38,0), whitened array<double>"
    model, covered = fit(vectors, components, scale, shift)
    if model is None:
        empty = rows.sparkSession.createDataFrame([], shape)
        return empty.select("vec_id", F.lit(0).cast("long").alias("n"), "deviation", "whitened",
                            F.array().cast("array<double>").alias("explained"), F.lit(0.0).alias("identity_error"))
    error = _identity_error(covered, model, scale, shift)
    dead = ~model.live

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = whole(matrix(batch.column("embedding")), scale, shift) - model.centre
            w = model.project(y)
            flat = pa.array(w.ravel(), mask=np.broadcast_to(dead, w.shape).ravel()) if dead.any() else pa.array(w.ravel())
            offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * w.shape[1])
            far = [Decimal(d) if d < 10 ** 38 else None for d in model.deviations(y)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(far, pa.decimal128(38, 0)), pa.ListArray.from_arrays(offsets, flat)],
                names=["vec_id", "deviation", "whitened"])

    return covered.mapInArrow(run, shape).select(
        "vec_id", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*[F.lit(e).cast("double") for e in model.explained]).alias("explained"), F.lit(error).alias("identity_error"))
