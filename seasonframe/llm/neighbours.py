"""Approximate nearest neighbours: randomly rotated one-bit codes, error bounds, reranking of what they cannot exclude."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonframe.llm.common import partitions
from seasonframe.llm.packing import pack, unpack

NEIGHBOURS = 5
SEED = 11

# Width of the error bound in standard deviations of the estimate. A neighbour right at the k-th place is lost with
# a probability of about 0.001, a nearer one with less; up to 10 dimensions the bound cannot fail at all.
WIDTH = 3.0

# Queries of a block, candidates of a packed value, queries estimated at a time, and candidates that a query sees
# before it has anything to exclude others with.
QUERY_BLOCK = 2048
BATCH = 4096
SLICE = 256
FIRST = 64

# What single precision may be off in a cosine.
ROUNDING = 1e-5


@functools.lru_cache(maxsize=4)
def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times a power of two that puts their largest part between one half and one: no square overflows, and
    cosines keep every bit."""
    _, exponent = np.frexp(np.abs(rows).max(axis=1, initial=0))
    return np.ldexp(rows, -exponent[:, None])


def summed(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up in the order of the dimensions: equal rows give equal bits."""
    out = np.zeros(len(one))
    for j in range(one.shape[1]):
        out += one[:, j] * two[:, j]
    return out


def encode(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits, factor, spread) of scaled rows. With x the code's unit vector and o the rotated unit row, the
    estimate of o.q is factor * (x.q), and it errs by at most spread * sqrt(1 - (o.q)**2) per deviation of WIDTH."""
    size = rows.shape[1]
    unit = (rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))).astype(np.float32) @ rotation(size)
    bits = unit > 0
    aligned = np.abs(unit).sum(axis=1, dtype=np.float64) / np.sqrt(size)
    tangent = np.sqrt(np.maximum(0, 1 - aligned ** 2)) / aligned
    return np.packbits(bits, axis=1), 1 / aligned, tangent / np.sqrt(max(1, size - 1))


def decode(packed: np.ndarray, size: int) -> np.ndarray:
    """Codes as unit vectors."""
    bits = np.unpackbits(packed.reshape(-1, (size + 7) // 8), axis=1, count=size)
    return (bits.astype(np.float32) * 2 - 1) / np.float32(np.sqrt(size))


class Block:
    """Queries of one length that see candidates batch by batch and keep their best."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, serial: np.ndarray, k: int, width: float) -> None:
        self.rows, self.ids, self.serial, self.k = rows, ids, serial, k
        self.size = rows.shape[1]
        self.width = min(width, np.sqrt(max(1, self.size - 1)))
        self.length = np.sqrt(summed(rows, rows))
        self.unit = (rows / self.length[:, None]).astype(np.float32)
        self.turned = self.unit @ rotation(self.size)
        self.best = np.full((len(rows), k), -np.inf)
        self.found = np.full((len(rows), k), np.iinfo(np.int64).max)
        self.seen = 0

    def see(self, rows: np.ndarray, ids: np.ndarray, length: np.ndarray, packed: np.ndarray, factor: np.ndarray, spread: np.ndarray) -> None:
        codes = decode(packed, self.size) * factor[:, None].astype(np.float32)
        # Two more columns carry what a query must exceed: one product gives estimate + bound - k-th best so far.
        codes = np.column_stack([codes, np.ones(len(ids)), self.width * spread]).astype(np.float32)
        unit = (rows / length[:, None]).astype(np.float32)
        at = 0
        while at < len(ids):
            # As many as were seen before, so that few are reranked for want of something better.
            part = slice(at, min(len(ids), at + max(FIRST, self.seen)))
            for s in range(0, len(self.rows), SLICE):
                self._compare(s, rows[part], ids[part], length[part], codes[part], unit[part])
            self.seen += part.stop - at
            at = part.stop

    def _compare(self, s: int, rows: np.ndarray, ids: np.ndarray, length: np.ndarray, codes: np.ndarray, unit: np.ndarray) -> None:
        floor = np.clip(self.best[s:s + SLICE, -1], -1, 1) - ROUNDING
        room = np.sqrt(1 - np.clip(floor, 0, 1) ** 2)
        asked = np.column_stack([self.turned[s:s + SLICE], -floor, room]).astype(np.float32)
        q, c = np.divmod(np.flatnonzero(asked @ codes.T >= 0), len(ids))
        kept = []
        for t in range(0, len(q), 1 << 15):
            a, b = q[t:t + (1 << 15)], c[t:t + (1 << 15)]
            near = np.einsum("ij,ij->i", self.unit[s + a], unit[b])
            kept.append(t + np.flatnonzero((near >= floor[a]) & (self.ids[s + a] != ids[b])))
        if kept:
            at = np.concatenate(kept)
            if len(at):
                self._rerank(s + q[at], c[at], rows, ids, length)

    def _rerank(self, q: np.ndarray, c: np.ndarray, rows: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        cosine = np.empty(len(q))
        for s in range(0, len(q), 1 << 16):
            a, b = q[s:s + (1 << 16)], c[s:s + (1 << 16)]
            cosine[s:s + (1 << 16)] = summed(self.rows[a], rows[b]) / (self.length[a] * length[b])
        some = np.unique(q)
        at = np.concatenate([np.repeat(some, self.k), q])
        score = np.concatenate([self.best[some].ravel(), cosine])
        named = np.concatenate([self.found[some].ravel(), ids[c]])
        order = np.lexsort((named, -score, at))
        first = np.searchsorted(at[order], some)
        take = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.best[some], self.found[some] = score[take].reshape(-1, self.k), named[take].reshape(-1, self.k)

    def results(self) -> tuple[np.ndarray, ...]:
        q, r = np.nonzero(self.best > -np.inf)
        return self.serial[q], self.ids[q], self.found[q, r], self.best[q, r]


def _usable(rows: DataFrame) -> DataFrame:
    parts = F.col("embedding").cast("array<double>")
    good = F.forall(parts, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists(parts, lambda v: v != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), parts.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(good, F.lit(False)))


def _by_size(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """(size, scaled rows, the batch's rows) for every length of vector, at most `most` at a time."""
    for whole in batches:
        for s in range(0, whole.num_rows, most):
            batch = whole.slice(s, most)
            sizes = batch.column("embedding").value_lengths().to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                yield int(size), scaled(part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)), part


def _coded(vectors: DataFrame, k: int) -> DataFrame:
    """(blob) of the index: some vectors of one length with ids, lengths, codes and correction factors.

    Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest, so the others stay out; tasks
    cut before the shuffle, and a group of copies costs its own task k + 1 rows.
    """
    order = Window.partitionBy("embedding").orderBy("vec_id")
    few = vectors.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1).drop("_n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, rows, part in _by_size(batches, BATCH):
            bits, factor, spread = encode(rows)
            yield pa.RecordBatch.from_arrays([pa.array([pack(
                np.array([size], dtype="<i8"), rows.ravel(), part.column("vec_id").to_numpy(), np.sqrt(summed(rows, rows)), bits.ravel(), factor, spread, level=1)],
                pa.binary())], names=["blob"])

    return few.mapInArrow(run, "blob binary")


def _asked(queries: DataFrame, blocks: int) -> DataFrame:
    """(block, blob) of the queries: some of one length with ids and a number for every row."""
    dealt = queries.withColumn("_serial", F.monotonically_increasing_id()).withColumn(
        "_block", F.pmod(F.xxhash64("_serial"), F.lit(blocks)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, rows, part in _by_size(batches, QUERY_BLOCK):
            number, block = part.column("_serial").to_numpy(), part.column("_block").to_numpy()
            for b in np.unique(block):
                at = np.flatnonzero(block == b)
                blob = pack(np.array([size], dtype="<i8"), rows[at].ravel(), part.column("vec_id").to_numpy()[at], number[at], level=1)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], names=["block", "blob"])

    return dealt.mapInArrow(run, "block int, blob binary")


def nearest(rows: DataFrame, asked: Column, k: int = NEIGHBOURS, width: float = WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows by cosine of every row of (vec_id, embedding) for
    which `asked` (over vec_id) holds.

    Every vector is indexed by one bit per rotated dimension and two correction factors; nothing is fitted. Blocks
    of queries meet shares of the index in one task each, which reads its share value by value: the codes give an
    estimate and a bound for every pair, and vectors that may still reach a query's k-th best so far are reranked:
    by the cosine in single precision, and by that in double where it may matter. So tasks hold one block and one
    value, and send k rows a query.

    Vectors that are null, empty, zero or hold null or non-finite parts, and rows without an id, take no part.
    Only vectors of one length are compared. A row is never found by a query of its own id; rows that repeat an id
    are searched and found on their own, so an id may come back twice. Ties go to the smaller id; with fewer than
    k candidates there are fewer rows. An empty table gives no rows; other columns are ignored.
    """
    vectors = _usable(rows)
    queries = vectors.where(asked)
    width_of_stage = partitions(rows)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    shares = max(1, width_of_stage // blocks)
    share = F.pmod(F.xxhash64("blob"), F.lit(shares)).cast("int")
    index = _coded(vectors, k).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), share.alias("share"), F.lit(1).alias("kind"), "blob")
    questions = _asked(queries, blocks).select("block", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("kind"), "blob")
    met = questions.unionByName(index).withColumn("pair", F.col("block") * shares + F.col("share")).repartitionById(
        blocks * shares, F.col("pair")).sortWithinPartitions("pair", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, questions, ready = None, {}, {}
        for batch in batches:
            for p, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("pair", "kind", "blob"))):
                if p != pair:
                    yield from _answers(ready)
                    pair, questions, ready = p, {}, {}
                parts = unpack(blob)
                size = int(parts[0][0])
                vectors = parts[1].reshape(-1, size)
                if kind == 0:
                    questions.setdefault(size, []).append((vectors, parts[2], parts[3]))
                    continue
                if size in questions:
                    ready[size] = Block(*(np.concatenate(x) for x in zip(*questions.pop(size))), k, width)
                if size in ready:
                    ready[size].see(vectors, *parts[2:])
        yield from _answers(ready)

    best = met.select("pair", "kind", "blob").mapInArrow(run, "serial long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("serial", "query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answers(ready: dict[int, Block]) -> Iterator[pa.RecordBatch]:
    for block in ready.values():
        columns = block.results()
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["serial", "query_id", "vec_id", "score"])
