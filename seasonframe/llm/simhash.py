"""SimHash near-duplicates: 64-bit fingerprints, linked at a small Hamming distance found by pigeonring chains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonframe.llm.cells import grouped, whole_groups
from seasonframe.llm.common import texts_of, tidy, unused, written
from seasonframe.llm.components import block_pairs, components

SHINGLE = 3
DISTANCE = 3

# Fingerprints of one bucket that one task compares with each other.
CELL = 4096

# Hashes turned into bits at a time: 64 bytes each.
_SLAB = 1 << 16


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Bits set in over half of the hashes of all shingles; zero for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _SLAB):
        slab = hashes[at:at + _SLAB]
        ones += np.unpackbits(slab.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, tag, fingerprint as a signed long) of every row; a null text has no words. The tag is a hash of
    the text: with it a row is found again among rows that repeat its id."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in texts_of(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(found)], names=["doc_id", "tag", "fingerprint"])
        tidy()

    return docs.select("doc_id", text_tag(F.col("text")).alias("tag"), "text").mapInArrow(run, f"doc_id {kind}, tag long, fingerprint long")


def text_tag(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def segments(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of distance + 1 segments of the 64 bits, the ring's boxes."""
    n = distance + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def chain_masks(distance: int, first: int) -> list[tuple[np.uint64, int]]:
    """(bits of the l segments from `first` round the ring, differences allowed in them) for every l.

    With distance + 1 segments the proportional budget l * distance / (distance + 1) is l - 1.
    """
    ring = segments(distance)
    out, mask = [], 0
    for step in range(len(ring)):
        shift, width = ring[(first + step) % len(ring)]
        mask |= ((1 << width) - 1) << shift
        out.append((np.uint64(mask), step))
    return out


def linked(x: np.uint64, others: np.ndarray, chain: list[tuple[np.uint64, int]]) -> np.ndarray:
    """Places in `others` within the distance of x: each chain length prunes before the full check."""
    at = np.arange(len(others))
    diff = others ^ x
    for mask, budget in chain:
        keep = np.bitwise_count(diff & mask) <= budget
        at, diff = at[keep], diff[keep]
        if not len(at):
            break
    return at


def chain_keys(fp: Column, distance: int) -> Column:
    """Keys by which fingerprints meet that share a chain of two segments: one segment equal, the next with
    one difference at most. A pair that differs in one bit of the next segment meets under the key of the
    one with a 0 there, so a fingerprint has its own key and one for each of its 1 bits, per segment."""
    ring = segments(distance)
    return F.concat(*[_keys_of_segment(fp, i, ring[i], ring[(i + 1) % len(ring)]) for i in range(len(ring))])


def _keys_of_segment(fp: Column, i: int, first: tuple[int, int], second: tuple[int, int]) -> Column:
    (shift, width), (shift2, width2) = first, second
    head = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))
    tail = F.shiftrightunsigned(fp, shift2).bitwiseAND(F.lit((1 << width2) - 1))

    def key(bits: Column) -> Column:
        # Two rows of one key are compared in full, so a hash of wide segments needs no equality of its own.
        if width + width2 > 48:
            return F.xxhash64(F.lit(i), head, bits)
        return F.lit(i).cast("long") * (1 << 48) + head * (1 << width2) + bits

    ones = F.filter(F.array(*[F.lit(1 << b).cast("long") for b in range(width2)]),
                    lambda bit: tail.bitwiseAND(bit) != 0)
    own = F.concat(F.array(key(tail)), F.transform(ones, lambda bit: key(tail - bit)))
    return F.transform(own, lambda k: F.struct(k.alias("key"), F.lit(i).alias("segment")))


def links(representatives: DataFrame, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """Edges (a, b) between ids of distinct fingerprints that connect exactly those within the distance.

    A bucket emits a spanning forest of its links, never all pairs; buckets over `cell` are compared in
    block pairs by many tasks.
    """
    rows = representatives.select("id", "fingerprint", F.explode(chain_keys(F.col("fingerprint"), distance)).alias("_k"))
    rows = rows.select("id", "fingerprint", F.col("_k.key").alias("_key"), F.col("_k.segment").alias("_segment"))
    dealt = grouped(block_pairs(rows, "_key", F.xxhash64("fingerprint"), cell), "_key", "_cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains = [chain_masks(distance, i) for i in range(distance + 1)]
        masks = np.array([[mask for mask, _ in chain] for chain in chains])
        for table, starts in whole_groups(batches, ["_key", "_cell"]):
            ids, side = table.column("id").to_numpy(), table.column("_side").to_numpy()
            fps = table.column("fingerprint").to_numpy().view(np.uint64)
            segment = table.column("_segment").to_numpy()
            a, b = [], []
            lengths = np.diff(starts)
            # Small groups, all at once: every row with the row `step` further on, while that is in its group.
            group = np.repeat(np.arange(len(lengths)), lengths)
            small = (lengths <= 16)[group]
            for step in range(1, 16):
                if len(group) <= step:
                    break
                at = np.flatnonzero(small[:-step] & (group[:-step] == group[step:]))
                if not len(at):
                    break
                diff, ring = fps[at] ^ fps[at + step], segment[at]
                keep = np.ones(len(at), dtype=bool)
                for budget in range(distance + 1):
                    keep &= np.bitwise_count(diff & masks[ring, budget]) <= budget
                a.append(ids[at[keep]])
                b.append(ids[at[keep] + step])
            for g in np.flatnonzero(lengths > 16):
                s, e = starts[g], starts[g + 1]
                x, y = spanning(fps[s:e], side[s:e], chains[segment[s]])
                a.append(ids[s:e][x])
                b.append(ids[s:e][y])
            if a and sum(map(len, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def spanning(fps: np.ndarray, side: np.ndarray, chain: list[tuple[np.uint64, int]]) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of one cell, by search from each row not reached yet. In a cell of two
    blocks only rows of different sides are compared; each block has a cell of its own."""
    left, a, b = np.arange(len(fps)), [], []
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            hit = linked(fps[x], fps[left], chain)
            if side[x]:
                hit = hit[side[left[hit]] != side[x]]
            if len(hit):
                reached = left[hit].tolist()
                a += [x] * len(reached)
                b += reached
                frontier += reached
                left = np.delete(left, hit)
    return a, b


def _grouped(docs: DataFrame, width: int, distance: int) -> DataFrame:
    """(doc_id, tag, fingerprint, node, component_id) of every row: `node` is the smallest fingerprint of the row's
    component, component_id the smallest id in it."""
    prints = written(fingerprints(docs, width))
    nodes = written(prints.groupBy("fingerprint").agg(F.min("doc_id").cast("long").alias("id")))
    edges = links(nodes.where(F.col("id").isNotNull()).select(F.col("fingerprint").alias("id"), "fingerprint"), distance)
    joined = nodes.join(components(edges).select(F.col("node").alias("fingerprint"), F.col("component_id").alias("node")), "fingerprint", "left")
    linked_nodes = written(joined)
    names = linked_nodes.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("component_id"))
    named = linked_nodes.join(names, "node", "left").select(
        "fingerprint", F.coalesce("node", "fingerprint").alias("node"), F.coalesce("component_id", "id").alias("component_id"))
    return prints.join(named, "fingerprint")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id, kept) of every row.

    Rows of one fingerprint are one node; nodes are linked where fingerprints differ in at most `distance` bits;
    component_id is the smallest id reachable. `kept` marks the row whose id names its component.

    Null and empty texts have fingerprint zero and link like any other. A row with a null id takes the
    component of its fingerprint's other rows (null when there are none) and is kept only in that last
    case. A repeated id is in the component of each of its texts, which it does not link, and keeps a row each. An
    empty table gives no rows; other columns are ignored.
    """
    return _grouped(docs, width, distance).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def one_of_each(docs: DataFrame, width: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of `docs`, all columns, that stay when each component keeps one: the row with the smallest id (null
    ids last), and among rows of that id the one with the smallest text tag. Of rows equal in both one stays."""
    first = _grouped(docs, width, distance).groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag")).alias("r"))
    key, place = unused("key"), unused("place")

    def named(doc_id: Column, tag: Column) -> Column:
        return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), tag.cast("string"))

    kept = first.select(named(F.col("r.doc_id"), F.col("r.tag")).alias(key))
    # Equal rows share the join's key, so telling them apart needs no shuffle beyond the join's.
    found = docs.withColumn(key, named(F.col("doc_id"), text_tag(F.col("text")))).join(kept, key, "left_semi")
    return found.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(key))).where(F.col(place) == 1).select(*docs.columns)
