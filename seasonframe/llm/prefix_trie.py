"""Conversation prefix trie by truncation peeling, over range-sorted conversations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonframe.llm.common import WORD, partitions, written

# Bytes of a turn's and of a prefix's digest.
KEY = 16

# Turns that one task peels at a time (a longer conversation comes alone).
SLAB_TURNS = 200_000

# Conversations that are rebuilt on one opening, and the most turns an opening has.
FAMILY = 20
OPENING = 3

# By how many keys the children of one node spread over tasks.
SPREAD = 16


def opening_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from its family's first conversation."""
    return F.crc32(conv_id.cast("string").cast("binary")) % (OPENING + 1)


def rebuilt(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): every conversation with its opening turns replaced by those of the family's first one.

    Turns travel as (turn, role, first letters, digest, words), not as texts; equal digests of role and text
    count as equal turns. One shuffle by family serves the grouping and the join.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The role's length keeps ("a", "bc") and ("ab", "c") apart.
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turn = F.struct(F.col("turn"), role.alias("role"), F.substring(text, 1, KEY).alias("head"), digest.alias("digest"),
                    F.regexp_count(text, F.lit(WORD)).alias("words"))
    conv = F.col("conv_id").cast("long")
    dealt = rows.where(conv.isNotNull()).select(
        (conv - conv % FAMILY).alias("family"), conv.alias("conv_id"), turn.alias("t")).repartition("family")
    whole = dealt.groupBy("family", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("own"))
    first = whole.where("conv_id = family").select("family", F.slice("own", 1, OPENING).alias("opening"))
    h = opening_turns(F.col("conv_id")).cast("int")
    none = F.array().cast(whole.schema["own"].dataType)
    joined = whole.join(first, "family", "left").select("conv_id", F.concat(
        F.slice(F.coalesce("opening", none), F.lit(1), h), F.slice("own", h + 1, F.size("own"))).alias("turns"))
    return joined.select("conv_id", F.transform("turns", lambda t: t["digest"]).alias("digests"),
                         F.transform("turns", lambda t: t["words"]).alias("words"))


def _paths(convs: DataFrame) -> DataFrame:
    """(path, conv_id, words): a path holds a digest of every prefix, so paths sort as the trie does and two
    conversations share as many turns as their paths share digests."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, words = [], []
            for digests, counts in zip(batch.column("digests").to_pylist(), batch.column("words").to_pylist()):
                state, out = b"", []
                for d in digests:
                    state = hashlib.blake2b(state + d, digest_size=KEY).digest()
                    out.append(state)
                paths.append(b"".join(out))
                words.append(np.array(counts, dtype="<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.binary()), batch.column("conv_id"), pa.array(words, pa.binary())], names=["path", "conv_id", "words"])

    return convs.mapInArrow(run, "path binary, conv_id long, words binary")


def shared(one: bytes, two: bytes) -> int:
    """Digests that two paths have in common from the start."""
    n = min(len(one), len(two)) // KEY
    a, b = (np.frombuffer(p, np.uint8, n * KEY).reshape(n, KEY) for p in (one, two))
    differ = np.flatnonzero((a != b).any(axis=1))
    return int(differ[0]) if len(differ) else n


def _slabs(paths: DataFrame, turns: int) -> DataFrame:
    """Sorted conversations packed some at a time: (part, seq, first, last, before, after, and the packed rows).

    `before` and `after` are the digests that a slab's first and last path share with the neighbour slab of its
    part, null at the part's ends.
    """
    width = partitions(paths)
    ordered = paths.repartitionByRange(width, "path", "conv_id").sortWithinPartitions("path", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, bytes]] = []
        seq, size, before = 0, 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("path", "conv_id", "words"))):
                if held and size >= turns:
                    after = shared(held[-1][0], row[0])
                    yield _packed(held, seq, before, after)
                    held, size, seq, before = [], 0, seq + 1, after
                held.append(row)
                size += len(row[0]) // KEY + 1
        if held:
            yield _packed(held, seq, before, None)

    shape = "seq long, first binary, last binary, before int, after int, sizes binary, paths binary, words binary, ids binary"
    return ordered.mapInArrow(run, shape).withColumn("part", F.spark_partition_id())


def _packed(held: list[tuple[bytes, int, bytes]], seq: int, before: int | None, after: int | None) -> pa.RecordBatch:
    paths, ids, words = zip(*held)
    sizes = np.array([len(p) // KEY for p in paths], dtype="<i4").tobytes()
    values = [pa.array([seq], pa.int64()), pa.array([paths[0]], pa.binary()), pa.array([paths[-1]], pa.binary()),
              pa.array([before], pa.int32()), pa.array([after], pa.int32()), pa.array([sizes], pa.binary()),
              pa.array([b"".join(paths)], pa.binary()), pa.array([b"".join(words)], pa.binary()),
              pa.array([np.array(ids, dtype="<i8").tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(values, names=["seq", "first", "last", "before", "after", "sizes", "paths", "words", "ids"])


def _bordered(slabs: DataFrame) -> DataFrame:
    """Slabs with `before` and `after` filled in across parts: one window over a row per part."""
    ends = slabs.groupBy("part").agg(F.min_by("first", "seq").alias("first"), F.max_by("last", "seq").alias("last"))
    order = Window.orderBy("part")

    def common(one: Column, two: Column) -> Column:
        n = (F.least(F.length(one), F.length(two)) / KEY).cast("int")
        steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        same = F.filter(steps, lambda i: F.substring(one, (i - 1) * KEY + 1, F.lit(KEY)) == F.substring(two, (i - 1) * KEY + 1, F.lit(KEY)))
        return F.size(same)

    near = ends.select("part", "first", "last", F.lag("last").over(order).alias("_left"), F.lead("first").over(order).alias("_right")).select(
        "part", F.when(F.col("_left").isNotNull(), common(F.col("_left"), F.col("first"))).alias("_before"),
        F.when(F.col("_right").isNotNull(), common(F.col("last"), F.col("_right"))).alias("_after"))
    # At the two ends of everything only the root lies open.
    return slabs.drop("first", "last").join(near, "part").withColumns({
        "before": F.coalesce("before", "_before", F.lit(0)), "after": F.coalesce("after", "_after", F.lit(0))}).drop("_before", "_after")


NODE = ("is_open boolean, path binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long, words long, ends binary, part int, seq long")


def peel(sizes: np.ndarray, keys: np.ndarray, words: np.ndarray, ids: np.ndarray, before: int, after: int) -> Iterator[dict[str, np.ndarray]]:
    """Nodes of sorted conversations, depth by depth from the deepest: conversations that end at a depth join the
    nodes that were stripped down to it, equal neighbours merge into nodes of that depth with their sums, and each
    node loses its last turn and goes on as a part of its parent.

    A node is open when the slabs next to this one may hold members of it too: the first path's prefixes of at
    most `before` turns and the last path's of at most `after`. Open nodes pass on what closed nodes below them
    have, and nothing of their own: that needs all their members.
    """
    start = np.append(0, np.cumsum(sizes))[:-1]
    common = np.zeros(len(sizes), dtype=np.int64)
    if len(sizes) > 1:
        both = np.minimum(sizes[1:], sizes[:-1])
        at = np.arange(both.sum()) - np.repeat(np.append(0, np.cumsum(both))[:-1], both)
        same = (keys[np.repeat(start[1:], both) + at] == keys[np.repeat(start[:-1], both) + at]).all(axis=1)
        common[1:] = np.bincount(np.repeat(np.arange(1, len(sizes)), both), same, len(sizes))[1:]
    by_size = np.argsort(sizes, kind="stable")
    done = len(by_size)
    last = len(sizes) - 1
    row = np.zeros(0, dtype=np.int64)
    state = {c: np.zeros(0, dtype=np.int64) for c in ("conv_id", "n_convs", "n_children", "n_leaves", "saved")}
    waiting: list[dict[str, np.ndarray]] = []
    for depth in range(int(sizes.max(initial=0)), -1, -1):
        first = int(np.searchsorted(sizes[by_size[:done]], depth))
        ended = by_size[first:done]
        done = first
        rows = np.concatenate([ended, row])
        mixed = {"conv_id": np.concatenate([ids[ended], state["conv_id"]]), "n_convs": np.concatenate([np.ones_like(ended), state["n_convs"]])}
        for c in ("n_children", "n_leaves", "saved"):
            mixed[c] = np.concatenate([np.zeros_like(ended), state[c]])
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        new = common[rows] < depth
        if len(new):
            new[0] = True
        cut = np.flatnonzero(new)
        child_of = np.cumsum(new) - 1
        state = {c: (np.minimum if c == "conv_id" else np.add).reduceat(v[order], cut) for c, v in mixed.items()} if len(cut) else state
        row = rows[cut]
        # The last row of a node: the one before the next node starts.
        is_open = np.zeros(len(row), dtype=bool)
        if len(row):
            is_open[0] |= row[0] == 0 and depth <= before
            is_open[-1] |= depth <= after and _reaches(common, int(row[-1]), last, depth)
        if depth == 0:
            is_open[:] = True
        place = start[row] + depth - 1
        last_words = words[place] if depth else np.zeros(len(row), dtype=np.int64)
        closed = ~is_open
        state["n_leaves"] = state["n_leaves"] + (closed & (state["n_children"] == 0))
        state["saved"] = state["saved"] + np.where(closed, (state["n_convs"] - 1) * last_words, 0)
        # Children that wait for their parent's smallest conversation get it now.
        for held in waiting:
            parent = child_of[np.searchsorted(rows, held["row"])] if len(rows) else held["row"]
            held["parent_open"], held["parent_conv_id"] = is_open[parent], state["conv_id"][parent]
            yield held
        waiting = [{"depth": np.full(len(row), depth), "row": row, "is_open": is_open, "words": last_words, "ended": ended[np.argsort(ended)],
                    "parent_open": np.zeros(len(row), dtype=bool), "parent_conv_id": np.zeros(len(row), dtype=np.int64),
                    **{c: v.copy() for c, v in state.items()}}]
        # Strip the last turn: a closed node counts as one child of its parent, an open one is counted when it is whole.
        state["n_children"] = closed.astype(np.int64)
    yield from waiting


def _reaches(common: np.ndarray, row: int, last: int, depth: int) -> bool:
    """Whether the slab's last conversation has the node of `row` at this depth as a prefix."""
    return row == last or bool(common[row + 1:last + 1].min() >= depth)


def _peeled(slabs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in NODE.split(", ")]
        for batch in batches:
            for one in batch.to_pylist():
                sizes = np.frombuffer(one["sizes"], "<i4").astype(np.int64)
                keys = np.frombuffer(one["paths"], "<u8").reshape(-1, KEY // 8)
                words, ids = np.frombuffer(one["words"], "<i8"), np.frombuffer(one["ids"], "<i8")
                start = np.append(0, np.cumsum(sizes))
                for level in peel(sizes, keys, words, ids, one["before"], one["after"]):
                    depth, rows = int(level["depth"][0]) if len(level["depth"]) else 0, level["row"]
                    # Conversations that end here stand side by side, the node's first row in front.
                    group = np.searchsorted(rows, level["ended"], side="right") - 1
                    bounds = np.searchsorted(group, np.arange(len(rows) + 1))
                    paths, parents, ends = [], [], []
                    for k, (r, wide) in enumerate(zip(rows.tolist(), level["is_open"].tolist())):
                        at = int(start[r]) * KEY
                        listed = ",".join(map(str, ids[level["ended"][bounds[k]:bounds[k + 1]]].tolist())).encode()
                        paths.append(one["paths"][at:at + depth * KEY] if wide else None)
                        parent = one["paths"][at + max(0, depth - 2) * KEY:at + (depth - 1) * KEY] if depth else None
                        parents.append(parent if wide or level["parent_open"][k] else None)
                        ends.append(listed if wide else hashlib.sha256(listed).digest())
                    values = {"is_open": pa.array(level["is_open"]), "path": pa.array(paths, pa.binary()), "parent_key": pa.array(parents, pa.binary()),
                              "ends": pa.array(ends, pa.binary()), "part": pa.array(np.full(len(rows), one["part"], np.int32)),
                              "seq": pa.array(np.full(len(rows), one["seq"], np.int64)), "saved_tokens": pa.array(level["saved"])}
                    for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "words"):
                        values[c] = pa.array(level[c].astype(np.int64))
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([values[c] for c in names], names=names)

    return slabs.mapInArrow(run, NODE)


def _digested(pieces: DataFrame) -> DataFrame:
    """(key, ends_sha256): the lists of a node's slabs, in order, through one running digest that holds none of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, some = None, None, False
        for batch in batches:
            out = []
            for k, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if k != key:
                    if digest is not None:
                        out.append((key, digest.hexdigest()))
                    key, digest, some = k, hashlib.sha256(), False
                if ends:
                    digest.update(b"," + ends if some else ends)
                    some = True
            if out:
                yield _digests(out)
        if digest is not None:
            yield _digests([(key, digest.hexdigest())])

    return pieces.repartition("key").sortWithinPartitions("key", "part", "seq").mapInArrow(run, "key binary, ends_sha256 string")


def _digests(out: list[tuple[bytes, str]]) -> pa.RecordBatch:
    keys, found = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found)], names=["key", "ends_sha256"])


def prefix_trie(rows: DataFrame, slab_turns: int = SLAB_TURNS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Conversations become paths of prefix digests and are range-sorted by them, so that a node's members stand side
    by side and a hot opening, or a group of copies, spreads over many tasks (the id is part of the order). Tasks
    peel their slabs from the deepest turn upwards. Only nodes that reach over a slab's border stay open: some
    for every slab, never a share of the rows. Their parts are added up by key, and each then hands its own
    leaf and saved tokens to its ancestors, which it knows from its path. No step is repeated per depth.

    Turns are ordered by (turn, role, first 16 letters of the text, digest), nulls first; null role and text are empty;
    repeated rows are turns of their own. Rows with a null conv_id belong to no conversation and are left out.
    A conversation's digests, 16 bytes a turn, travel as one value, so Spark's limit on a value bounds its
    turns, not the table. An empty table gives no rows, not even a root; other columns are ignored.
    """
    slabs = written(_slabs(_paths(rebuilt(rows)), slab_turns))
    nodes = written(_peeled(_bordered(slabs)))
    key = F.when(F.length("path") > 0, F.substring(F.col("path"), F.length("path") - KEY + 1, F.lit(KEY))).otherwise(F.lit(b""))
    parts = nodes.where("is_open").withColumn("key", key)
    whole = parts.groupBy("key").agg(
        F.min("path").alias("path"), F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("closed_children"), F.sum("n_leaves").alias("leaves_below"),
        F.sum("saved_tokens").alias("saved_below"), F.min("words").alias("words"))
    children = whole.where("depth > 0").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("open_children"))
    opened = written(whole.join(children, "key", "left").join(_digested(parts.select("key", "part", "seq", "ends")), "key").withColumn(
        "n_children", F.col("closed_children") + F.coalesce("open_children", F.lit(0))))
    own = opened.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("depth").cast("int")), lambda d: F.when(d > 0, F.substring(
        F.col("path"), (d - 1) * KEY + 1, F.lit(KEY))).otherwise(F.lit(b"")))).alias("key"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    below = own.groupBy("key").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    names = opened.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv"))
    result = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    top = opened.join(below, "key").join(names, "parent_key", "left").select(
        "conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("leaves_below") + F.col("leaves")).alias("n_leaves"), (F.col("saved_below") + F.col("saved")).alias("saved_tokens"), "ends_sha256")
    closed = nodes.where("not is_open").withColumn("ends_sha256", F.lower(F.hex("ends")))
    inner = closed.where("parent_key is null").select(*result)
    # A node may have a third of all nodes as children: they are dealt to SPREAD copies of its name.
    salted = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    border = closed.where("parent_key is not null").withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SPREAD)).cast("int"))
    outer = border.join(salted, ["parent_key", "salt"]).withColumn("parent_conv_id", F.col("parent_conv")).select(*result)
    return inner.unionByName(outer).unionByName(top.select(*result))
