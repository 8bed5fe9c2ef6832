"""Substring deduplication: word windows meet in the buckets of their minimisers, packed as super-k-mers."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonframe.llm.cells import whole_groups
from seasonframe.llm.common import ByteHasher, extended, mix64, partitions, texts_of, tidy, unused
from seasonframe.llm.packing import pack, unpack

# Words of a window, and of the grams among which a window's minimiser is chosen.
WINDOW = 13
GRAM = 2

# Text that one task cuts into super-k-mers at a time, and bytes hashed at a time (some 30 times that in memory).
CHUNK_BYTES = 6_000_000
SLAB_BYTES = 900_000

# Buckets per shuffle partition of the session; each bucket is a partition of its own. Its windows are unpacked
# and sorted one share of the minimisers after the other.
BUCKETS = 2
SHARES = 6


def _slabs(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive pieces of a list whose lengths add up to about `limit`."""
    s, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        total += n + 1
        if total >= limit:
            yield s, i + 1
            s, total = i + 1, 0
    if s < len(lengths):
        yield s, len(lengths)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of lines of words, and its line."""
    cut = np.flatnonzero((data == 32) | (data == 10))
    line = np.zeros(len(cut) + 1, dtype=np.int64)
    np.cumsum(data[cut] == 10, out=line[1:])
    return np.append(0, cut + 1), np.append(cut, len(data)), line


def super_kmers(lines: list[bytes], window: int, gram: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(minimiser, line, first word, words) of every longest run of windows with one minimiser.

    A window's minimiser is the smallest hash among its grams; runs end where it changes. All windows of
    equal words have the same minimiser, wherever they stand.
    """
    for s, e in _slabs(np.array([len(x) for x in lines]), SLAB_BYTES):
        text = b"\n".join(lines[s:e])
        data = np.frombuffer(text, dtype=np.uint8)
        start, end, line = word_bounds(data)
        if len(start) < window:
            continue
        low = ByteHasher(data).ranges(start[:len(start) - gram + 1], end[gram - 1:])
        width, want = 1, window - gram + 1
        while width < want:
            step = min(width, want - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        inside = line[:len(low)] == line[window - 1:]
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (low[1:] != low[:-1]) | (line[1:len(low)] != line[:len(low) - 1])
        first = np.flatnonzero(new)
        # A run lasts until the next run starts or the line's last window.
        last_of_line = np.searchsorted(line, line[first], side="right") - window
        last = np.minimum(np.append(first[1:], len(low)) - 1, last_of_line)
        line_start = np.searchsorted(line, line[first])
        for m, n, w, a, b in zip(low[first].tolist(), (line[first] + s).tolist(), (first - line_start).tolist(),
                                 start[first].tolist(), end[last + window - 1].tolist()):
            yield m, n, w, text[a:b]


def _chunks(texts: Iterable[bytes], limit: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Rows with words and their words joined by one space, about `limit` bytes at a time."""
    rows, lines, total = [], [], 0
    for i, text in enumerate(texts):
        line = b" ".join(text.split())
        if line:
            rows.append(i)
            lines.append(line)
            total += len(line)
            if total >= limit:
                yield rows, lines
                rows, lines, total = [], [], 0
    if rows:
        yield rows, lines


def _packed(docs: DataFrame, window: int, gram: int, buckets: int) -> DataFrame:
    """(bucket, blob): the different super-k-mers of a chunk of documents with the places where each stands, and
    where each share of the minimisers begins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column("_id").to_numpy(), batch.column("_tag").to_numpy()
            for rows, lines in _chunks(texts_of(batch), CHUNK_BYTES):
                # Words: their minimiser, then line and first word of every place. Equal words have one minimiser.
                places: dict[bytes, list[int]] = {}
                for minimiser, line, word, words in super_kmers(lines, window, gram):
                    found = places.get(words)
                    if found is None:
                        places[words] = [minimiser, line, word]
                    else:
                        found += (line, word)
                if not places:
                    continue
                strings, found = list(places), list(places.values())
                del places
                keys = np.array([f[0] for f in found], dtype=np.uint64)
                mixed = mix64(keys)
                bucket_of = (mixed % np.uint64(buckets)).astype(np.int64)
                share_of = ((mixed // np.uint64(buckets)) % np.uint64(SHARES)).astype(np.int64)
                # Strings of one minimiser side by side: they share words, and so compress.
                order = np.lexsort((keys, share_of, bucket_of))
                cut = np.flatnonzero(np.append(True, np.diff(bucket_of[order]) != 0))
                out_bucket, out_blob, rows_at = [], [], np.array(rows)
                for part in np.split(order, cut[1:]):
                    members = part.tolist()
                    at = np.array([x for k in members for x in found[k][1:]], dtype=np.int32).reshape(-1, 2)
                    used, line = np.unique(at[:, 0], return_inverse=True)
                    out_bucket.append(int(bucket_of[members[0]]))
                    out_blob.append(pack(
                        b"\n".join([strings[k] for k in members]), np.array([len(found[k]) // 2 for k in members], dtype=np.int32),
                        np.searchsorted(share_of[part], np.arange(SHARES + 1)).astype(np.int32),
                        line.astype(np.int32), np.ascontiguousarray(at[:, 1]), ids[rows_at[used]], tags[rows_at[used]], level=6))
                if out_blob:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out_bucket, pa.int64()), pa.array(out_blob, pa.binary())], names=["bucket", "blob"])
                del strings, found, out_blob
        tidy()

    return docs.mapInArrow(run, "bucket long, blob binary")


def window_owners(strings: list[bytes], smallest: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every string the smallest document that has it, and the first window of each string.

    Window hashes are sorted, so equal windows stand side by side; equal hashes count as equal windows only
    where the words are equal.
    """
    hashes, starts, ends, counts, base = [], [], [], [], 0
    for s, e in _slabs(np.array([len(x) for x in strings]), SLAB_BYTES):
        data = np.frombuffer(b"\n".join(strings[s:e]), dtype=np.uint8)
        start, end, line = word_bounds(data)
        ok = line[:len(start) - window + 1] == line[window - 1:]
        first, last = start[:len(ok)][ok], end[window - 1:][ok]
        hashes.append(ByteHasher(data).ranges(first, last))
        starts.append(first + base)
        ends.append(last + base)
        counts.append(np.bincount(line[:len(ok)][ok], minlength=e - s))
        base += len(data) + 1
    text = b"\n".join(strings)
    hashes, starts, ends, counts = (np.concatenate(x) for x in (hashes, starts, ends, counts))
    own = np.repeat(smallest, counts)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    cut = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    least = np.minimum.reduceat(own[order], cut)
    sizes = np.diff(np.append(cut, len(order)))
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.repeat(least, sizes)
    for run in np.flatnonzero(sizes > 1).tolist():
        members = order[cut[run]:cut[run] + sizes[run]].tolist()
        words = text[starts[members[0]]:ends[members[0]]]
        if any(text[starts[m]:ends[m]] != words for m in members[1:]):
            apart: dict[bytes, int] = {}
            for m in members:
                key = text[starts[m]:ends[m]]
                apart[key] = min(apart.get(key, own[m]), own[m])
            for m in members:
                out[m] = apart[text[starts[m]:ends[m]]]
    return out, np.append(0, np.cumsum(counts))


def _ranges(blobs: pa.ChunkedArray, share: int, window: int) -> dict[tuple[int, int], list[int]]:
    """Repeated word ranges by (document, tag) from one share of a bucket: all strings with equal windows are in it.
    Only this share's strings, places and windows are unpacked at a time; the rest stays compressed."""
    strings: list[bytes] = []
    parts = []
    for blob in blobs:
        text, counts, shares, line, word, ids, tags = unpack(blob.as_py())
        s, e = int(shares[share]), int(shares[share + 1])
        if s < e:
            at = np.append(0, np.cumsum(counts))
            a, b = int(at[s]), int(at[e])
            parts.append((np.repeat(np.arange(e - s), counts[s:e]) + len(strings), ids[line[a:b]], tags[line[a:b]], word[a:b].copy()))
            strings += text.split(b"\n")[s:e]
    found: dict[tuple[int, int], list[int]] = defaultdict(list)
    if not strings:
        return found
    string, doc, tag, word = (np.concatenate(x) for x in zip(*parts))
    smallest = np.full(len(strings), np.iinfo(np.int64).max)
    np.minimum.at(smallest, string, doc)
    owners, first = window_owners(strings, smallest, window)
    least = np.minimum.reduceat(owners, first[:-1])
    hit = np.flatnonzero(least[string] < doc)
    for k, d, t, w in zip(string[hit].tolist(), doc[hit].tolist(), tag[hit].tolist(), word[hit].tolist()):
        repeated = np.flatnonzero(owners[first[k]:first[k + 1]] < d).tolist()
        a = b = repeated[0]
        for r in repeated[1:]:
            if r > b + window:
                found[d, t] += (w + a, w + b + window)
                a = r
            b = r
        found[d, t] += (w + a, w + b + window)
    return found


def _repeats(packed: DataFrame, window: int, buckets: int) -> DataFrame:
    """(_id, _tag, ranges): word ranges of a document covered by windows that a smaller document has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["bucket"]):
            for s, e in zip(starts, starts[1:]):
                blobs = table.column("blob").slice(s, e - s)
                for share in range(SHARES):
                    found = _ranges(blobs, share, window)
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int64()),
                             pa.array([np.array(r, dtype=np.int32).tobytes() for r in found.values()], pa.binary())],
                            names=["_id", "_tag", "ranges"])
        tidy()

    return packed.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(run, "_id long, _tag long, ranges binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """All columns of `docs`, and n_words, n_removed, kept_text (the kept words joined by one space).

    A word goes when a window of `window` words covers it whose words also start in a document with a
    smaller doc_id; windows are judged on the input. Every window of every document travels, packed with
    its neighbours of the same minimiser; equal super-k-mers of a chunk travel once with their places, so a
    passage that many documents share reaches its bucket once per chunk of text. Word ranges come back to
    their documents; a document's ranges are bounded by its length.

    Null and empty texts and texts shorter than a window lose nothing. A document with a null id has no place
    in the order: it takes no words from others and loses none. Rows that share an id are one document for the
    order and lose nothing to each other. An empty table gives no rows; columns named like a result column are
    replaced.
    """
    new = ("n_words", "n_removed", "kept_text")
    base = docs.drop(*new)
    buckets = BUCKETS * partitions(docs)
    source = base.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_tag"), "text").where("_id is not null")
    ranges = _repeats(_packed(source, window, gram, buckets), window, buckets).groupBy("_id", "_tag").agg(
        F.collect_list("ranges").alias("_ranges"))
    held = unused("ranges")
    joined = base.join(ranges, (base["doc_id"].cast("long") == ranges["_id"]) & (F.xxhash64(base["text"]) == ranges["_tag"]), "left")
    return _kept(joined.select(*[base[c] for c in base.columns], ranges["_ranges"].alias(held)), base.columns, held)


def _kept(joined: DataFrame, names: list[str], held: str) -> DataFrame:
    schema = extended(joined, "n_words long, n_removed long, kept_text string", without=(held,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, ranges in zip(texts_of(batch), batch.column(held).to_pylist()):
                words = text.split()
                counts.append(len(words))
                if ranges:
                    bounds = np.frombuffer(b"".join(ranges), dtype=np.int32).reshape(-1, 2)
                    change = np.bincount(bounds[:, 0], minlength=len(words) + 1) - np.bincount(bounds[:, 1], minlength=len(words) + 1)
                    stay = np.cumsum(change)[:-1] == 0
                    words = [w for w, k in zip(words, stay.tolist()) if k]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept)],
                names=[*names, "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(run, schema)
