"""Benchmark decontamination: one Aho-Corasick automaton over word windows, offsets mapped to the original text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonframe.llm.common import extended, texts_of, unused, written

# Consecutive words of an item that count as a leak.
WINDOW = 10

# Bytes of benchmark text in one automaton (some tens of times that in memory). Larger benchmarks are split
# into groups of items with an automaton each; every document meets every group.
AUTOMATON_BYTES = 4_000_000

# One byte to one byte, so offsets stay: A-Z become a-z, other ASCII than letters and digits becomes a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")

SPANS = "array<struct<start:int,end:int,item_id:string>>"


def windows(text: bytes, width: int = WINDOW) -> list[bytes]:
    """The word windows of an item; all its words when there are fewer, nothing when there are none."""
    words = text.translate(_FOLD).split()
    if not words:
        return []
    return [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]


def automaton(items: list[tuple[str, bytes]], width: int = WINDOW) -> ahocorasick.Automaton:
    """Patterns are windows between spaces; each carries its number of words and the items it comes from."""
    owners: dict[bytes, list[str]] = {}
    for item_id, text in items:
        for w in set(windows(text, width)):
            owners.setdefault(w, []).append(item_id)
    out = ahocorasick.Automaton()
    for w, ids in owners.items():
        out.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, ids))
    if owners:
        out.make_automaton()
    return out


def scan(text: bytes, found: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int, str]]]:
    """Number of words, and (first word, word after the last, item) of every occurrence, from one pass."""
    words = text.translate(_FOLD).split()
    if not words or not len(found):
        return len(words), []
    joined = f" {b' '.join(words).decode('latin-1')} "
    hits, spaces = [], None
    for end, (n, ids) in found.iter(joined):
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), dtype=np.uint8) == 32)
        stop = int(np.searchsorted(spaces, end))
        hits += [(stop - n, stop, item) for item in ids]
    return len(words), hits


def original_spans(text: bytes, hits: list[tuple[int, int, str]]) -> list[dict]:
    """Hits as code-point ranges of the original text."""
    at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    starts = np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)

    def point(byte: int) -> int:
        return int(starts[byte - 1]) if byte else 0

    return [{"start": point(at[a][0]), "end": point(at[b - 1][1]), "item_id": item} for a, b, item in sorted(set(hits))]


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """All columns of `docs` but those of the result, and: n_words, n_hit (words inside any occurrence of an
    item's window), item_ids (sorted strings), spans (code-point ranges of the original text), contaminated.

    The benchmark's bytes are summed first: up to `automaton_bytes` it is one automaton, built once in every
    Python worker from a broadcast of that bounded size. A larger benchmark is dealt into groups of items
    below that bound; documents are scanned against each group and the hits are joined per word.

    A null or empty text has no words; an item with a null id or without words cannot be reported and is
    left out; repeated items count once; an empty benchmark hits nothing; the extra columns of `docs` stay
    and a column of a result's name is replaced.
    """
    new = ("n_words", "n_hit", "item_ids", "spans", "contaminated")
    base = docs.drop(*new)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    items = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).dropDuplicates()
    size = items.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    groups = -(-size // automaton_bytes) or 1
    if groups == 1:
        return _scanned(base, [(r[0], bytes(r[1])) for r in items.collect()], width)
    # An item longer than the bound still makes a group of its own; groups are dealt by hash of the item.
    row = unused("row")
    keyed = written(base.withColumn(row, F.monotonically_increasing_id()))
    out = None
    for g in range(groups * 2):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups * 2)) == g).collect()
        hits = _scanned(keyed.select(row, "text"), [(r[0], bytes(r[1])) for r in part], width, words=True)
        out = hits if out is None else out.unionByName(hits)
    merged = out.groupBy(row).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.size(F.array_distinct(F.flatten(F.collect_list("_words")))).cast("long").alias("n_hit"))
    merged = merged.withColumn("contaminated", F.col("n_hit") > 0)
    return keyed.join(merged, row).select(*base.columns, *new)


def _scanned(docs: DataFrame, items: list[tuple[str, bytes]], width: int, words: bool = False) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    names = docs.columns
    added = f"n_words long, n_hit long, item_ids array<string>, spans {SPANS}, contaminated boolean"
    schema = extended(docs, added + (", _words array<int>" if words else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(shared.value, width)
        span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("item_id", pa.string())]))
        for batch in batches:
            counts, n_hit, ids, spans, marked = [], [], [], [], []
            for text in texts_of(batch):
                n, hits = scan(text, found)
                inside: set[int] = set()
                for a, b, _ in hits:
                    inside.update(range(a, b))
                counts.append(n)
                n_hit.append(len(inside))
                ids.append(sorted({h[2] for h in hits}))
                spans.append(original_spans(text, hits) if hits else [])
                marked.append(sorted(inside))
            columns = [batch.column(c) for c in names] + [
                pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string())),
                pa.array(spans, span_type), pa.array([n > 0 for n in n_hit], pa.bool_())]
            fields = [*names, "n_words", "n_hit", "item_ids", "spans", "contaminated"]
            if words:
                columns.append(pa.array(marked, pa.list_(pa.int32())))
                fields.append("_words")
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    return docs.mapInArrow(run, schema)
