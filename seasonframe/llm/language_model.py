"""LM scoring: a smoothed bigram model in Elias-Fano tries, one per shard of the counted corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonframe.llm.cells import whole_groups
from seasonframe.llm.common import ByteHasher, bucketed, mix64, partitions, remainder, texts_of, written
from seasonframe.llm.elias_fano import Trie
from seasonframe.llm.packing import pack, unpack

# Documents whose crc32 of the id has remainder 0 by this number are never learned from.
FOLDS = 10

# Added to the count of every token and of one unknown token.
ADDED = 0.1

# Weight of the unigram model in every context, in tokens. Chosen on held-out documents: mean log10 probability per
# token was -3.98 at 8, -3.79 at 512, -3.83 at 2000 (unigrams alone: -4.29).
PRIOR = 512.0

# Text of one batch of documents, the unit in which words and word pairs are first counted.
BATCH_BYTES = 4_000_000

# Parts into which the successors of every context are dealt: a word that begins a tenth of all pairs is
# spread over this many shards.
SPREAD = 16

# Codes per unit of -log10 probability; 0 means that the pair is missing.
CODES = 4096

# The end of a document, also the context of its first word. Words hold no white space.
END = b"\n"

_ROWS = "batch long, kind int, shard int, blob binary"


def _row(batch: list[int], kind: int, shard: list[int], blob: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(batch, pa.int64()), pa.array([kind] * len(batch), pa.int32()), pa.array(shard, pa.int32()), pa.array(blob, pa.binary())],
        names=["batch", "kind", "shard", "blob"])


def _encoded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Tokens of all documents as numbers by falling frequency, tokens per document, and the words in that
    order, each followed by a space."""
    parts = [t.lower().split() for t in texts]
    lengths = np.array([len(p) + 1 for p in parts])
    text = b" ".join([b" ".join([*p, END]) for p in parts]) + b" "
    stops = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32).astype(np.int32) + 1
    tokens = pa.BinaryArray.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(np.append(np.int32(0), stops).tobytes()), pa.py_buffer(text)])
    coded = tokens.dictionary_encode()
    ids = coded.indices.to_numpy()
    counts = np.bincount(ids, minlength=len(coded.dictionary))
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank[ids], lengths, b"".join(coded.dictionary.take(pa.array(order)).to_pylist())


def _batches(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """Documents in batches, as numbers into a vocabulary of the batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            flags = (np.array(batch.column("doc_id").is_null().to_pylist()) * 2 + np.array(batch.column("train").to_pylist())).astype(np.uint8)
            texts, total, s = [], 0, 0
            for e, text in enumerate(texts_of(batch), 1):
                texts.append(text)
                total += len(text)
                if total >= batch_bytes or e == batch.num_rows:
                    tokens, lengths, words = _encoded(texts)
                    blob = pack(tokens.astype("<u4"), lengths.astype("<u4"), words, ids[s:e], flags[s:e])
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([blob], pa.binary())], names=["batch", "blob"])
                    texts, total, s, number = [], 0, e, number + 1

    return docs.mapInArrow(run, "batch long, blob binary")


class _Batch:
    """A batch read back, with the ids and counts of its words once they are known."""

    def __init__(self, blob: bytes, shards: int) -> None:
        tokens, lengths, self.words, self.ids, self.flags = unpack(blob)
        self.tokens = tokens.astype(np.int64)
        self.lengths = lengths.astype(np.int64)
        data = np.frombuffer(self.words, dtype=np.uint8)
        self.stops = np.flatnonzero(data == 32)
        self.starts = np.append(0, self.stops[:-1] + 1)
        self.shard = (ByteHasher(data).ranges(self.starts, self.stops) % np.uint64(shards)).astype(np.int64)
        self.train = np.repeat((self.flags & 1).astype(bool), self.lengths)

    def of_shards(self) -> Iterator[tuple[int, np.ndarray]]:
        """The words of every shard, as numbers of the batch."""
        order = np.argsort(self.shard, kind="stable")
        cut = np.flatnonzero(np.append(True, np.diff(self.shard[order]) != 0))
        for part in np.split(order, cut[1:]):
            if len(part):
                yield int(self.shard[part[0]]), part

    def know(self, answers: dict[int, bytes]) -> None:
        self.word_id, self.count = np.zeros(len(self.starts), dtype=np.int64), np.zeros(len(self.starts), dtype=np.int64)
        for shard, part in self.of_shards():
            ids, counts = unpack(answers[shard])
            self.word_id[part], self.count[part] = ids, counts

    def pairs(self, shards: int) -> None:
        """The different (context, word) pairs, ordered by shard, context and word, and the pair of each token."""
        end = int(np.flatnonzero((self.stops - self.starts == 1) & (np.frombuffer(self.words, dtype=np.uint8)[self.starts] == END[0]))[0])
        before = np.append(end, self.tokens[:-1])
        before[np.cumsum(self.lengths)[:-1]] = end
        n = len(self.starts)
        key, inverse = np.unique(before * n + self.tokens, return_inverse=True)
        context, word = key // n, key % n
        part = mix64(self.word_id[word].astype(np.uint64)) % np.uint64(SPREAD)
        shard = (mix64(self.word_id[context].astype(np.uint64) * np.uint64(SPREAD) + part) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((self.word_id[word], self.word_id[context], shard))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.context, self.word, self.pair_shard, self.pair = context[order], word[order], shard[order], rank[inverse]
        self.seen = np.bincount(self.pair, self.train, len(order)).astype(np.int64)


def _word_rows(stored: DataFrame, shards: int) -> DataFrame:
    """Kind 1: the words of a batch that belong to a shard, with their training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for number, blob in zip(rows.column("batch").to_pylist(), rows.column("blob").to_pylist()):
                b = _Batch(blob, shards)
                counts = np.bincount(b.tokens[b.train], minlength=len(b.starts)).astype("<u4")
                names, blobs = [], []
                for shard, part in b.of_shards():
                    words = b"".join(b.words[s:e + 1] for s, e in zip(b.starts[part].tolist(), b.stops[part].tolist()))
                    names.append(shard)
                    blobs.append(pack(words, counts[part]))
                yield _row([number] * len(names), 1, names, blobs)

    return stored.mapInArrow(run, _ROWS)


def _word_answers(words: DataFrame, shards: int) -> DataFrame:
    """Kind 1 back to the batches: id and corpus count of each word; kind 9: tokens and different words of a shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["shard"]):
            shard_of, batch_of = table.column("shard").to_numpy(), table.column("batch").to_pylist()
            blobs = table.column("blob").to_pylist()
            for s, e in zip(starts, starts[1:]):
                shard = int(shard_of[s])
                parts = [unpack(b) for b in blobs[s:e]]
                text = b"".join(words for words, _ in parts)
                stops = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32).astype(np.int64) + 1
                array = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(stops), [None, pa.py_buffer(np.append(0, stops).astype(np.int64).tobytes()), pa.py_buffer(text)])
                ids = array.dictionary_encode().indices.to_numpy().astype(np.int64)
                counts = np.bincount(ids, np.concatenate([c for _, c in parts])).astype(np.int64)
                yield _row([-1], 9, [shard], [pack(np.array([counts.sum(), (counts > 0).sum()]))])
                answers, at = [], 0
                for _, c in parts:
                    own = ids[at:at + len(c)]
                    at += len(c)
                    answers.append(pack(own * shards + shard, counts[own].astype("<u4")))
                yield _row(batch_of[s:e], 1, [shard] * (e - s), answers)

    return words.repartitionById(shards, "shard").sortWithinPartitions("batch").mapInArrow(run, _ROWS)


def _joined(stored: DataFrame, *answers: DataFrame) -> DataFrame:
    """Every batch with what the shards answered it, a list per kind. The batches lie in buckets already; only
    the answers travel."""
    out = stored
    for n, f in enumerate(answers, 1):
        out = out.join(f.groupBy("batch").agg(F.collect_list(F.struct("shard", "blob")).alias(f"answers{n}")), "batch")
    return out


def _read(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[tuple[int, _Batch, dict[int, bytes]]]:
    """Batches that know their words, with the answers about their pairs, if any, by shard."""
    for rows in batches:
        for k in range(rows.num_rows):
            row = rows.slice(k, 1).to_pylist()[0]
            b = _Batch(row["blob"], shards)
            b.know({a["shard"]: a["blob"] for a in row["answers1"]})
            yield row["batch"], b, {a["shard"]: a["blob"] for a in row.get("answers2", ())}


def _pair_rows(rows: DataFrame, shards: int) -> DataFrame:
    """Kind 2: the pairs of a batch that belong to a shard, with training counts, and what the shard needs to
    know of their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b, _ in _read(batches, shards):
            b.pairs(shards)
            cut = np.flatnonzero(np.append(True, np.diff(b.pair_shard) != 0))
            names, blobs = [], []
            for s, e in zip(cut, np.append(cut[1:], len(b.pair_shard))):
                context, word = b.context[s:e], b.word[s:e]
                first = np.flatnonzero(np.append(True, np.diff(context) != 0))
                different, at = np.unique(b.word_id[word], return_inverse=True)
                count = np.zeros(len(different), dtype=np.int64)
                count[at] = b.count[word]
                heads = context[first]
                names.append(int(b.pair_shard[s]))
                blobs.append(pack(
                    np.diff(b.word_id[heads], prepend=0), b.count[heads].astype("<u4"), np.diff(np.append(first, e - s)).astype("<u4"),
                    np.diff(different, prepend=0), count.astype("<u4"), at.astype("<u4"), b.seen[s:e].astype("<u4")))
            yield _row([number] * len(names), 2, names, blobs)

    return rows.mapInArrow(run, _ROWS)


def _pair_answers(pairs: DataFrame, shards: int, total: int, different: int, prior: float, added: float) -> DataFrame:
    """Kind 2 back to the batches: the code of each pair, looked up in the shard's trie."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["shard"]):
            shard_of, batch_of = table.column("shard").to_numpy(), table.column("batch").to_pylist()
            blobs = table.column("blob").to_pylist()
            for s, e in zip(starts, starts[1:]):
                contexts, words, seen = [], [], []
                all_heads, all_head_counts, all_words, all_word_counts = [], [], [], []
                for blob in blobs[s:e]:
                    heads, head_counts, sizes, ids, counts, at, n = unpack(blob)
                    heads, ids = np.cumsum(heads), np.cumsum(ids)
                    contexts.append(np.repeat(heads, sizes))
                    words.append(ids[at])
                    seen.append(n)
                    all_heads.append(heads)
                    all_head_counts.append(head_counts)
                    all_words.append(ids)
                    all_word_counts.append(counts)
                head, first = np.unique(np.concatenate(all_heads), return_index=True)
                head_count = np.concatenate(all_head_counts)[first].astype(np.float64)
                word, first = np.unique(np.concatenate(all_words), return_index=True)
                word_count = np.concatenate(all_word_counts)[first].astype(np.float64)
                lengths = [len(x) for x in contexts]
                context = np.searchsorted(head, np.concatenate(contexts))
                successor = np.searchsorted(word, np.concatenate(words))
                seen_all = np.concatenate(seen)
                learned = seen_all > 0
                key, inverse = np.unique((context * len(word) + successor)[learned], return_inverse=True)
                count = np.bincount(inverse, seen_all[learned], len(key))
                known_context, known_word = key // len(word), key % len(word)
                base = (word_count[known_word] + added) / (total + added * (different + 1))
                chance = (count + prior * base) / (head_count[known_context] + prior)
                code = np.clip(np.rint(-np.log10(chance) * CODES) + 1, 1, 65535).astype("<u2")
                trie = Trie(known_context, known_word, code, len(head), len(word))
                found = trie.lookup(context, successor)
                answers = [pack(part) for part in np.split(found, np.cumsum(lengths)[:-1])]
                yield _row(batch_of[s:e], 2, [int(shard_of[s])] * (e - s), answers)

    return pairs.repartitionById(shards, "shard").sortWithinPartitions("batch").mapInArrow(run, _ROWS)


def _scores(rows: DataFrame, shards: int, total: int, different: int, prior: float, added: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b, answers in _read(batches, shards):
            b.pairs(shards)
            codes = np.concatenate([unpack(answers[s])[0] for s in sorted(answers)]).astype(np.float64)
            unigram = np.log10((b.count + added) / (total + added * (different + 1)))
            absent = np.log10(prior / (b.count[b.context] + prior)) + unigram[b.word]
            pair = np.where(codes > 0, -(codes - 1) / CODES, absent)
            doc = np.repeat(np.arange(len(b.lengths)), b.lengths)
            n = len(b.lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.ids, mask=(b.flags & 2) > 0), pa.array((b.flags & 1) == 0), pa.array(b.lengths),
                 pa.array(np.bincount(doc, b.count[b.tokens] > 0, n).astype(np.int64)), pa.array(np.full(n, total, dtype=np.int64)),
                 pa.array(np.bincount(doc, unigram[b.tokens], n)), pa.array(np.bincount(doc, pair[b.pair], n))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, folds: int = FOLDS, prior: float = PRIOR, added: float = ADDED, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model: p(w) = (c(w) + added) / (N + added * (V + 1)), and p(w | v) = (c(v w) + prior * p(w)) / (c(v) + prior),
    over all documents outside the held-out fold; a document's first word follows the end token. Both sum to one.

    Nothing is gathered in one place. Documents are packed into batches once, in the shared folder. Batches send
    their different words, then their different word pairs, to shards by hash; a shard adds up the corpus counts,
    builds the trie of its pairs (quantised log probabilities, monotone pointers and successors, memory-mapped)
    and answers for every pair of every batch; batches add the answers up by document. Equal pairs of a batch
    travel once, and a context's successors are dealt over several shards, so a very common word or pair loads no
    single task.

    A null text is empty and has the end token alone; a null id counts as held out; repeated rows are scored, and
    counted, each; an empty table gives no rows; other columns are ignored.
    """
    shards = partitions(docs)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                         F.coalesce(remainder(F.col("doc_id"), folds) != 0, F.lit(False)).alias("train"))
    stored = bucketed(_batches(marked, batch_bytes), "batch")
    answers = written(_word_answers(_word_rows(stored, shards), shards))
    totals = [unpack(bytes(r["blob"]))[0] for r in answers.where("kind = 9").select("blob").collect()]
    total, different = (int(sum(t[k] for t in totals)) for k in (0, 1))
    words = answers.where("kind = 1")
    pairs = _pair_answers(_pair_rows(_joined(stored, words), shards), shards, total, different, prior, added)
    return _scores(_joined(stored, words, pairs), shards, total, different, prior, added)
