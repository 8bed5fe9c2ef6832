"""Quality classifier: n-gram indicators scaled by class log-count ratios, a hinge-loss model by dual coordinate descent."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonframe.llm.common import ByteHasher, extended, first_by_hash, mix64, remainder, texts_of, tidy, written
from seasonframe.llm.substring import SLAB_BYTES, word_bounds

# Labelled rows of each class that the model is fitted on: those first in the order of a hash of their ids.
SAMPLE = 3000

# Rows whose crc32 of the id has remainder 0 by this number are never learned from.
FOLDS = 5

# Score from which a document counts as good.
ACCEPT = 0.3

# Hashed word unigrams, then hashed word bigrams.
WORD_SPACE = 1 << 18

# Shapes of words, n-grams of which are indicators at several shares of a document's words.
SHAPES = 2 * 8 * 8 * 2
SHARES = (1 / 64, 1 / 16, 1 / 4)
SHAPE_BASE = 2 * WORD_SPACE
SPACE = SHAPE_BASE + len(SHARES) * (SHAPES + SHAPES * SHAPES)

# Words added to a document's length before shares are taken: one odd word in a short text is no habit.
SHARE_PRIOR = 20

# Sample documents in which an n-gram must appear to have a weight.
MIN_DOCS = 3

_KIND = np.full(256, 7, dtype=np.int64)
_KIND[33:127] = 6
_KIND[ord("0"):ord("9") + 1] = 0
_KIND[ord("a"):ord("z") + 1] = 1
_KIND[ord("A"):ord("Z") + 1] = 2
_KIND[ord(".")] = 3
_KIND[ord(",")] = 4
_KIND[ord("!")] = 5


def feature_slabs(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, feature) of every n-gram indicator, each once, ordered by document, some documents at a time.

    Word uni- and bigrams are hashed without regard to A-Z case. The shape of a word says whether it repeats
    the word before, what its first and last bytes are, and whether it is in capitals; shape uni- and bigrams
    are indicators at each share of the words that they reach.
    """
    lines, total, first = [], 0, 0
    for text in texts:
        lines.append(b" ".join(text.split()))
        total += len(lines[-1]) + 1
        if total >= SLAB_BYTES:
            doc, feature = _slab_features(b"\n".join(lines))
            yield doc + first, feature
            lines, total, first = [], 0, first + len(lines)
    if lines:
        doc, feature = _slab_features(b"\n".join(lines))
        yield doc + first, feature


def features(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All of `feature_slabs` at once, for a bounded list of texts."""
    slabs = list(feature_slabs(texts)) or [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    return np.concatenate([d for d, _ in slabs]), np.concatenate([f for _, f in slabs])


def _slab_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text, dtype=np.uint8)
    start, end, line = word_bounds(data)
    full = end > start
    start, end, line = start[full], end[full], line[full]
    if not len(start):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    word = ByteHasher(np.frombuffer(text.lower(), dtype=np.uint8)).ranges(start, end)
    near = line[1:] == line[:-1]
    pair = mix64(word[:-1] * np.uint64(3) + word[1:])[near]
    space = np.uint64(WORD_SPACE)
    ids = [(word % space).astype(np.int64), (pair % space).astype(np.int64) + WORD_SPACE]
    at = [line, line[1:][near]]

    repeat = np.append(False, near & (word[1:] == word[:-1]))
    capitals = np.append(0, np.cumsum((data >= 65) & (data <= 90)))
    small = np.append(0, np.cumsum(((data >= 97) & (data <= 122))))
    loud = (capitals[end] - capitals[start] > 1) & (small[end] == small[start])
    shape = ((repeat * 8 + _KIND[data[start]]) * 8 + _KIND[data[end - 1]]) * 2 + loud
    gram = np.concatenate([shape, SHAPES + (shape[:-1] * SHAPES + shape[1:])[near]])
    key, count = np.unique(np.concatenate(at) * (SHAPES + SHAPES * SHAPES) + gram, return_counts=True)
    owner, gram = key // (SHAPES + SHAPES * SHAPES), key % (SHAPES + SHAPES * SHAPES)
    share = count / (np.bincount(line, minlength=int(line[-1]) + 1)[owner] + SHARE_PRIOR)
    for level, least in enumerate(SHARES):
        reached = share >= least
        ids.append(SHAPE_BASE + gram[reached] * len(SHARES) + level)
        at.append(owner[reached])
    key = np.unique(np.concatenate(at) * SPACE + np.concatenate(ids))
    return key // SPACE, key % SPACE


@dataclass
class Model:
    """A document is the vector of its features' log-count ratios, scaled to unit length; its margin is bias + its
    product with `weights`, its score logistic(slope * margin + offset). All arrays have the fixed length SPACE."""

    weights: np.ndarray
    ratio: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, texts: Iterable[bytes], n: int) -> np.ndarray:
        """The scores of n texts."""
        length, product = np.zeros(n), np.zeros(n)
        for doc, feature in feature_slabs(texts):
            r = self.ratio[feature].astype(np.float64)
            length += np.bincount(doc, r * r, n)
            product += np.bincount(doc, r * self.weights[feature], n)
        margin = self.bias + product / np.maximum(np.sqrt(length), 1e-12)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


def fit(rows: list[np.ndarray], good: np.ndarray, cost: float = 1.0, passes: int = 40, seed: int = 5) -> Model:
    """Train on the feature lists of a bounded sample. Without both classes every score is the share of good
    rows (a half without any)."""
    rows = [np.asarray(r, dtype=np.int64) for r in rows]
    if not len(good) or good.all() or not good.any():
        share = (good.sum() + 1) / (len(good) + 2)
        return Model(np.zeros(SPACE), np.zeros(SPACE), 0.0, 0.0, float(np.log(share / (1 - share))))
    seen = [np.bincount(np.concatenate([r for r, g in zip(rows, good) if g == c]), minlength=SPACE) for c in (0, 1)]
    ratio = np.log((seen[1] + 1.0) / (seen[1] + 1.0).sum()) - np.log((seen[0] + 1.0) / (seen[0] + 1.0).sum())
    ratio[seen[0] + seen[1] < MIN_DOCS] = 0
    y = np.where(good, 1.0, -1.0)
    # Each class weighs the same in all; values are scaled to unit length, the bias is one more feature.
    bound = cost * len(y) / (2 * np.where(good, good.sum(), (~good).sum()))
    lists = [r[ratio[r] != 0] for r in rows]
    values = [ratio[r] for r in lists]
    values = [v / max(np.sqrt((v * v).sum()), 1e-12) for v in values]
    w, b, alpha = np.zeros(SPACE), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        most = 0.0
        for i in rng.permutation(len(y)):
            r, v = lists[i], values[i]
            slack = y[i] * (w[r] @ v + b) - 1
            new = min(max(alpha[i] - slack / (1 + v @ v), 0.0), bound[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                b += step
                most, alpha[i] = max(most, abs(step)), new
        if most < 1e-3:
            break
    margin = np.array([w[r] @ v + b for r, v in zip(lists, values)])
    slope, offset = _logistic(margin, good, bound)
    return Model(w.astype(np.float32), ratio.astype(np.float32), float(b), slope, offset)


def _logistic(margin: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the margins, with targets pulled in from 0 and 1, by Newton steps."""
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-3 * at
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        at = at - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return float(at[0]), float(at[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> Model:
    """Fit on at most `sample` labelled documents of each class, outside the held-out fold: those first in the
    order of a hash of their ids. Only their feature lists come to the driver."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(
        F.min("quality").alias("_good")).where(remainder(F.col("doc_id"), folds) != 0)
    # Only ids that have a text to learn from take a place in the sample.
    marked = marked.join(docs.where(F.col("text").isNotNull()).select("doc_id").distinct(), "doc_id", "left_semi")
    marked = written(marked)
    chosen = first_by_hash(marked.where("_good = 0"), "doc_id", sample).unionByName(
        first_by_hash(marked.where("_good = 1"), "doc_id", sample))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "_good", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, feature = features(texts_of(batch))
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_good").cast(pa.int32()),
                 pa.array([feature[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:])], pa.binary())],
                names=["doc_id", "good", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(run, f"doc_id {kind}, good int, features binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["features"])))
    return fit([np.frombuffer(r["features"], dtype=np.int32) for r in rows], np.array([r["good"] == 1 for r in rows], dtype=bool))


def classify(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, sample: int = SAMPLE, folds: int = FOLDS) -> DataFrame:
    """All columns of `docs`, and held_out, score (0..1, higher: label 1 likelier) and predicted (1 from `accept`).

    The model is fitted on a bounded sample (see `train`) and has a fixed size, so its broadcast has one too;
    scoring reads every whole text once, without a shuffle. Scores see the text alone.

    A null text is empty; an empty text gets the score of a document without features; a null id counts as held
    out; repeated labels of an id count as the worst of them; without labels of both classes all scores are
    equal; an empty table gives no rows; columns named like a result column are replaced.
    """
    new = ("held_out", "score", "predicted")
    base = docs.drop(*new)
    shared = docs.sparkSession.sparkContext.broadcast(train(base, labels, sample, folds))
    marked = base.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), folds) == 0, F.lit(True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(texts_of(batch), batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array((scores >= accept).astype(np.int32))],
                names=[*batch.schema.names, "score", "predicted"])
        tidy()

    return marked.mapInArrow(run, extended(marked, "score double, predicted int"))
