"""HTML extraction: a bidirectional LSTM in numpy labels every leaf block of a page as article or not."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonframe.llm.common import extended, first_by_hash
from seasonframe.llm.html_blocks import Block, blocks
from seasonframe.llm.html_examples import example_pages, weak_label

# Pages of the table that the model is fitted on beside generated ones, and the longest such page in characters.
SAMPLE = 300
SAMPLE_CHARS = 100_000

# Hashed names of the path, hashed words, plain numbers, and the width of each direction's state.
PATH, WORDS, NUMBERS, STATE = 512, 64, 8, 24
DENSE = WORDS + NUMBERS

# Blocks of pages that are labelled together, padding included.
GROUP_BLOCKS = 20_000


def path_ids(block: Block) -> tuple[int, ...]:
    return tuple(sorted({zlib.crc32(name.encode()) % PATH for name in (*block.path, f"self:{block.tag}")}))


def dense(block: Block) -> np.ndarray:
    words = block.text.split()
    out = np.zeros(DENSE, dtype=np.float32)
    out[:WORDS] = np.bincount([zlib.crc32(w.lower().encode("utf-8", "replace")) % WORDS for w in words], minlength=WORDS) / len(words)
    n = len(block.text)
    out[WORDS:] = (np.log1p(n) / 5, np.log1p(len(words)) / 4, min(1.0, block.link_chars / n),
                   sum(w[0].isupper() for w in words) / len(words), block.text[-1] in ".!?:;…", "©" in block.text or "|" in block.text,
                   sum(map(block.text.count, ".,;")) / n * 10, 1.0)
    return out


@dataclass
class Tagger:
    """Two LSTMs, one in each direction, and a logistic output that also sees the block itself."""

    seed: int = 11
    p: dict[str, np.ndarray] = field(default_factory=dict)
    _paths: dict[tuple[int, ...], np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.p:
            rng = np.random.default_rng(self.seed)
            for d in "fb":
                self.p[f"x{d}"] = rng.normal(0, 0.1, (PATH + DENSE, 4 * STATE)).astype(np.float32)
                self.p[f"h{d}"] = rng.normal(0, STATE ** -0.5, (STATE, 4 * STATE)).astype(np.float32)
                self.p[f"c{d}"] = np.repeat(np.array([0, 1, 0, 0], dtype=np.float32), STATE)
                self.p[f"o{d}"] = rng.normal(0, STATE ** -0.5, STATE).astype(np.float32)
            self.p["ox"] = np.zeros(PATH + DENSE, dtype=np.float32)
            self.p["c"] = np.zeros(1, dtype=np.float32)

    def __getstate__(self) -> dict:
        return {"seed": self.seed, "p": self.p, "_paths": {}}

    @staticmethod
    def _reversed(lengths: np.ndarray, steps: int) -> np.ndarray:
        """For every step and page the step read by the backward direction: its mirror inside the page."""
        t = np.arange(steps)[:, None]
        return np.where(t < lengths, lengths - 1 - t, t)

    def _lstm(self, xw: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        steps, n, _ = xw.shape
        h = c = np.zeros((n, STATE), dtype=np.float32)
        out, cache = np.empty((steps, n, STATE), dtype=np.float32), []
        for t in range(steps):
            z = xw[t] + h @ self.p[f"h{d}"]
            gates = 1 / (1 + np.exp(-z))
            i, f, o = gates[:, :STATE], gates[:, STATE:2 * STATE], gates[:, 3 * STATE:]
            g = np.tanh(z[:, 2 * STATE:3 * STATE])
            before, c = c, f * c + i * g
            tanh_c = np.tanh(c)
            if keep:
                cache.append((h, before, i, f, g, o, tanh_c))
            h = o * tanh_c
            out[t] = h
        return out, cache

    def probabilities(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Chance of each block to be article text, pages of like length together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if pages[i]]
        group: list[int] = []
        for k, i in enumerate(order):
            group.append(i)
            if k + 1 == len(order) or len(pages[order[k + 1]]) * (len(group) + 1) > GROUP_BLOCKS:
                for j, found in zip(group, self._group([pages[j] for j in group])):
                    out[j] = found
                group = []
        return out

    def _path(self, ids: tuple[int, ...]) -> np.ndarray:
        """What a path adds to the inputs of both directions and of the output; paths repeat on and across pages."""
        found = self._paths.get(ids)
        if found is None:
            if len(self._paths) > 20_000:
                self._paths.clear()
            at = list(ids)
            found = self._paths[ids] = np.concatenate(
                [self.p["xf"][at].sum(axis=0), self.p["xb"][at].sum(axis=0), self.p["ox"][at].sum(keepdims=True)])
        return found

    def _group(self, pages: list[list[Block]]) -> list[np.ndarray]:
        lengths = np.array([len(p) for p in pages])
        steps, n = int(lengths.max()), len(pages)
        weights = np.concatenate([self.p["xf"][PATH:], self.p["xb"][PATH:], self.p["ox"][PATH:, None]], axis=1)
        flat = [b for p in pages for b in p]
        inputs = np.stack([self._path(path_ids(b)) for b in flat]) + np.stack([dense(b) for b in flat]) @ weights
        grid = np.zeros((steps, n, inputs.shape[1]), dtype=np.float32)
        page = np.repeat(np.arange(n), lengths)
        step = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        grid[step, page] = inputs
        width = 4 * STATE
        mirror = self._reversed(lengths, steps)
        hf, _ = self._lstm(grid[:, :, :width] + self.p["cf"], "f", False)
        hb, _ = self._lstm(np.take_along_axis(grid[:, :, width:2 * width], mirror[:, :, None], axis=0) + self.p["cb"], "b", False)
        hb = np.take_along_axis(hb, mirror[:, :, None], axis=0)
        z = hf @ self.p["of"] + hb @ self.p["ob"] + grid[:, :, -1] + self.p["c"]
        found = 1 / (1 + np.exp(-z[step, page]))
        return np.split(found, np.cumsum(lengths)[:-1])

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss over the blocks of a padded batch (steps, pages, inputs) and its gradient."""
        steps, n, width = x.shape
        mirror = self._reversed(lengths, steps)
        xr = np.take_along_axis(x, mirror[:, :, None], axis=0)
        hf, cache_f = self._lstm((x.reshape(-1, width) @ self.p["xf"] + self.p["cf"]).reshape(steps, n, -1), "f", True)
        hr, cache_b = self._lstm((xr.reshape(-1, width) @ self.p["xb"] + self.p["cb"]).reshape(steps, n, -1), "b", True)
        hb = np.take_along_axis(hr, mirror[:, :, None], axis=0)
        z = hf @ self.p["of"] + hb @ self.p["ob"] + x @ self.p["ox"] + self.p["c"]
        prob = 1 / (1 + np.exp(-z))
        real = np.arange(steps)[:, None] < lengths
        loss = -np.log(np.where(y == 1, prob, 1 - prob) + 1e-7)[real].mean()
        dz = ((prob - y) * real / real.sum()).astype(np.float32)
        grad = {"of": np.einsum("tn,tnh->h", dz, hf), "ob": np.einsum("tn,tnh->h", dz, hb),
                "ox": np.einsum("tn,tnd->d", dz, x), "c": dz.sum(keepdims=True).reshape(1)}
        dzr = np.take_along_axis(dz, mirror, axis=0)
        for d, dh_out, inputs, cache in (("f", dz[:, :, None] * self.p["of"], x, cache_f), ("b", dzr[:, :, None] * self.p["ob"], xr, cache_b)):
            dgates, dh, dc = np.empty((steps, n, 4 * STATE), dtype=np.float32), 0, 0
            dwh = np.zeros_like(self.p[f"h{d}"])
            for t in range(steps - 1, -1, -1):
                h, before, i, f, g, o, tanh_c = cache[t]
                dh = dh_out[t] + dh
                dc = dh * o * (1 - tanh_c * tanh_c) + dc
                dgates[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dc * i * (1 - g * g), dh * tanh_c * o * (1 - o)], axis=1)
                dwh += h.T @ dgates[t]
                dh, dc = dgates[t] @ self.p[f"h{d}"].T, dc * f
            flat = dgates.reshape(-1, 4 * STATE)
            grad |= {f"x{d}": inputs.reshape(-1, width).T @ flat, f"h{d}": dwh, f"c{d}": flat.sum(axis=0)}
        return float(loss), grad


def fit(pages: list[list[Block]], passes: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 3) -> Tagger:
    """Adam over shuffled batches of labelled pages; some names of each path are hidden, so that neighbours count."""
    model, rng = Tagger(), np.random.default_rng(seed)
    pages = [p for p in pages if p]
    paths = [[path_ids(b) for b in p] for p in pages]
    numbers = [np.stack([dense(b) for b in p]) for p in pages]
    labels = [np.array([b.label for b in p], dtype=np.float32) for p in pages]
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    order, step = sorted(range(len(pages)), key=lambda i: len(pages[i])), 0
    groups = [order[i:i + batch] for i in range(0, len(order), batch)]
    for number in range(passes):
        for g in rng.permutation(len(groups)):
            chosen = groups[g]
            lengths = np.array([len(pages[i]) for i in chosen])
            x = np.zeros((int(lengths.max()), len(chosen), PATH + DENSE), dtype=np.float32)
            y = np.zeros(x.shape[:2], dtype=np.float32)
            for k, i in enumerate(chosen):
                for t, ids in enumerate(paths[i]):
                    x[t, k, list(ids)] = 1
                x[:lengths[k], k, PATH:] = numbers[i]
                y[:lengths[k], k] = labels[i]
            x[:, :, :PATH] *= rng.random(x[:, :, :PATH].shape, dtype=np.float32) > 0.05
            _, grad = model.gradients(x, lengths, y)
            step += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in grad.values()))
            pace = rate * (1 - 0.9 * number / passes) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for k, v in grad.items():
                v = v / max(1.0, norm)
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                model.p[k] = (model.p[k] - pace * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return model


def train(pages: DataFrame, sample: int = SAMPLE) -> Tagger:
    """Fit on generated pages of many layouts, with words of a bounded sample of the table, and on that sample's
    pages with labels from their tags and names where these say enough."""
    usable = pages.where((F.length("html") > 0) & (F.length("html") <= SAMPLE_CHARS)).select("page_id", "html")
    rows = first_by_hash(usable, "page_id", sample, "html").select("html").collect()
    real = [blocks(r["html"]) for r in rows]
    for page in real:
        for b in page:
            b.label = weak_label(b)
    sentences = [b.text for page in real for b in page if b.label == 1]
    generated = [blocks(p) for p in example_pages(sentences)]
    return fit([p for p in real if all(b.label >= 0 for b in p)] + [[b for b in p if b.label >= 0] for p in generated])


def extract(pages: DataFrame, sample: int = SAMPLE, accept: float = 0.5) -> DataFrame:
    """All columns of `pages`, and text (article blocks joined by two newlines, empty if none) and n_chars.

    Every block of every page is labelled, whatever the page's length; pages of like length go through the
    network together, a very long one alone. The model has a fixed size and is fitted on a bounded sample (see
    `train`), so its broadcast is bounded; there is no shuffle.

    A null or empty html has no blocks; broken markup is read as far as it goes; repeated rows each get their
    text; an empty table gives no rows (the model then knows generated pages alone); columns named text or
    n_chars are replaced.
    """
    base = pages.drop("text", "n_chars")
    shared = pages.sparkSession.sparkContext.broadcast(train(base, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                found = [blocks(h or "") for h in part.column("html").to_pylist()]
                texts = ["\n\n".join(b.text for b, p in zip(page, probability) if p >= accept)
                         for page, probability in zip(found, model.probabilities(found))]
                texts = [t.encode("utf-8", "replace").decode() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*part.schema.names, "text", "n_chars"])

    return base.mapInArrow(run, extended(base, "text string, n_chars long"))
