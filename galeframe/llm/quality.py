"""Quality: random-indexing word vectors pooled per document, and a two-layer network over them.

Every token has a sparse random index vector, made from its hash. A token's word vector is the sum of
the index vectors of its neighbours over the whole corpus. A document is pooled to the mean of its words'
vectors, their root mean square, and the mean product of adjacent vectors; a network with one hidden
layer, written in numpy, turns that into a probability, which a temperature calibrates.

A token is a word in its own case or a run of one punctuation character. Tokens share 2**bits vectors by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeframe.llm.common import hidden, prepare
from galeframe.llm.learning import sample, segment_sums, sum_arrays, temperature
from galeframe.llm.textarray import _IS_WORD, _TABLE, bytes_of, mix, powers, slices

SCHEMA = "doc_id long, probability double, keep boolean"
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Settings:
    """per_class bounds the labelled rows that the network is fitted on; vectors come from all documents.

    Documents are rejected where the probability of good quality is below a threshold, which is set on the held-out rows: the
    highest, up to even odds, that keeps the share keeps of the good ones among them; least, where there are none.
    """

    bits: int = 14
    dimensions: int = 32
    nonzeros: int = 2
    reach: int = 2
    per_class: int = 4000
    hidden: int = 24
    steps: int = 600
    rate: float = 0.01
    l2: float = 1e-4
    held_out: float = 0.2
    keeps: float = 0.995
    least: float = 0.25
    seed: int = 5


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' tokens, and the n + 1 offsets of each text's."""
    raw, offsets = bytes_of(column)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = _IS_WORD[raw]
    gap = _GAP[raw]
    begin = ~gap
    begin[1:] &= ~((word[1:] & word[:-1]) | (~word[1:] & (raw[1:] == raw[:-1])))
    begin[offsets[:-1][offsets[:-1] < n]] |= ~gap[offsets[:-1][offsets[:-1] < n]]
    start = np.flatnonzero(begin)
    stop = gap | begin
    places = np.append(np.flatnonzero(stop), n)
    end = places[np.searchsorted(places, start, side="right")] if len(start) else start
    bound = offsets[np.searchsorted(offsets, start, side="right")]
    end = np.minimum(end, bound)
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_TABLE[raw] * up[:n], out=total[1:])
        h = mix((total[end] - total[start]) * down[start])
    return h, np.searchsorted(start, offsets)


def word_vectors(docs: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Unit context vectors, (2**bits, dimensions), from the neighbours of every token of all documents."""
    s = settings
    v, d = 1 << s.bits, s.dimensions

    def fill(batch: pa.RecordBatch, total: np.ndarray) -> None:
        h, first = tokens(batch.column(0))
        if len(h) < 2:
            return
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        place = (h >> np.uint64(64 - s.bits)).astype(np.int64) * d
        for k in range(s.nonzeros):
            dim = ((h >> np.uint64(8 * k)) & np.uint64(d - 1)).astype(np.int64)
            sign = 1.0 - 2.0 * ((h >> np.uint64(8 * k + 6)) & np.uint64(1)).astype(float)
            at, value = [], []
            for gap in range(1, s.reach + 1):
                near = owner[gap:] == owner[:-gap]
                at += [place[gap:][near] + dim[:-gap][near], place[:-gap][near] + dim[gap:][near]]
                value += [sign[:-gap][near], sign[gap:][near]]
            total += np.bincount(np.concatenate(at), weights=np.concatenate(value), minlength=v * d)

    if d & (d - 1) or d > 64 or s.nonzeros > 4:
        raise ValueError("dimensions must be a power of two up to 64, nonzeros at most 4")
    sums = sum_arrays(docs, v * d, fill).reshape(v, d)
    return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(column: pa.Array, vectors: np.ndarray, settings: Settings) -> np.ndarray:
    """Each text's features, (rows, 3 x dimensions + 1): zero for a text without tokens."""
    h, first = tokens(column)
    x = vectors[(h >> np.uint64(64 - settings.bits)).astype(np.int64)]
    count = np.diff(first)
    many = np.maximum(count, 1)[:, None]
    pairs = np.zeros_like(x)
    if len(x) > 1:
        pairs[1:] = x[1:] * x[:-1]
        pairs[first[:-1][count > 0]] = 0
    mean = segment_sums(x, first) / many
    rms = np.sqrt(segment_sums(x * x, first) / many)
    return np.hstack([mean, rms, segment_sums(pairs, first) / np.maximum(count - 1, 1)[:, None], np.linalg.norm(mean, axis=1, keepdims=True)])


@dataclass
class Model:
    """The vectors, the features' centre and spread, the network's layers, and the temperature."""

    vectors: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    threshold: float
    settings: Settings

    def logits(self, column: pa.Array) -> np.ndarray:
        """The calibrated logit of good quality of each text."""
        return self._forward((pool(column, self.vectors, self.settings) - self.centre) / self.spread) / self.temperature

    def _forward(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def gradients(layers: list[np.ndarray], x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float) -> list[np.ndarray]:
    """The gradient of the weighted log loss plus l2 / 2 times the weights' squares, for each of (w1, b1, w2, b2)."""
    pre = x @ layers[0] + layers[1]
    hid = np.maximum(pre, 0)
    z = hid @ layers[2] + layers[3][0]
    g = w * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
    back = np.outer(g, layers[2]) * (pre > 0)
    return [x.T @ back + l2 * layers[0], back.sum(axis=0), hid.T @ g + l2 * layers[2], np.array([g.sum()])]


def train(texts: list[str], target: np.ndarray, weight: np.ndarray, vectors: np.ndarray, settings: Settings) -> Model:
    """Fits the network on all but the held-out rows, and the temperature on those."""
    s = settings
    x = np.vstack([pool(pa.array(texts[i : i + 100], pa.string()), vectors, s) for i in range(0, len(texts), 100)])
    split = len(texts) - int(len(texts) * s.held_out)
    centre, spread = x[:split].mean(axis=0), x[:split].std(axis=0) + 1e-6
    x = (x - centre) / spread
    y, w = target.astype(float), weight / weight[:split].sum()
    rng = np.random.default_rng(s.seed)
    layers = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], s.hidden)), np.zeros(s.hidden), rng.normal(0, np.sqrt(1 / s.hidden), s.hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in layers], [np.zeros_like(a) for a in layers]
    xt, yt, wt = x[:split], y[:split], w[:split]
    for step in range(1, s.steps + 1):
        for i, grad in enumerate(gradients(layers, xt, yt, wt, s.l2)):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad * grad
            layers[i] = layers[i] - s.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, centre, spread, layers[0], layers[1], layers[2], float(layers[3][0]), 1.0, s.least, s)
    if split < len(texts):
        z = model._forward(x[split:])
        model.temperature = temperature(np.stack([np.zeros_like(z), z], axis=1), target[split:].astype(int), weight[split:])
        good = np.sort(1 / (1 + np.exp(-np.clip(z[target[split:] > 0] / model.temperature, -500, 500))))
        if len(good):
            model.threshold = min(0.5, float(good[int((1 - s.keeps) * len(good))]))
    return model


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """A model from all documents and their quality labels; None where those aren't of both classes."""
    rows = sample(docs, labels, "quality", settings.per_class)
    if rows["label"].nunique() < 2:
        return None
    vectors = word_vectors(docs, settings)
    return train(rows["text"].tolist(), (rows["label"] > 0).to_numpy().astype(int), rows["weight"].to_numpy(), vectors, settings)


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, probability, keep) for every row of docs, over whole texts; probability is that of good quality.

    Null texts, and texts without a token, have no words to judge: probability null, keep false. Where labels
    are not of both classes there is no model: probability null, keep true for texts with tokens.
    Repeated rows and null ids stay, an empty table gives no rows; other columns are ignored. The model (tables of fixed size) is
    broadcast; rows are not shuffled.
    """
    scored = _scored(docs, labels, model, settings)
    return scored.select("doc_id", "probability", "keep")


def _scored(docs: DataFrame, labels: DataFrame, model: Model | None, settings: Settings, keep: tuple[str, ...] = ()) -> DataFrame:
    prepare(docs.sparkSession)
    model = model or fit(docs, labels, settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("probability", T.DoubleType()), T.StructField("keep", T.BooleanType()), *(docs.schema[c] for c in keep)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, limit=1 << 18):
                column = part.column(1)
                empty = np.diff(tokens(column)[1]) == 0
                if m is None:
                    p, good, unknown = np.zeros(part.num_rows), ~empty, np.ones(part.num_rows, dtype=bool)
                else:
                    p = 1 / (1 + np.exp(-np.clip(m.logits(column), -500, 500)))
                    good, unknown = (p >= m.threshold) & ~empty, empty
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(p, mask=unknown), pa.array(good), *part.columns[2:]], names=schema.names
                )

    return docs.select("doc_id", "text", *keep).mapInArrow(run, schema)


def reject(docs: DataFrame, labels: DataFrame, model: Model | None = None, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs that classify() keeps, with all their columns, whatever those are called."""
    plain, columns = hidden(docs)
    scored = _scored(plain, labels, model, settings, tuple(c for c in plain.columns if c.startswith("_kept_")))
    return scored.where("keep").select(*columns)
