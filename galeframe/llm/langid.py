"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are learned by follow-the-regularised-leader with elastic-net penalties, so most are
zero; a temperature fitted on held-out rows then calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from galeframe.llm.common import prepare
from galeframe.llm.learning import CharGrams, sample, sum_arrays, temperature
from galeframe.llm.textarray import slices

SCHEMA = "doc_id long, predicted string, probability double"


@dataclass(frozen=True)
class Settings:
    """per_class bounds the labelled rows that the weights are fitted on; all else covers every document."""

    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 15
    per_class: int = 1000
    epochs: int = 2
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.05
    scale: float = 30.0
    held_out: float = 0.2


@dataclass
class Model:
    """The classes' names, their biases, idf x weight for each n-gram and class (the last row is zero), and the temperature."""

    classes: list[str]
    bias: np.ndarray
    table: np.ndarray
    temperature: float
    settings: Settings

    def logits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated logits of each text, and its number of n-grams."""
        grams = CharGrams.of(column)
        total = np.zeros((len(column), len(self.classes)))
        count = np.zeros(len(column))
        for n in self.settings.orders:
            ids = grams.ids(n, self.settings.bits)
            total += grams.sums(self.table[ids])
            count += np.maximum(np.diff(grams.first) - n + 1, 0)
        z = total * (self.settings.scale / np.maximum(count, 1))[:, None] + self.bias
        return z / self.temperature, count


def document_frequencies(docs: DataFrame, settings: Settings) -> tuple[np.ndarray, float]:
    """In how many texts each n-gram occurs, over all documents, and the number of texts."""
    width = 1 << settings.bits

    def fill(batch: pa.RecordBatch, total: np.ndarray) -> None:
        column = batch.column(0)
        grams = CharGrams.of(column)
        owner = np.repeat(np.arange(len(column), dtype=np.int64) << settings.bits, np.diff(grams.first))
        pairs = []
        for n in settings.orders:
            ids = grams.ids(n, settings.bits)
            whole = ids < width
            pairs.append(owner[whole] | ids[whole])
        once = np.unique(np.concatenate(pairs))
        total[:width] += np.bincount(once & (width - 1), minlength=width)
        total[width] += len(column) - column.null_count

    out = sum_arrays(docs, width + 1, fill)
    return out[:width], out[width]


def _vectors(texts: list[str], idf: np.ndarray, settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for t in texts:
        grams = CharGrams.of(pa.array([t], pa.string()))
        ids = np.concatenate([grams.ids(n, settings.bits) for n in settings.orders])
        ids = ids[ids < 1 << settings.bits]
        at, count = np.unique(ids, return_counts=True)
        out.append((at, settings.scale * idf[at] * count / max(1, len(ids))))
    return out


def train(texts: list[str], target: list[str], weight: np.ndarray, df: np.ndarray, n_docs: float, settings: Settings) -> Model:
    """Fits the weights on all but the held-out rows, and the temperature on those."""
    s = settings
    classes = sorted(set(target))
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    x = _vectors(texts, idf, s)
    y = np.array([classes.index(t) for t in target])
    first_held = len(x) - int(len(x) * s.held_out)
    k = len(classes)
    width = len(idf) + 1  # the last row is the bias
    z, n = np.zeros((width, k)), np.zeros((width, k))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        w = -(zz - np.sign(zz) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)
        return np.where(np.abs(zz) <= s.l1, 0.0, w)

    for _ in range(s.epochs):
        for i in range(first_held):
            at, v = np.append(x[i][0], width - 1), np.append(x[i][1], 1.0)[:, None]
            w = weights(at)
            p = (v * w).sum(axis=0)
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = v * p * weight[i]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(width))
    table = np.vstack([w[:-1] * idf[:, None], np.zeros((1, k))]).astype(np.float32)
    model = Model(classes, w[-1], table, 1.0, s)
    held = pa.array(texts[first_held:], pa.string())
    model.temperature = temperature(model.logits(held)[0], y[first_held:], weight[first_held:]) if first_held < len(x) else 1.0
    return model


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model | None:
    """A model from the documents' own lang; None where no document has one."""
    rows = sample(docs, docs, "lang", settings.per_class)
    if not len(rows):
        return None
    df, n_docs = document_frequencies(docs, settings)
    return train(rows["text"].tolist(), rows["label"].tolist(), rows["weight"].to_numpy(), df, n_docs, settings)


def identify(docs: DataFrame, model: Model | None = None, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, predicted, probability) for every row of docs, over whole texts.

    Null and empty texts get null for both, as does every row where there is nothing to learn from. An empty table gives no rows. Ties go to
    the class first in the alphabet. Repeated rows and null ids stay; columns beside doc_id, text
    and lang are ignored. The model (a table of fixed size) is broadcast; rows are not shuffled.
    """
    prepare(docs.sparkSession)
    model = model or fit(docs, settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, limit=1 << 18):
                if m is None:
                    name, p = [None] * part.num_rows, np.zeros(part.num_rows)
                    none = np.ones(part.num_rows, dtype=bool)
                else:
                    z, count = m.logits(part.column(1))
                    z -= z.max(axis=1, keepdims=True)
                    p = 1 / np.exp(z).sum(axis=1)
                    none = count == 0
                    name = [None if x else m.classes[i] for i, x in zip(z.argmax(axis=1), none)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(name, pa.string()), pa.array(p, mask=none)], names=["doc_id", "predicted", "probability"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
