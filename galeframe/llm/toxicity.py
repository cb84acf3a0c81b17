"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Each text is the set of its n-grams. An n-gram's feature is its log-count ratio between toxic and
other labelled texts; logistic regression learns a weight for each. N-grams that tell the classes apart too little are
left out of the model, so a text is scored by the few informative ones that it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from galeframe.llm.common import prepare
from galeframe.llm.learning import CharGrams, sample, segment_sums, temperature
from galeframe.llm.textarray import slices

SCHEMA = "doc_id long, score double, probability double, toxic boolean"


@dataclass(frozen=True)
class Settings:
    """per_class bounds the labelled rows that the model is fitted on; every document is scored."""

    orders: tuple[int, ...] = (3, 4, 5)
    bits: int = 20
    per_class: int = 2000
    smoothing: float = 1.0
    least_ratio: float = 1.0
    least_texts: int = 4
    steps: int = 150
    rate: float = 0.5
    l2: float = 1e-3
    held_out: float = 0.2
    threshold: float = 0.5


@dataclass
class Model:
    """weight[i]: learned weight x log-count ratio of n-gram i (the last is zero); bias and temperature."""

    weight: np.ndarray
    bias: float
    temperature: float
    settings: Settings

    def scores(self, column: pa.Array) -> np.ndarray:
        """The calibrated logit of each text."""
        grams = CharGrams.of(column)
        width, docs, ids = len(self.weight), [], []
        owner = np.repeat(np.arange(len(column)), np.diff(grams.first))
        for n in self.settings.orders:
            of = grams.ids(n, self.settings.bits)
            hit = np.flatnonzero(self.weight[of])
            ids.append(of[hit])
            docs.append(owner[hit])
        once = np.unique(np.concatenate(docs) * np.int64(width) + np.concatenate(ids))
        total = np.bincount(once // width, weights=self.weight[once % width], minlength=len(column))
        return (total + self.bias) / self.temperature


def _set(text: str, settings: Settings) -> np.ndarray:
    """The text's distinct n-grams."""
    grams = CharGrams.of(pa.array([text], pa.string()))
    ids = np.unique(np.concatenate([grams.ids(n, settings.bits) for n in settings.orders]))
    return ids[ids < 1 << settings.bits]


def train(texts: list[str], target: np.ndarray, weight: np.ndarray, settings: Settings) -> Model:
    """Log-count ratios and weights from all but the held-out rows; the temperature from those."""
    s = settings
    width = 1 << s.bits
    split = len(texts) - int(len(texts) * s.held_out)
    y, w = target[:split].astype(float), weight[:split] / weight[:split].sum()
    toxic, other = np.zeros(width), np.zeros(width)
    for text, is_toxic in zip(texts[:split], y > 0.5):
        (toxic if is_toxic else other)[_set(text, s)] += 1
    p, q = (toxic + s.smoothing) / max(1, y.sum()), (other + s.smoothing) / max(1, (1 - y).sum())
    ratio = np.log(p / q)
    chosen = np.flatnonzero((np.abs(ratio) >= s.least_ratio) & (toxic + other >= s.least_texts))
    number = np.full(width, -1, dtype=np.int64)
    number[chosen] = np.arange(len(chosen))
    r = ratio[chosen]
    # Made again rather than kept: all n-grams of the sample would take much memory, the chosen ones take little.
    sets = [x[x >= 0].astype(np.int32) for x in (number[_set(t, s)] for t in texts[:split])]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    ids = np.concatenate(sets) if sets else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(split), np.diff(ends))
    beta = np.ones(len(chosen)) * 0.1
    bias = 0.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, s.steps + 1):
        z = segment_sums((beta * r)[ids], ends) + bias
        g = w * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.append(np.bincount(ids, weights=g[owner], minlength=len(chosen)) * r + s.l2 * beta / max(1, len(chosen)), g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        move = s.rate * 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        beta, bias = beta - move[:-1], bias - move[-1]
    table = np.zeros(width + 1, dtype=np.float32)
    table[chosen] = beta * r
    model = Model(table, float(bias), 1.0, s)
    if split < len(texts):
        z = np.concatenate([model.scores(pa.array(texts[i : i + 200], pa.string())) for i in range(split, len(texts), 200)])
        model.temperature = temperature(np.stack([np.zeros_like(z), z], axis=1), target[split:].astype(int), weight[split:])
    return model


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """A model from the labelled documents; None where they aren't of both classes."""
    rows: pd.DataFrame = sample(docs, labels, "toxic", settings.per_class)
    if rows["label"].nunique() < 2:
        return None
    return train(rows["text"].tolist(), (rows["label"] > 0).to_numpy().astype(int), rows["weight"].to_numpy(), settings)


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, score, probability, toxic) for every row of docs, over whole texts.

    Null texts get nulls. An empty text has no n-grams and gets the bias. Where the labels are not of
    both classes there is no model: score and probability are null and toxic is false. An empty table gives no rows. Repeated rows
    and null ids stay; other columns are ignored. The model (a table of fixed size) is broadcast;
    rows are not shuffled.
    """
    prepare(docs.sparkSession)
    model = model or fit(docs, labels, settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, limit=1 << 18):
                absent = np.asarray(part.column(1).is_null())
                z = np.zeros(part.num_rows) if m is None else m.scores(part.column(1))
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                unknown = absent | (m is None)
                toxic = (p >= m.settings.threshold) if m is not None else np.zeros(part.num_rows, dtype=bool)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(z, mask=unknown), pa.array(p, mask=unknown), pa.array(toxic, mask=absent)],
                    names=["doc_id", "score", "probability", "toxic"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
