"""Labelled samples, sums of large arrays over partitions, and calibration, shared by the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeframe.llm.textarray import bytes_of, fold, slices

FAN_IN = 64
#: Chosen ids up to which they are broadcast to the documents.
BROADCAST = 200_000


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int = 17) -> pd.DataFrame:
    """(text, label, weight) of at most per_class labelled rows of each class, on the driver.

    Rows are chosen by the least hash of doc_id, so the choice doesn't depend on the order of the data. A weight is
    the class's share of the labelled rows over its share of the sample. Rows without a label, and
    labels whose document is absent, are left out; of repeated ids one row is taken.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label")).where("doc_id is not null and label is not null")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    # All classes in one pass: each task passes on no more than per_class ids of a class.
    nth = F.dense_rank().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id"))
    picked = [tuple(r) for r in known.withColumn("nth", nth).where(F.col("nth") <= per_class).select("doc_id", "label").distinct().collect()]
    kind = known.schema["label"].dataType
    chosen = spark.createDataFrame(sorted(picked), T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", kind)]))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen) if len(picked) <= BROADCAST else chosen, "doc_id").where("text is not null").toPandas()
    rows = rows.sort_values(["doc_id", "text", "label"]).drop_duplicates("doc_id")
    total, have = sum(counts.values()), rows["label"].value_counts()
    rows["weight"] = rows["label"].map({v: counts[v] / total * len(rows) / have[v] for v in have.index}).astype(float)
    order = pd.util.hash_array(rows["doc_id"].to_numpy(np.int64))
    return rows.iloc[np.argsort(order, kind="stable")].reset_index(drop=True)[["text", "label", "weight"]]


def sum_arrays(docs: DataFrame, size: int, fill: Callable[[pa.RecordBatch, np.ndarray], None], block: int = 1 << 17) -> np.ndarray:
    """The sum over all rows of docs of what fill adds to a float64 array of the given size.

    Each partition fills one array and gives it out in blocks, which are added in two rounds of FAN_IN
    arrays, so no task holds more than that many blocks; the driver adds what is left, one array for
    each FAN_IN ** 2 partitions. The result's size is fixed and doesn't grow with the data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size)
        some = False
        for batch in batches:
            for part in slices(batch):
                fill(part, total)
                some = True
        if some:
            blobs = [total[i : i + block].tobytes() for i in range(0, size, block)]
            at = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([at] * len(blobs), pa.int64()), pa.array(range(len(blobs)), pa.int64()), pa.array(blobs, pa.binary())],
                names=["part", "block", "blob"],
            )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(pdf["blob"].iloc[0]).copy()
        for blob in pdf["blob"].iloc[1:]:
            total += np.frombuffer(blob)
        return pd.DataFrame({"part": [pdf["part"].iloc[0] // FAN_IN], "block": [pdf["block"].iloc[0]], "blob": [total.tobytes()]})

    schema = "part long, block long, blob binary"
    sums = docs.select("text").mapInArrow(run, schema)
    for _ in range(2):
        sums = sums.groupBy("block", F.floor(F.col("part") / FAN_IN).alias("to")).applyInPandas(add, schema)
    out = np.zeros(size)
    for r in sums.collect():
        a = np.frombuffer(r["blob"])
        out[r["block"] * block : r["block"] * block + len(a)] += a
    return out


def temperature(logits: np.ndarray, target: np.ndarray, weight: np.ndarray) -> float:
    """The temperature in [0.05, 20] that makes the held-out rows likeliest; 1 if there are none.

    logits: (rows, classes); target: the classes' numbers.
    """
    if not len(target):
        return 1.0

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float(np.sum(weight * (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), target])))

    low, high = np.log(0.05), np.log(20.0)
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], dtype=np.uint32)


class CharGrams:
    """The character n-grams of texts, hashed to 2**bits numbers; ASCII and Latin-1 capitals are folded."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.point = np.frombuffer(fold(raw).tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        self.first = np.searchsorted(lead, offsets)

    @classmethod
    def of(cls, column: pa.Array) -> CharGrams:
        return cls(*bytes_of(column))

    def ids(self, n: int, bits: int) -> np.ndarray:
        """The n-gram's number at each character; 2**bits where the text ends before the n-gram does."""
        size = len(self.point)
        out = np.full(size, 1 << bits, dtype=np.int64)
        if size < n:
            return out
        with np.errstate(over="ignore"):
            h = np.full(size - n + 1, np.uint32(n * 0x2545F491 & 0xFFFFFFFF))
            for k in range(n):
                h ^= self.point[k : size - n + 1 + k]
                h *= _MULTIPLIERS[k]
                h ^= h >> np.uint32(15)
        out[: size - n + 1] = h >> np.uint32(32 - bits)
        for k in range(1, n):
            at = self.first[1:] - k
            out[at[at >= self.first[:-1]]] = 1 << bits
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Each text's sum of values, which has a row for each character."""
        return segment_sums(values, self.first)


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of values[first[i]:first[i + 1]] for each i."""
    out = np.zeros((len(first) - 1, *values.shape[1:]))
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.add.reduceat(values, first[some], axis=0)
    return out
