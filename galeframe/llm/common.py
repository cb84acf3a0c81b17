"""Tables, scratch storage and connected components shared by the training-data operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
_scratch: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Workers give freed memory back, so what one job took isn't held while the next one runs.
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "131072", "MALLOC_TRIM_THRESHOLD_": "131072"}
#: Long texts make large batches of ten thousand rows; these bounds keep a batch, and its copies, to some MB.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "4194304")}


def prepare(spark: SparkSession) -> None:
    """Lets Python workers started on this host import the package, wherever the driver was started, and bounds their memory.

    Settings that the session has changed from Spark's defaults are left alone.
    """
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in paths.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, paths) if p)
    for name, value in WORKERS.items():
        environment.setdefault(name, value)
    for name, (default, value) in BATCHES.items():
        if spark.conf.get(name, default).removesuffix("B").removesuffix("b") == default:
            spark.conf.set(name, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on a local master one of our own.

    A cluster without that setting is an error, since a machine-local folder would not be seen by
    the other machines.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="galeframe-")
        spark.conf.set("spark.checkpoint.dir", found)
        _scratch.append((spark, found))
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def store(df: DataFrame, name: str, *partition_by: str) -> tuple[DataFrame, str]:
    """Writes df as a table in the shared folder, which cuts its lineage; the table and its path.

    The table outlives the loss of any executor. It goes when discard() is called or the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/galeframe-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _scratch.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """store() for tables that last until the driver ends."""
    return store(df, name)[0]


def scratch() -> set[str]:
    """The paths of all tables of store() that are still there."""
    return {path for _, path in _scratch}


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of store() that no later step reads."""
    for path in paths:
        _delete(spark, path)
        if (spark, path) in _scratch:
            _scratch.remove((spark, path))


@atexit.register
def _clear() -> None:
    for spark, path in _scratch:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended already; a local folder can still be removed
            if path.startswith("file:"):
                import shutil

                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def quoted(name: str) -> str:
    """The name as a column's own, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def hidden(docs: DataFrame, *first: str) -> tuple[DataFrame, list[Column]]:
    """docs with doc_id and text (or the columns named) beside all its columns under names of our own, and what gives the columns back their names."""
    names = docs.columns
    plain = docs.select(*(first or ("doc_id", "text")), *(F.col(quoted(c)).alias(f"_kept_{i}") for i, c in enumerate(names)))
    return plain, [F.col(f"_kept_{i}").alias(c) for i, c in enumerate(names)]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, label) of the ends of the edges (a, b): label is the least node of the component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        # A root takes the least label that any of its component's nodes sees.
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _forests(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the same components, at most one for each node of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
        size = 0

        def made() -> np.ndarray:
            node, label = forest(*np.concatenate(held, axis=1))
            return np.stack([node, label])[:, node != label]

        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            size += batch.num_rows
            if size > 1 << 20:
                held, size = [made()], 0
        u, v = made()
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, a: str = "a", b: str = "b", single: int = 1 << 22) -> DataFrame:
    """(node, label) for every node of the undirected edges; label is the least node of its component.

    Each partition's edges are cut to a forest first. Up to single edges (64 MB) are then solved in one task. Beyond that labels
    spread over the edges and are then shortened by one jump to the label's own label, so
    the rounds grow with the logarithm of a component's diameter. Each round's labels are a table
    in the shared folder. Null ends are no nodes. The result is the same either way.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    both, first_path = store(_forests(both), "forests")
    if both.count() <= single:

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [np.zeros((2, 0), np.int64), *(np.stack([c.to_numpy() for c in batch.columns]) for batch in batches)]
            node, label = forest(*np.concatenate(held, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], names=["node", "label"])

        labels, _ = store(both.coalesce(1).mapInArrow(solve, "node long, label long"), "labels")
        discard(spark, first_path)
        return labels
    both, both_path = store(both.union(both.select(F.col("v"), F.col("u"))).distinct(), "edges")
    discard(spark, first_path)
    labels, path = store(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels.node == near.u, "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")
        )
        spread, spread_path = store(spread, "spread")
        jump = spread.select(F.col("node").alias("at"), F.col("label").alias("onward"))
        moved = spread.join(jump, spread.label == jump["at"], "left").select(
            "node", "old", F.least("label", F.coalesce("onward", "label")).alias("label")
        )
        moved, moved_path = store(moved, "moved")
        changed = not moved.where("label <> old").isEmpty()
        discard(spark, path, spread_path)
        labels, path = moved.select("node", "label"), moved_path
        if not changed:
            discard(spark, both_path)
            return labels
