"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or on a local master without it a temporary folder of our own; elsewhere its absence is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="galeframe-")
        _own.append(local)
        found = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: a cut in the lineage that outlives the loss of executors. It goes when the driver ends."""
    return store(df, name)[0]


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """stored() and the table's path, for discard()."""
    path = f"{shared_dir(df.sparkSession)}/galeframe-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that no later step reads."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if (spark, path) in _tables:
            _tables.remove((spark, path))


#: Rows up to which a small side is broadcast; larger ones are joined by a shuffle.
SMALL_ROWS = 200_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df with the hint to broadcast it if it has at most so many rows, which is counted first; else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@atexit.register
def _clear() -> None:
    for spark, path in list(_tables):
        try:
            discard(spark, path)
        except Exception:  # the session has ended; local folders are removed below, shared ones stay
            break
    for path in _own:
        shutil.rmtree(path, ignore_errors=True)
