"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are made unit length. In each table a hash consists of a few pseudo-rotations (random signs and fast
Hadamard transforms, three times over), each of which gives the signed axis nearest to the rotated vector. A query also probes
the buckets of the next nearest axes, as many as an audit against exact search finds to be needed. All candidates are ranked by their exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.llm.common import discard, prepare, store, stored
from galeframe.llm.textarray import mix

#: Vectors of one block where all are compared, vectors of a bucket that one task ranks, and large buckets whose list is broadcast.
BLOCK, LARGE, LISTED = 1 << 14, 1 << 14, 1 << 18
SCHEMA = "vec_id long, neighbour_id long, rank int, cosine double"


@dataclass(frozen=True)
class Settings:
    """k: neighbours of each vector; tables: independent hashes; bucket: vectors that a bucket holds on average.

    bucket sets how many rotations a hash has, so that buckets stay as large when the data grow. How many buckets of a table
    a query looks into is found by an audit: as few as give the recall on audit queries that are
    also searched exactly. Where the first that are tried do not, twice as many are, and so on; where that would look at
    as many vectors as there are, all vectors are compared.
    """

    k: int = 10
    tables: int = 8
    bucket: int = 1000
    recall: float = 0.96
    audit: int = 200
    first: int = 256
    rounds: int = 3
    seed: int = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Hadamard transform of each row, scaled to keep lengths; the row length is a power of two."""
    n, x = x.shape[1], x.copy()
    h = 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, table: int, part: int, s: Settings) -> np.ndarray:
    """The pseudo-rotation that belongs to a part of a table's hash."""
    rng = np.random.default_rng([s.seed, table, part])
    for _ in range(s.rounds):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def probes(x: np.ndarray, table: int, parts: int, axes: int, many: int, s: Settings) -> np.ndarray:
    """The buckets of each row in a table, nearest first, (rows, many).

    A last part may use only the first axes of its rotation, which makes buckets of the size asked for. Buckets of several parts are
    ordered by the sum of what their axes fall short of the nearest ones.
    """
    d = x.shape[1]
    total, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), dtype=np.int64)
    for part in range(parts):
        y = rotate(x, table, part, s)
        if part == parts - 1:
            y = y[:, :axes]
        signed = np.concatenate([y, -y], axis=1)
        most = min(many, signed.shape[1])
        order = np.argsort(-signed, axis=1, kind="stable")[:, :most]
        short = np.take_along_axis(signed, order, axis=1)
        short = (short[:, :1] - short) ** 2
        total = (total[:, :, None] + short[:, None, :]).reshape(len(x), -1)
        code = (code[:, :, None] * (2 * d) + order[:, None, :]).reshape(len(x), -1)
        best = np.argsort(total, axis=1, kind="stable")[:, :many]
        total, code = np.take_along_axis(total, best, axis=1), np.take_along_axis(code, best, axis=1)
    return code


def shape(n: int, d: int, s: Settings) -> tuple[int, int]:
    """How many parts a hash has and how many axes its last one uses, for n vectors and buckets of about the size asked for."""
    wanted, parts = max(2.0, n / s.bucket), 1
    while wanted > 2 * d:
        wanted, parts = wanted / (2 * d), parts + 1
    return parts, max(1, min(d, round(wanted / 2)))


def unit(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v): the usable vectors with length 1, as float32 bytes; one row an id.

    Left out are null ids, null or empty vectors, vectors with nulls or values that are not finite, and zero vectors, which have no direction.
    """
    a = F.col(column)
    usable = vectors.select(F.col(id_column).cast("long").alias("id"), a.cast("array<double>").alias("v")).where(
        "id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            x, first = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
            x = x / np.repeat(np.maximum.reduceat(np.abs(x), first[:-1]), size)  # no overflow when squared
            x = (x / np.repeat(np.sqrt(np.add.reduceat(x * x, first[:-1])), size)).astype(np.float32)
            out = [x[i:j].tobytes() for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "v"])

    return usable.mapInArrow(run, "id long, v binary").groupBy("id").agg(F.min("v").alias("v"))


def _best(dots: np.ndarray, k: int) -> np.ndarray:
    """The columns of each row's k largest values, descending; equal values by column."""
    k = min(k, dots.shape[1])
    if k == dots.shape[1]:
        return np.argsort(-dots, axis=1, kind="stable")
    top = np.sort(np.argpartition(-dots, k - 1, axis=1)[:, :k], axis=1)
    value = np.take_along_axis(dots, top, axis=1)
    tied = np.flatnonzero((dots >= value.min(axis=1, keepdims=True)).sum(axis=1) > k)
    if len(tied):
        top[tied] = np.sort(np.argsort(-dots[tied], axis=1, kind="stable")[:, :k], axis=1)
        value[tied] = np.take_along_axis(dots[tied], top[tied], axis=1)
    return np.take_along_axis(top, np.argsort(-value, axis=1, kind="stable"), axis=1)


def _padded(raw: list[bytes], d: int) -> np.ndarray:
    """The vectors of length d as rows, filled up with zeros to a power of two."""
    x = np.zeros((len(raw), 1 << (d - 1).bit_length()))
    x[:, :d] = np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), d)
    return x


def audited(reps: DataFrame, d: int, n: int, parts: int, axes: int, s: Settings) -> tuple[int, float]:
    """How many buckets a query must look into, and the recall that it then has on the audit's queries; 0 where it must be compared with all n vectors.

    The queries are those of the least hashes among the vectors that ask. Their true neighbours come from a comparison with all vectors, of which each
    partition gives out its k + 1 best, as numbers; the places of those neighbours' own buckets in the queries' lists tell
    the recall for any number of buckets, which is doubled until the recall is reached.
    """
    same = reps.where(F.length("v") == 4 * d)
    chosen = same.where("ask").orderBy(F.xxhash64("rep", F.lit(s.seed)), "rep").limit(s.audit).select("rep", "v").collect()
    asked = [bytes(r["v"]) for r in chosen]
    own = np.array([r["rep"] for r in chosen], dtype=np.int64)
    if not asked:
        return 1, 1.0
    queries = np.frombuffer(b"".join(asked), np.float32).reshape(-1, d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best, ids = np.full((len(queries), s.k + 1), -np.inf), np.full((len(queries), s.k + 1), -1, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, d)
                values = np.concatenate([best, queries @ x.T], axis=1)
                names = np.concatenate([ids, np.broadcast_to(batch.column(0).to_numpy(), (len(queries), len(x)))], axis=1)
                top = _best(values, s.k + 1)
                best, ids = np.take_along_axis(values, top, axis=1), np.take_along_axis(names, top, axis=1)
        q, c = np.nonzero(ids >= 0) if not np.isneginf(best).all() else (np.zeros(0, np.int64),) * 2
        some = ~np.isneginf(best[q, c])
        q, c = q[some], c[some]
        at = TaskContext.get().partitionId() % 256
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.full(len(q), at)), pa.array(-best[q, c].astype(float)), pa.array(ids[q, c])], names=["q", "at", "c", "f"])

    least = lambda x: F.slice(F.sort_array(F.collect_list(x)), 1, s.k + 1).alias("l")
    found = same.select("rep", "v").mapInArrow(run, "q long, at long, c double, f long").groupBy("q", "at").agg(least(F.struct("c", "f")))
    lists = found.select("q", F.explode("l").alias("x")).groupBy("q").agg(least(F.col("x"))).collect()
    pairs = [(r["q"], x["f"]) for r in lists for x in [y for y in r["l"] if y["f"] != own[r["q"]]][: s.k]]
    if not pairs:
        return 1, 1.0
    wanted = sorted({f for _, f in pairs})  # audit x k numbers at most
    vectors = {r["rep"]: bytes(r["v"]) for r in same.where(F.col("rep").isin(wanted)).select("rep", "v").collect()}
    q = np.array([i for i, _ in pairs])
    x, y = _padded(asked, d), _padded([vectors[f] for _, f in pairs], d)
    most = s.first
    while True:
        place = np.full(len(pairs), most)
        for table in range(s.tables):
            listed, home = probes(x, table, parts, axes, most, s)[q], probes(y, table, parts, axes, 1, s)
            hit = listed == home
            place = np.minimum(place, np.where(hit.any(axis=1), hit.argmax(axis=1), most))
        share = np.cumsum(np.bincount(place, minlength=most + 1)[:most]) / len(pairs)
        if share[-1] >= s.recall:
            many = int(np.argmax(share >= s.recall)) + 1
            return many, float(share[many - 1])
        if s.tables * most * s.bucket >= n:
            return 0, 1.0
        most *= 2


def _buckets(reps: DataFrame, forms: dict[int, tuple], s: Settings) -> DataFrame:
    """(d, table, bucket, rep, ask, v): each vector in its own bucket of each table (ask false), and each that asks in all that it looks into (ask true).

    forms: for each length of vectors the parts, axes and probes of its hashes, or where all are compared the blocks of
    vectors and of queries. Each pair of these blocks is then a bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(d, table, bucket, own, ids, asks, vectors):
            full = [np.broadcast_to(a, len(own)) for a in (np.int32(d), np.int32(table), bucket)]
            return pa.RecordBatch.from_arrays(
                [*(pa.array(a) for a in full), pa.array(ids[own]), pa.array(np.broadcast_to(asks, len(own))), vectors.take(pa.array(own))],
                names=["d", "table", "bucket", "rep", "ask", "v"],
            )

        for batch in batches:
            ids, vectors, ask = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()), np.asarray(batch.column(2).to_pylist(), dtype=bool)
            raw = vectors.to_pylist()
            lengths = np.array([len(r) // 4 for r in raw], dtype=np.int64)
            for d in np.unique(lengths).tolist():
                of = np.flatnonzero(lengths == d)
                if len(forms[d]) == 2:
                    blocks, queries = forms[d]
                    h = mix(ids.astype(np.int64).view(np.uint64))
                    block, query = (h % np.uint64(blocks)).astype(np.int64), (h % np.uint64(queries)).astype(np.int64)
                    for j in range(queries):
                        yield rows(d, -1, block[of] * queries + j, of, ids, False, vectors)
                    of = of[ask[of]]
                    for j in range(blocks):
                        yield rows(d, -1, j * queries + query[of], of, ids, True, vectors)
                    continue
                parts, axes, many = forms[d]
                for own, depth, asks in ((of, 1, False), (of[ask[of]], many, True)):
                    step = max(1, min(2048, (1 << 24) // (depth * min(depth, 4 * d))))
                    for at in range(0, len(own), step):
                        some = own[at : at + step]
                        x = _padded([raw[i] for i in some], d)
                        for table in range(s.tables):
                            code = probes(x, table, parts, axes, depth, s)
                            yield rows(d, table, code.ravel(), np.repeat(some, code.shape[1]), ids, asks, vectors)

    return reps.select("rep", "v", "ask").mapInArrow(run, "d int, table int, bucket long, rep long, ask boolean, v binary")


def _lists(reps: DataFrame, forms: dict[int, tuple], s: Settings) -> DataFrame:
    """(rep, all): the best k + 1 found of every vector that asks, itself among them; reps: (rep, v, ask).

    A bucket of more than LARGE vectors is cut into pieces, each of which gets all of the bucket's queries.
    """
    spark = reps.sparkSession
    hashed, place = _buckets(reps, forms, s), ["d", "table", "bucket"]
    sizes = _buckets(reps.withColumn("ask", F.lit(False)), forms, s).groupBy(*place).agg(F.count("*").alias("n"))
    large, path = store(sizes.where(F.col("n") > LARGE).select(*place, F.ceil(F.col("n") / LARGE).cast("int").alias("pieces")), "large")
    some = large.count()
    if some:
        hashed = hashed.join(F.broadcast(large) if some <= LISTED else large, place, "left")
    pieces = F.coalesce("pieces", F.lit(1)) if some else F.lit(1)
    all_pieces, own_piece = F.sequence(F.lit(0), pieces - 1), F.array(F.pmod(F.xxhash64("rep"), pieces).cast("int"))
    hashed = hashed.withColumn("piece", F.explode(F.when(F.col("ask"), all_pieces).otherwise(own_piece)))

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, ask = pdf["rep"].to_numpy(np.int64), pdf["ask"].to_numpy(bool)
        x = np.frombuffer(b"".join(pdf["v"]), np.float32).reshape(len(ids), -1)
        home, asks = np.flatnonzero(~ask), np.flatnonzero(ask)
        home = home[np.argsort(ids[home], kind="stable")]
        out = [pd.DataFrame({"rep": np.zeros(0, np.int64), "found": np.zeros(0, np.int64), "cosine": np.zeros(0)})]
        for at in range(0, len(asks) if len(home) else 0, 1024):
            mine = asks[at : at + 1024]
            part = x[mine]
            top = _best(part @ x[home].T, s.k + 1)
            row = np.repeat(np.arange(len(part)), top.shape[1])
            other = home[top.ravel()]
            cosine = (part[row].astype(np.float64) * x[other]).sum(axis=1)
            out.append(pd.DataFrame({"rep": ids[mine[row]], "found": ids[other], "cosine": cosine}))
        return pd.concat(out)

    found = hashed.groupBy(*place, "piece").applyInPandas(rank, "rep long, found long, cosine double")
    # A bucket's best k + 1, the query itself among them, hold all of its vectors that can be among the best k of all buckets.
    best = found.groupBy("rep", "found").agg(F.max("cosine").alias("cosine"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("c"), F.col("found").alias("f"))))
    out, _ = store(best.groupBy("rep").agg(F.slice(ordered, 1, s.k + 1).alias("all")), "lists")
    discard(spark, path)
    return out


def nearest(vectors: DataFrame, settings: Settings = Settings(), asking: Column | None = None) -> DataFrame:
    """(vec_id, neighbour_id, rank, cosine): of every vector that asks the k nearest of all by cosine, with the recall asked for.

    asking: a condition on the columns of vectors; None: all ask. Ties go to the smaller neighbour_id. Rows that unit() leaves out neither ask nor answer; of
    repeated ids one vector counts, and asks if any row of it does.
    Equal vectors are each other's neighbours; they are searched for once, whatever their number. Vectors of different lengths are
    compared only with their like. A vector whose buckets hold fewer than k others is compared with all; fewer than k rows come only
    where there are no more vectors. An empty table gives no rows. Other columns are ignored.
    """
    prepare(vectors.sparkSession)
    s = settings
    ask = F.lit(True) if asking is None else F.coalesce(asking, F.lit(False))
    wants = vectors.where(ask & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id")).distinct()
    units = stored(unit(vectors).join(wants.withColumn("ask", F.lit(True)), "id", "left").select("id", "v", F.coalesce("ask", F.lit(False)).alias("ask")), "units")
    reps = stored(units.groupBy("v").agg(F.min("id").alias("rep"), F.max("ask").alias("ask"), F.count("*").alias("n")), "reps")
    sizes = {r["size"] // 4: r["n"] for r in reps.groupBy(F.length("v").alias("size")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return units.sparkSession.createDataFrame([], SCHEMA)
    asked = {r["size"] // 4: r["n"] for r in reps.where("ask").groupBy(F.length("v").alias("size")).agg(F.count("*").alias("n")).collect()}
    forms = {}
    for d, n in sizes.items():
        parts, axes = shape(n, 1 << (d - 1).bit_length(), s)
        many = audited(reps, d, n, parts, axes, s)[0]
        forms[d] = (parts, axes, many) if many else (-(-n // BLOCK), max(1, -(-asked.get(d, 1) // BLOCK)))
    lists = _lists(reps, forms, s)
    least = F.coalesce(*(F.when(F.length("v") == 4 * d, F.lit(min(n, s.k + 1))) for d, n in sizes.items()))
    few = stored(lists.where(F.size("all") <= s.k).join(reps, "rep").where(F.size("all") < least).select("rep", "v"), "few")
    short = {r["size"] // 4: r["n"] for r in few.groupBy(F.length("v").alias("size")).agg(F.count("*").alias("n")).collect()}
    if short:
        again = reps.select("rep", "v").where(F.length("v").isin([4 * d for d in short])).join(few.select("rep", F.lit(True).alias("ask")), "rep", "left")
        blocks = {d: (-(-sizes[d] // BLOCK), -(-n // BLOCK)) for d, n in short.items()}
        lists = lists.join(few, "rep", "left_anti").unionByName(_lists(again.select("rep", "v", F.coalesce("ask", F.lit(False)).alias("ask")), blocks, s))
    # Of equal vectors a query needs k others at most, so the k + 1 least ids stand for all; they are chosen part by part first.
    twins = units.select("id", "v").join(reps.where("n > 1").select("v", "rep"), "v").select("id", "rep", F.pmod(F.xxhash64("id"), F.lit(256)).alias("salt"))
    for by in (("rep", "salt"), ("rep",)):
        twins = twins.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("nth") <= s.k + 1).drop("nth")
    copies = twins.groupBy("rep").agg(F.collect_list("id").alias("ids"))
    spread = lists.select("rep", F.explode("all").alias("x")).select("rep", "x.c", "x.f").join(copies.withColumnRenamed("rep", "f"), "f", "left")
    spread = spread.select("rep", "c", F.explode(F.coalesce("ids", F.array("f"))).alias("f"))
    full = spread.groupBy("rep").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "f"))), 1, s.k + 1).alias("all"))
    each = units.where("ask").select("id", "v").join(reps.select("v", "rep"), "v").select("id", "rep").join(full, "rep")
    others = F.slice(F.filter("all", lambda x: x["f"] != F.col("id")), 1, s.k)
    return each.select(F.col("id").alias("vec_id"), F.posexplode(others).alias("at", "x")).select(
        "vec_id", F.col("x.f").alias("neighbour_id"), (F.col("at") + 1).cast("int").alias("rank"), (-F.col("x.c")).alias("cosine")
    )
