"""SimHash near-deduplication by buckets and small-world graphs.

Each text has a 128-bit code, and a node falls into a bucket for each of several least hashes of its word pairs. Of h buckets two
texts of Jaccard similarity j share each with probability j, so with 20 buckets 3 pairs in a million at 0.55 share less than two. Nodes of a bucket are compared by their codes, in dense
buckets by a navigable small-world graph first; pairs are verified on the texts, and their union gives the groups. Then all pairs of a
bucket that are in no group together are compared. A sample's true partners, from an exact search and the texts, show
what share was joined. Where that falls short, all nodes are queries to graphs over all nodes, in shards, with beams that expand until
the recall asked for is reached.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.llm.common import components, discard, hidden, prepare, quoted, store
from galeframe.llm.learning import segment_sums
from galeframe.llm.smallworld import Graph, distance
from galeframe.llm.textarray import Words, mix, powers, slices, words


def _distinct(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Indices of the first of each (owner, hash)."""
    with np.errstate(over="ignore"):
        key = mix(hashes ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return np.sort(np.unique(key, return_index=True)[1])


def codes(w: Words) -> np.ndarray:
    """The (texts, 2) uint64 SimHash codes of the texts' sets of words, longer words counting more."""
    at = _distinct(w.hash, w.doc)
    weight = np.clip((w.end - w.start)[at] - 1, 1, 12).astype(np.float32)
    first = np.searchsorted(at, w.first)
    h = np.stack([mix(w.hash[at] ^ np.uint64(0x5851F42D4C957F2D)), mix(w.hash[at] ^ np.uint64(0x14057B7EF767814F))], axis=1)
    bits = np.unpackbits(h.view(np.uint8), axis=1).astype(np.float32)
    bits -= 0.5
    bits *= weight[:, None]
    return np.packbits(segment_sums(bits, first) > 0, axis=1).view(np.uint64)


def sequence_keys(w: Words) -> np.ndarray:
    """A hash of each text's words in their order."""
    up, down = powers(len(w.hash) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(w.hash) + 1, dtype=np.uint64)
        np.cumsum(w.hash * up[: len(w.hash)], out=total[1:])
        return mix((total[w.first[1:]] - total[w.first[:-1]]) * down[w.first[:-1]] + np.diff(w.first).astype(np.uint64))


#: Keys of candidates, and ids of texts that go, up to which they are broadcast; beyond that the sets, or texts, are shuffled.
BROADCAST = 500_000
SIGNATURE = "doc_id long, key long, hi long, lo long"


@dataclass(frozen=True)
class Settings:
    """radius: bits that two codes may differ in; similarity: least Jaccard similarity of the word-pair sets of near copies.

    hashes: buckets of a node; common: buckets that a pair has in common at least; dense: nodes of a bucket beyond which a graph gives each node's nearest, which otherwise all are compared for;
    shard: nodes of one graph; blocks: parts that the queries to one graph are split into; beam: nodes
    that a search starts with; recall: the share of a node's partners, of the audit nodes that have any, that the beam must find on average; partners:
    nearest codes of an audit node that are looked at; first: nearest pairs of a node that are verified before all others.
    """

    radius: int = 32
    similarity: float = 0.55
    shard: int = 1 << 20
    blocks: int = 16
    beam: int = 24
    recall: float = 0.95
    audit: int = 400
    partners: int = 64
    first: int = 4
    hashes: int = 20
    common: int = 2
    dense: int = 2048


def described(docs: DataFrame, hashes: int) -> DataFrame:
    """(doc_id, key, hi, lo, grams, buckets) of every row that has an id and a word; key is a hash of the words in order.

    grams: the distinct hashes of pairs of adjacent words, or of the single word. buckets: the least of them under each of so many orders.
    """
    odd = np.random.default_rng(23).integers(1, 1 << 63, hashes, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 18):
                w = words(part.column(1))
                some = np.flatnonzero((np.diff(w.first) > 0) & ~np.asarray(part.column(0).is_null()))
                code = codes(w).view(np.int64)[some]
                gram, first = _gram_sets(w)
                first = first[np.append(np.flatnonzero(np.diff(w.first) > 0), part.num_rows)]  # every text with a word has a gram
                with np.errstate(over="ignore"):
                    least = [mix(np.minimum.reduceat(gram * o, first[:-1]) + o) for o in odd] if len(first) > 1 else [gram] * hashes
                    least = np.stack(least, axis=1).view(np.int64)
                here = pa.array(np.searchsorted(np.flatnonzero(np.diff(w.first) > 0), some))
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(_short(gram)))
                buckets = pa.ListArray.from_arrays(pa.array(np.arange(len(least) + 1, dtype=np.int32) * hashes), pa.array(least.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()).take(pa.array(some)), pa.array(sequence_keys(w)[some].view(np.int64)), pa.array(code[:, 0]), pa.array(code[:, 1]), lists.take(here), buckets.take(here)],
                    names=["doc_id", "key", "hi", "lo", "grams", "buckets"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"{SIGNATURE}, grams array<int>, buckets array<long>")


def signatures(docs: DataFrame) -> DataFrame:
    """The doc_id, key, hi and lo of described()."""
    return described(docs, 1).select("doc_id", "key", "hi", "lo")


def graphs(nodes: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, int, str]:
    """Each shard's graph in pieces, the number of shards, and the table's path; nodes: (key, hi, lo), one row a key."""
    s = settings
    shards = max(1, -(-nodes.count() // s.shard))
    placed = nodes.select("key", "hi", "lo", _shard(shards).alias("shard"))
    piece = 1 << 16

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["key"].to_numpy(np.int64)
        order = np.argsort(mix(key.view(np.uint64)), kind="stable")
        key, code = key[order], pdf[["hi", "lo"]].to_numpy(np.int64)[order].view(np.uint64)
        graph = Graph.build(np.ascontiguousarray(code), s.beam)
        at = range(0, len(key), piece)
        return pd.DataFrame(
            {
                "shard": pdf["shard"].iloc[0],
                "piece": list(range(len(at))),
                "keys": [key[i : i + piece].tobytes() for i in at],
                "codes": [graph.codes[i : i + piece].tobytes() for i in at],
                "links": [graph.links[i : i + piece].tobytes() for i in at],
            }
        )

    out, path = store(placed.groupBy("shard").applyInPandas(build, "shard int, piece int, keys binary, codes binary, links binary"), "graphs")
    return out, shards, path


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key", F.lit(3)), F.lit(shards)).cast("int")


def search(made: DataFrame, shards: int, asking: DataFrame, settings: Settings, blocks: int, beam: int, labels: DataFrame | None = None) -> DataFrame:
    """(a, b, d): pairs of keys a < b whose codes differ in d <= radius bits, and a row (key, null, beam) for each node that may have more.

    Every node of asking, (key, hi, lo), is a query to every graph, as part of one of so many blocks, and gives the nearest
    nodes that a beam has room for. labels: (node, label); nodes of equal labels are no pairs then, and asking has
    the label of each too.
    """
    s = settings
    block = F.pmod(F.xxhash64("key", F.lit(9)), F.lit(blocks)).cast("int")
    labelled = labels is not None
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    code = [F.col("hi"), F.col("lo"), F.lit(True).alias("ask")]
    right = asking.select("key", *code, (F.col("label") if labelled else F.lit(None).cast("long")).alias("label"), block.alias("block"), every("shard", shards))
    if labelled:
        known = labels.join(asking.select("label").distinct(), "label").select(F.col("node").alias("key"), "label")
        zero = F.lit(0).cast("long")
        right = right.unionByName(known.select("key", zero.alias("hi"), zero.alias("lo"), F.lit(False).alias("ask"), "label", _shard(shards).alias("shard"), every("block", blocks)))
    left = made.select("*", every("block", blocks))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("piece")
        key = np.frombuffer(b"".join(left["keys"]), np.int64)
        code = np.frombuffer(b"".join(left["codes"]), np.uint64).reshape(-1, 2)
        links = np.frombuffer(b"".join(left["links"]), np.int32).reshape(len(key), -1) if len(key) else np.zeros((0, 1), np.int32)
        asks = right[right["ask"]]
        own = asks["key"].to_numpy(np.int64)
        if not len(key) or not len(own):
            return pd.DataFrame({"a": own[:0], "b": own[:0], "d": own[:0].astype(np.int32)})
        asked = np.ascontiguousarray(asks[["hi", "lo"]].to_numpy(np.int64)).view(np.uint64)
        order = np.argsort(key)
        find = lambda k: np.minimum(np.searchsorted(key, k, sorter=order), len(key) - 1)
        at = order[find(own)]
        apart = None
        if labelled:
            some = right[right["label"].notna()]
            number = pd.Series(pd.factorize(some["label"])[0], index=some.index)
            of_node, rows = np.full(len(key), -1), some[~some["ask"]]
            place = order[find(rows["key"].to_numpy(np.int64))]
            here = key[place] == rows["key"].to_numpy(np.int64)
            of_node[place[here]] = number[rows.index].to_numpy()[here]
            apart = of_node, number.reindex(asks.index).fillna(-2).to_numpy().astype(np.int64)
        q, node, more = Graph(code, links).within(asked, s.radius, beam, own=np.where(key[at] == own, at, -1), apart=apart)
        x, y = own[q], key[node]
        pairs = pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "d": distance(asked[q], code[node]).astype(np.int32)})
        more = pd.DataFrame({"a": own[more], "b": pd.NA, "d": np.int32(beam)})
        return pd.concat([pairs.astype({"b": "Int64"}), more.astype({"b": "Int64"})])

    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(run, "a long, b long, d int")


def _sample(nodes: DataFrame, settings: Settings) -> DataFrame:
    """The audit nodes: those of the least hashes."""
    return nodes.orderBy(F.xxhash64("key", F.lit(21)), "key").limit(settings.audit).select("key", "hi", "lo", "rep")


def _partners(nodes: DataFrame, sample: DataFrame, settings: Settings) -> DataFrame:
    """(q, a, b): the pairs of each audit node q with the nearest nodes within radius, by comparing it with all codes."""
    s = settings
    rows = sample.collect()
    own = np.array([r["key"] for r in rows], dtype=np.int64)
    asked = np.array([[r["hi"], r["lo"]] for r in rows], dtype=np.int64).reshape(-1, 2).view(np.uint64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in own]
        for batch in batches:
            key = batch.column(0).to_numpy()
            code = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1).view(np.uint64)
            for i, q in enumerate(asked):
                d = distance(code, q)
                near = np.flatnonzero((d <= s.radius) & (key != own[i]))
                if len(near):
                    best[i] = sorted(best[i] + list(zip(d[near].tolist(), key[near].tolist())))[: s.partners]
        flat = [(int(own[i]), d, k) for i, x in enumerate(best) for d, k in x]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in flat], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], names=["q", "d", "k"])

    near = nodes.select("key", "hi", "lo").mapInArrow(compare, "q long, d int, k long")
    near = near.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "k"))), 1, s.partners).alias("l")).select("q", F.explode("l.k").alias("k"))
    return near.select("q", F.least("q", "k").alias("a"), F.greatest("q", "k").alias("b"))


def audited(made: DataFrame, shards: int, nodes: DataFrame, docs: DataFrame, settings: Settings) -> tuple[int, float]:
    """The beam that finds the recall asked for, and the recall that it has, on the nodes of the least hashes; 1 where none has a partner.

    Each audit node is compared with all codes, and of its nearest ones within radius those whose texts are similar enough are its partners. A node whose
    beam holds nothing but pairs counts by what the beam has room for, as it is searched again. The beam doubles until it is wide
    enough; in the end each graph's search is a comparison with all of its nodes.
    """
    s = settings
    sample, path = store(_sample(nodes, s), "audit")
    pairs, pairs_path = store(_partners(nodes, sample, s), "audit")
    truth: dict[int, set] = {}
    true = verified(pairs.select("a", "b").distinct(), _sets(docs, nodes, pairs), s.similarity)
    for r in pairs.join(true, ["a", "b"]).collect():  # audit x partners rows at most
        truth.setdefault(r["q"], set()).add((r["a"], r["b"]))
    beam, recall = s.beam, 1.0
    most = min(s.shard, max(1, nodes.count()))
    while truth:
        found: dict[int, set] = {}
        full, members = set(), set(truth)
        for r in search(made, shards, sample.drop("rep"), s, 1, beam).collect():  # audit x beam x shards rows at most
            if r["b"] is None:
                full.add(r["a"])
                continue
            for q in (r["a"], r["b"]):
                if q in members:
                    found.setdefault(q, set()).add((r["a"], r["b"]))
        share = [len(found.get(q, set()) & t) / (min(len(t), max(1, len(found.get(q, set())))) if q in full else len(t)) for q, t in truth.items()]
        recall = float(np.mean(share))
        if recall >= s.recall or beam >= most:
            break
        beam *= 2
    discard(nodes.sparkSession, path, pairs_path)
    return beam, recall


def _pairs(found: DataFrame) -> DataFrame:
    return found.where("b is not null").groupBy("a", "b").agg(F.min("d").alias("d"))


def _gram_sets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's pairs of adjacent words, or of its single word; text i has those from first[i] to first[i + 1]."""
    at, h = w.grams(2)
    alone = w.first[:-1][np.diff(w.first) == 1]
    at, h = np.concatenate([at, alone]), np.concatenate([h, w.hash[alone]])
    order = np.argsort(at, kind="stable")
    owner, h = w.doc[at[order]], h[order]
    pick = _distinct(h, owner)
    return h[pick], np.searchsorted(owner[pick], np.arange(len(w.first)))


def _short(gram: np.ndarray) -> np.ndarray:
    return (gram >> np.uint64(32)).astype(np.uint32).view(np.int32)


def gram_sets(docs: DataFrame) -> DataFrame:
    """(key, grams): the distinct hashes of each text's pairs of adjacent words, or of its single word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 18):
                w = words(part.column(0))
                gram, first = _gram_sets(w)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(_short(gram)))
                yield pa.RecordBatch.from_arrays([pa.array(sequence_keys(w).view(np.int64)), lists], names=["key", "grams"])

    return docs.select("text").mapInArrow(run, "key long, grams array<int>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose gram sets have that Jaccard similarity or more."""
    left = sets.select(F.col("key").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("grams").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("shared") >= similarity * (F.size("x") + F.size("y") - F.col("shared"))).select("a", "b")


def _sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """gram_sets() of the texts that stand for the pairs' nodes."""
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    reps = nodes.join(keys, "key").select(F.col("rep").alias("doc_id")).distinct()
    return gram_sets(docs.select("doc_id", "text").join(reps, "doc_id", "left_semi")).dropDuplicates(["key"])


def _nearest(a: np.ndarray, b: np.ndarray, d: np.ndarray, many: int) -> np.ndarray:
    """Indices of the pairs that are among the nearest so many of one of their ends."""
    end, other, pair = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(np.arange(len(a)), 2)
    order = np.lexsort((other, np.tile(d, 2), end))
    end = end[order]
    start = np.flatnonzero(np.append(True, end[1:] != end[:-1])) if len(end) else np.zeros(0, np.int64)
    rank = np.arange(len(end)) - np.repeat(start, np.diff(np.append(start, len(end))))
    return np.unique(pair[order[rank < many]])


def _together(nodes: DataFrame, settings: Settings, labels: DataFrame | None = None) -> DataFrame:
    """(a, b, d): pairs of keys a < b that are found in so many common buckets, whose codes differ in d <= radius bits and whose sets' sizes allow for the similarity.

    nodes: (key, hi, lo, n, buckets). Without labels the nearest few of each node in a bucket, which a graph finds in a dense one; with
    labels, (node, label), all pairs of unlike labels, compared whatever the bucket's size. Nodes that have no label are their own.
    """
    s = settings
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.int32())])
    nearest = labels is None
    if labels is None:
        nodes = nodes.withColumn("label", F.col("key"))
    else:
        nodes = nodes.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    rows = nodes.select("key", "hi", "lo", "n", "label", F.explode("buckets").alias("bucket")).repartition("bucket")
    small = min(64, s.dense)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if not held:
            return
        key, hi, lo, n, label, bucket = (np.concatenate(x) for x in zip(*held))
        del held
        order = np.lexsort((key, label, bucket))
        start = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
        size = np.diff(np.append(start, len(order)))
        begun, ended = label[order][start], label[order][start + size - 1]
        order = order[np.repeat(begun != ended, size)]  # a bucket of one label has nothing to find
        size = size[begun != ended]
        start = np.cumsum(size) - size
        key, n, label, code = key[order], n[order], label[order], np.stack([hi[order], lo[order]], axis=1).view(np.uint64)

        def table(x: np.ndarray, y: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
            """The pairs of rows that may be near copies."""
            keep = (label[x] != label[y]) & (np.minimum(n[x], n[y]) >= s.similarity * np.maximum(n[x], n[y]) - 1e-6)
            x, y, d = key[x[keep]], key[y[keep]], d[keep]
            a, b = np.minimum(x, y), np.maximum(x, y)
            if nearest:
                at = _nearest(a, b, d, s.first)
                a, b, d = a[at], b[at], d[at]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d.astype(np.int32))], schema=kind)

        def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            d = np.bitwise_count(code[x, 0] ^ code[y, 0])
            d += np.bitwise_count(code[x, 1] ^ code[y, 1])
            return d

        few = np.flatnonzero(size <= small)
        cuts = np.searchsorted(np.cumsum(size[few]), np.arange(1 << 15, size[few].sum() + (1 << 15), 1 << 15))
        for part in np.split(few, np.unique(cuts[cuts < len(few)])):
            if not len(part):
                continue
            row = np.repeat(start[part] - (np.cumsum(size[part]) - size[part]), size[part]) + np.arange(size[part].sum())
            end, found, step = np.repeat(start[part] + size[part], size[part]), [], 1
            while len(row):
                row, end = row[row + step < end], end[row + step < end]
                d = close(row, row + step)
                hit = d <= s.radius
                found.append((row[hit], row[hit] + step, d[hit].astype(np.int64)))
                step += 1
            yield table(*(np.concatenate(x) for x in zip(*found)))
        for at, many in zip(start[size > small], size[size > small]):
            own = code[at : at + many]
            if nearest and many > s.dense:
                q, node, _ = Graph.build(np.ascontiguousarray(own), s.beam).within(own, s.radius, s.beam, own=np.arange(many))
                yield table(at + q, at + node, distance(own[q], own[node]))
                continue
            # The largest label's nodes come last: no two of them are compared.
            mine = label[at : at + many]
            begin = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
            long = np.diff(np.append(begin, many))
            most = int(np.argmax(long))
            own_rows = np.concatenate([np.arange(begin[most]), np.arange(begin[most] + long[most], many), np.arange(begin[most], begin[most] + long[most])]) + at
            own, high, low = label[own_rows], code[own_rows, 0], code[own_rows, 1]
            rest, step = many - long[most], max(1, (1 << 22) // many)
            for i in range(0, rest, step):
                to = min(rest, i + step)
                d = np.bitwise_count(high[i:to, None] ^ high[None, i:])
                d += np.bitwise_count(low[i:to, None] ^ low[None, i:])
                x, y = np.nonzero(d <= s.radius)
                d = d[x, y].astype(np.int64)
                ahead = (y > x) & (own[i + x] != own[i + y])
                yield table(own_rows[i + x[ahead]], own_rows[i + y[ahead]], d[ahead])

    return rows.mapInArrow(run, "a long, b long, d int").groupBy("a", "b").agg(F.min("d").alias("d"), F.count("*").alias("n")).where(F.col("n") >= min(s.common, s.hashes)).drop("n")


def _kept_sets(full: DataFrame, pairs: DataFrame) -> tuple[DataFrame, str]:
    """(key, grams) of the pairs' nodes, and the table's path; full: described()."""
    keys, path = store(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "keys")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST else keys
    sets, where = store(full.select("key", "grams").join(keys, "key", "left_semi").dropDuplicates(["key"]), "sets")
    discard(full.sparkSession, path)
    return sets, where


def joined_share(nodes: DataFrame, full: DataFrame, labels: DataFrame, settings: Settings) -> float:
    """The share of a node's partners that are in its group, on average over the audit nodes that have any; 1 where none has."""
    s = settings
    sample, path = store(_sample(nodes, s), "audit")
    pairs, pairs_path = store(_partners(nodes, sample, s), "audit")
    sets, sets_path = _kept_sets(full, pairs)
    true = verified(pairs.select("a", "b").distinct(), sets, s.similarity)
    found = pairs.join(true, ["a", "b"])
    for x in "ab":
        found = found.join(labels.select(F.col("node").alias(x), F.col("label").alias(f"of_{x}")), x, "left")
    share = found.groupBy("q").agg(F.avg(F.coalesce(F.col("of_a") == F.col("of_b"), F.lit(False)).cast("double")).alias("share")).agg(F.avg("share")).first()[0]
    discard(nodes.sparkSession, path, pairs_path, sets_path)
    return 1.0 if share is None else float(share)


def _members(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, key, group_id, kept) for every row of a group."""
    prepare(docs.sparkSession)
    spark, s = docs.sparkSession, settings
    scratch: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        out, path = store(df, name)
        scratch.append(path)
        return out

    def checked(pairs: DataFrame) -> DataFrame:
        sets, path = _kept_sets(full, pairs)
        out = kept(verified(pairs, sets, s.similarity), "edges")
        discard(spark, path)
        return out

    full = kept(described(docs, s.hashes), "signatures")
    nodes = full.select("doc_id", "key", "hi", "lo", F.size("grams").alias("n"), "buckets").groupBy("key")
    nodes = kept(nodes.agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("hi", "lo", "n", "buckets"))), "nodes")
    pairs = kept(_together(nodes, s), "pairs")
    ends = pairs.select(F.col("a").alias("u"), "a", "b", "d").union(pairs.select("b", "a", "b", "d"))
    near = Window.partitionBy("u").orderBy("d", "a", "b")
    nearest = kept(ends.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= s.first).select("a", "b").distinct(), "nearest")
    edges = checked(nearest)
    labels = components(edges)
    rest = kept(_together(nodes, s, labels).join(nearest, ["a", "b"], "left_anti").select("a", "b"), "rest")
    more = checked(rest)
    if not more.isEmpty():
        edges = edges.union(more)
        labels = components(edges)
    if joined_share(nodes, full, labels, s) < s.recall:
        labels = _searched(docs, nodes, edges, labels, s, kept)
    joined = nodes.join(labels, nodes.key == labels.node, "left").select("key", F.coalesce("label", "key").alias("label"))
    members = kept(full.select("doc_id", "key").join(joined, "key"), "members")
    group = members.groupBy("label").agg(F.min(F.struct("doc_id", "key")).alias("least"), F.count("*").alias("n")).where("n > 1")
    is_least = (F.col("doc_id") == F.col("least.doc_id")) & (F.col("key") == F.col("least.key"))
    out, _ = store(members.join(group, "label").select("doc_id", "key", F.col("least.doc_id").alias("group_id"), is_least.alias("kept")), "groups")
    discard(spark, *scratch)
    return out


def _searched(docs: DataFrame, nodes: DataFrame, edges: DataFrame, labels: DataFrame, settings: Settings, kept: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The labels after a search of all graphs for all nodes, for what is near and in no group with them.

    Nodes whose beam held nothing but pairs look again, with wider beams while theirs stay full.
    """
    s = settings
    made, shards, path = graphs(nodes.select("key", "hi", "lo"), s)
    beam, _ = audited(made, shards, nodes, docs, s)
    asking, tested = nodes.select("key"), None
    while many := asking.count():
        ask = nodes.join(asking, "key").join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", "hi", "lo", "label")
        found = kept(search(made, shards, ask, s, s.blocks if tested is None else min(s.blocks, -(-many // 2048)), beam, labels), "found")
        fresh = _pairs(found).select("a", "b")
        fresh = kept(fresh if tested is None else fresh.join(tested, ["a", "b"], "left_anti"), "fresh")
        more = kept(verified(_across(fresh, labels), _sets(docs, nodes, fresh), s.similarity), "edges")
        if not more.isEmpty():
            edges = edges.union(more)
            labels = components(edges)
        tested, beam = fresh if tested is None else tested.union(fresh), beam * 2
        asking = found.where("b is null").select(F.col("a").alias("key")).distinct()
    discard(docs.sparkSession, path)
    return labels


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes aren't in one component."""
    of = [labels.select(F.col("node").alias(x), F.col("label").alias(f"of_{x}")) for x in "ab"]
    both = pairs.select("a", "b").join(of[0], "a", "left").join(of[1], "b", "left")
    return both.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def groups(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, group_id, kept) for every row that has copies or near copies; group_id is the group's least doc_id.

    Texts with the same words in the same order are copies. Others are near copies if the search finds
    their codes within radius and their sets of word pairs are similar enough; groups are the connected components.
    Rows with a null id, and texts that are null or without a word, are in no group, and an empty table has none. Repeated rows form a
    group; kept is true for the rows of the text that stays, which has the least id. Of one id with several texts, each text is
    grouped by itself; where several of its texts are in one group, one of them (that of the least key) stays. Other columns are ignored.

    The nearest few pairs of each node are verified first; of the others only those that would still join
    two components, so a large group is not compared pair by pair and the result is the same.
    """
    return _members(docs, settings).select("doc_id", "group_id", "kept")


def clean(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs without all but one document of each group; rows in no group stay, and so do null ids and texts without words.

    A row goes for its own text: another text of the same id stays. All columns stay, whatever they are called.
    """
    found = _members(docs, settings)
    gone, _ = store(found.where("not kept").select("doc_id").distinct(), "gone")
    few = gone.count() <= BROADCAST  # else all texts are shuffled
    twice = docs.select("doc_id").where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    twice, _ = store(twice.join(found.select("doc_id"), "doc_id", "left_semi"), "twice")
    out = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))
    if twice.isEmpty():
        return out

    @F.pandas_udf("long")
    def key(text: pd.Series) -> pd.Series:
        w = words(pa.array(text, pa.string()))
        return pd.Series(sequence_keys(w).view(np.int64)).astype("Int64").mask(np.diff(w.first) == 0)

    plain, columns = hidden(docs.join(twice, "doc_id", "left_semi"))
    keyed = plain.withColumn("_key", key("text"))
    pairs = found.join(twice, "doc_id", "left_semi").select(F.col("doc_id").alias("_id"), F.col("key").alias("_of"), "kept").distinct()
    judged = keyed.join(pairs, (F.col("doc_id") == F.col("_id")) & (F.col("_key") == F.col("_of")), "left")
    free = judged.where("kept is null").select(*columns)
    once = judged.where("kept").dropDuplicates(["doc_id", "_key"]).select(*columns)
    lone = docs.join(gone.union(twice).distinct(), "doc_id", "left_anti").select(*map(quoted, docs.columns))
    return lone.union(free).union(once)
