"""Suffix-array deduplication: passages of 50 words and more that occur more than once.

Texts go to shards as they are read. Two rounds follow, each of which merges lists of the shards by binary search:

1. Which texts share anything. Anchors are a sparse choice of word runs, made by their content, of which every passage holds
   one. Each shard's list of anchors is sorted and merged with the others'; anchors seen twice mark the places that round two covers.
2. Which passages are equal. Each shard of the marked texts has a suffix array of its words, refined as Larsson and Sadakane
   do. Kasai's common prefixes cut it into classes: stretches of suffixes that agree in 50 words or more. A class is all that
   the shard says of such a passage: the array's members stay where they are, and one entry (its least place, and whether it has
   others) goes into the shard's sorted list. The lists are merged by binary search, each shard gets back the least place of
   the classes that other shards hold too, and its own array's members are then joined to spans.

So a passage that is in many documents costs each shard one entry, however often it occurs there. Word order across shards isn't
comparable without the words themselves, so the lists are ordered by a 64-bit name of the words that are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import discard, hidden, prepare, store
from galeframe.llm.suffixes import anchors, classes
from galeframe.llm.textarray import grams, slices, words

SCHEMA = "doc_id long, first_word long, n_words long, duplicate boolean, source_doc_id long"
#: A shard's sorted list: names of what is compared, the least place of each, and whether the shard has it at other places too.
LIST = "shard long, keys binary, docs binary, starts binary, many binary"


@dataclass(frozen=True)
class Settings:
    """least: words of a passage; shard: words of which one suffix array is made (a single text may have more)."""

    least: int = 50
    shard: int = 1_000_000

    @property
    def k(self) -> int:
        """Words of an anchor: a passage holds least - k + 1 runs of k words, of which one is an anchor."""
        return max(1, (self.least + 1) // 2 + 1)


@dataclass
class Shard:
    """Texts that are handled together: their ids, word hashes, and where each one's words begin; number: what the shard is called."""

    number: int
    ids: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    marks: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), np.diff(self.first))


def _shards(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[Shard]:
    """Shards of the batches' (doc_id, text, places) or (doc_id, text); texts without an id or shorter than a passage are left out."""
    from pyspark import TaskContext

    at, held, size, number = TaskContext.get().partitionId(), [], 0, 0

    def made() -> Shard:
        ids, hashes, many, marks = zip(*held)
        starts = np.cumsum([0, *map(len, hashes)])[:-1]
        return Shard(
            at << 24 | number, np.concatenate(ids), np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(many))]), np.concatenate([m + b for m, b in zip(marks, starts)])
        )

    for batch in batches:
        for part in slices(batch):
            w = words(part.column(1))
            fits = ~np.asarray(part.column(0).is_null()) & (np.diff(w.first) >= s.least)
            keep, sizes = fits[w.doc], np.diff(w.first)
            own = np.concatenate([[0], np.cumsum(np.where(fits, sizes, 0))])
            marks = np.zeros(0, np.int64)
            if part.num_columns > 2:
                lists = part.column(2)
                of = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                place = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                # A repeated id may have come with another text, whose places say nothing here.
                inside = fits[of] & (place < sizes[of])
                marks = place[inside] + own[of[inside]]
            held.append((np.asarray(part.column(0).cast(pa.int64()).take(pa.array(np.flatnonzero(fits)))), w.hash[keep], sizes[fits], marks))
            size += int(keep.sum())
            if size >= s.shard:
                yield made()
                held, size, number = [], 0, number + 1
    if size:
        yield made()


def _blob(x: np.ndarray, kind: type) -> pa.Array:
    return pa.array([np.ascontiguousarray(x, dtype=kind).tobytes()], pa.binary())


def _heads(doc: np.ndarray, start: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each class number (0, 1, ...): the index of its member of the least (doc, start), and whether it has members at other places."""
    order = np.lexsort((start, doc, number))
    begin = np.flatnonzero(np.concatenate([[True], number[order][1:] != number[order][:-1]]))
    last = np.append(begin[1:], len(order)) - 1
    head, other = order[begin], order[last]
    return head, (doc[head] != doc[other]) | (start[head] != start[other])


def _anchor_lists(docs: DataFrame, s: Settings) -> DataFrame:
    """Each shard's list of anchors, and the places (own_docs, own_starts) of all those that it holds more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _shards(batches, s):
            place, key = anchors(x.hashes, x.first, s.k, s.least - s.k + 1)
            doc = np.searchsorted(x.first, place, side="right") - 1
            start, of = place - x.first[doc], x.ids[doc]
            names, number, count = np.unique(key, return_inverse=True, return_counts=True)
            if not len(names):
                continue
            head, _ = _heads(of, start, number.reshape(-1))
            known = count[number.reshape(-1)] > 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x.number]), _blob(names, np.uint64), _blob(of[head], np.int64), _blob(start[head], np.int32), _blob(count > 1, np.bool_),
                    _blob(of[known], np.int64), _blob(start[known], np.int32),
                ],
                names=["shard", "keys", "docs", "starts", "many", "own_docs", "own_starts"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, LIST + ", own_docs binary, own_starts binary")


def merge(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted list of (key, value) from several, two at a time: each key's place is its own plus what binary search finds in the other."""
    runs = [r for r in runs if len(r[0])]
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    while len(runs) > 1:
        runs.sort(key=lambda r: -len(r[0]))
        (a, x), (b, y) = runs.pop(), runs.pop()
        key, value = np.empty(len(a) + len(b), a.dtype), np.empty(len(a) + len(b), x.dtype)
        for own, extra, other, side in ((a, x, b, "left"), (b, y, a, "right")):
            to = np.arange(len(own)) + np.searchsorted(other, own, side=side)
            key[to], value[to] = own, extra
        runs.append((key, value))
    return runs[0]


def _shared(lists: DataFrame, parts: int) -> DataFrame:
    """(shard, at, docs, starts, own_docs, own_starts): for each shard the entries, by their number in its list, that are repeated and that other shards hold too.

    docs, starts: the least place over all shards; own_docs, own_starts: the shard's own. Lists are cut into parts by ranges of keys;
    each part's cuts are merged in one task, in which a shard has one entry of a key at most. lists: LIST, each list's keys ascending.
    """
    kinds = {"keys": np.uint64, "docs": np.int64, "starts": np.int32, "many": np.bool_}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
        for batch in batches:
            for row in range(batch.num_rows):
                number = batch.column(0)[row].as_py()
                x = {c: np.frombuffer(batch.column(i + 1)[row].as_buffer(), kinds[c]) for i, c in enumerate(kinds)}
                ends = np.concatenate([[0], np.searchsorted(x["keys"], bounds), [len(x["keys"])]])
                some = np.flatnonzero(np.diff(ends))
                blobs = [[a[ends[p] : ends[p + 1]].tobytes() for p in some] for a in x.values()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), number)), *(pa.array(b, pa.binary()) for b in blobs), pa.array(ends[some].astype(np.int64))],
                    names=["part", "shard", *kinds, "skip"],
                )

    def judge(rows: list[tuple]) -> pa.RecordBatch | None:
        shard = np.repeat([r[0] for r in rows], [len(r[1]) // 8 for r in rows])
        key, doc, start, many = (np.concatenate([np.frombuffer(r[i + 1], kind) for r in rows]) for i, kind in enumerate(kinds.values()))
        at = np.concatenate([np.arange(len(r[1]) // 8) + r[5] for r in rows])
        ends = np.cumsum([0, *(len(r[1]) // 8 for r in rows)])
        merged, own = merge([(key[a:b], np.arange(a, b)) for a, b in zip(ends[:-1], ends[1:])])
        begin = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        size = np.diff(np.append(begin, len(merged)))
        # What repeats within one shard is for its suffix array to say: only keys of several shards count here.
        several = np.minimum.reduceat(shard[own], begin) != np.maximum.reduceat(shard[own], begin)
        own, number = own[np.repeat(several, size)], np.repeat(np.arange(int(several.sum())), size[several])
        if not len(own):
            return None
        head, apart = _heads(doc[own], start[own], number)
        hit = (apart | np.logical_or.reduceat(many[own], np.flatnonzero(np.diff(number, prepend=-1))))[number]
        own, least = own[hit], own[head[number[hit]]]
        order = np.argsort(shard[own], kind="stable")
        own, least = own[order], least[order]
        cuts = np.flatnonzero(np.diff(shard[own], prepend=-1))
        cells = [[c.tobytes() for c in np.split(a, cuts[1:])] for a in (at[own].astype(np.int32), doc[least], start[least], doc[own], start[own])]
        return pa.RecordBatch.from_arrays([pa.array(shard[own][cuts]), *(pa.array(c, pa.binary()) for c in cells)], names=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != part and rows:
                    if (found := judge(rows)) is not None:
                        yield found
                    rows = []
                part = row[0]
                rows.append(row[1:])
        if rows and (found := judge(rows)) is not None:
            yield found

    out = ["shard", "at", "docs", "starts", "own_docs", "own_starts"]
    pieces = lists.select(*(x.split()[0] for x in LIST.split(", "))).mapInArrow(cut, "part int, " + LIST + ", skip long")
    placed = pieces.repartition(parts, "part").sortWithinPartitions("part")
    return placed.mapInArrow(run, "shard long, at binary, docs binary, starts binary, own_docs binary, own_starts binary")


def _places(lists: DataFrame) -> DataFrame:
    """(doc_id, place) of all of own_docs and own_starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, p in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(d, np.int64)), pa.array(np.frombuffer(p, np.int32))], names=["doc_id", "place"])

    return lists.select("own_docs", "own_starts").mapInArrow(run, "doc_id long, place int")


def _suffix_lists(docs: DataFrame, marks: DataFrame, s: Settings) -> DataFrame:
    """Each shard's list of the classes of its suffix array, and their members: class, text (its number in ids) and start of each."""
    lists = marks.groupBy("doc_id").agg(F.collect_set("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _shards(batches, s):
            member, number = classes(x.hashes, x.first, s.least)
            # Passages that this shard has once can only be repeated where an anchor of theirs is.
            marked = np.zeros(len(x.hashes) + 1, dtype=np.int32)
            doc = x.doc
            np.add.at(marked, np.maximum(x.marks - (s.least - s.k), x.first[doc[x.marks]]), 1)
            np.add.at(marked, x.marks + 1, -1)
            at, key = grams(x.hashes, x.first, s.least)
            here = np.cumsum(marked)[at] > 0
            here[np.searchsorted(at, member)] = False
            name = np.empty(len(x.hashes), dtype=np.uint64)
            name[at] = key
            number = np.concatenate([number, np.arange(here.sum()) + (number[-1] + 1 if len(number) else 0)])
            member = np.concatenate([member, at[here]])
            if not len(member):
                continue
            of, start = doc[member], member - x.first[doc[member]]
            head, many = _heads(x.ids[of], start, number)
            order = np.argsort(name[member[head]], kind="stable")
            back = np.empty(len(order), dtype=np.int64)
            back[order] = np.arange(len(order))
            head, many = head[order], many[order]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x.number]), _blob(name[member[head]], np.uint64), _blob(x.ids[of[head]], np.int64), _blob(start[head], np.int32), _blob(many, np.bool_),
                    _blob(x.ids, np.int64), _blob(back[number], np.int32), _blob(of, np.int32), _blob(start, np.int32),
                ],
                names=["shard", "keys", "docs", "starts", "many", "ids", "class", "member_doc", "member_start"],
            )

    return docs.select("doc_id", "text").join(lists, "doc_id").mapInArrow(run, LIST + ", ids binary, class binary, member_doc binary, member_start binary")


def repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, first_word, n_words, duplicate, source_doc_id): the passages of least words or more that occur at two places or more.

    Of a passage's occurrences the one in the least doc_id, and in that at the least word, is the original; the others are duplicates.
    Overlapping windows of a document are joined to spans, originals and duplicates each for themselves; source_doc_id is the
    least document that holds the original of a window of the span. Words are compared without case and punctuation.
    Null and empty texts, and texts of fewer than least words, hold no passage, and an empty table has none; rows with a null id are
    left out. A doc_id stands for one text: repeated rows count once. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    spark, s = docs.sparkSession, settings
    found, found_path = store(_anchor_lists(docs, s), "anchors")
    marks = _places(found).union(_places(_shared(found, max(1, found.count()))))
    shards, shards_path = store(_suffix_lists(docs, marks, s), "suffixes")
    discard(spark, found_path)

    def spans(own: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({c: [] for c in _COLUMNS})
        r = own.iloc[0]
        doc, start, many = np.frombuffer(r["docs"], np.int64).copy(), np.frombuffer(r["starts"], np.int32).copy(), np.frombuffer(r["many"], np.bool_).copy()
        for at, d, p in zip(shared["at"], shared["docs"], shared["starts"]):
            at = np.frombuffer(at, np.int32)
            doc[at], start[at], many[at] = np.frombuffer(d, np.int64), np.frombuffer(p, np.int32), True
        number, of, begin = (np.frombuffer(r[c], np.int32) for c in ("class", "member_doc", "member_start"))
        hit = many[number]
        number, of, begin = number[hit], np.frombuffer(r["ids"], np.int64)[of[hit]], begin[hit]
        order = np.lexsort((begin, of))
        number, of, begin = number[order], of[order], begin[order]
        return _spans(of, begin.astype(np.int64), (of != doc[number]) | (begin != start[number]), doc[number], s.least)

    judged = shards.groupBy("shard").cogroup(_shared(shards, max(1, shards.count())).groupBy("shard")).applyInPandas(spans, SCHEMA)
    out, _ = store(judged.distinct(), "passages")  # rows of one id that went to different shards give equal spans
    discard(spark, shards_path)
    return out


_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def _spans(doc: np.ndarray, start: np.ndarray, copy: np.ndarray, source: np.ndarray, least: int) -> pd.DataFrame:
    """The spans of windows of least words that are sorted by document and start."""
    out = [pd.DataFrame({c: [] for c in _COLUMNS})]
    for kind in (False, True):
        d, a, o = doc[copy == kind], start[copy == kind], source[copy == kind]
        if not len(d):
            continue
        begin = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] > a[:-1] + least)]))
        end = np.append(begin[1:], len(d)) - 1
        out.append(pd.DataFrame({"doc_id": d[begin], "first_word": a[begin], "n_words": a[end] + least - a[begin], "duplicate": kind, "source_doc_id": np.minimum.reduceat(o, begin)}))
    return pd.concat(out[1:] or out)


def clean(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs without the duplicate passages: their words, with what stands between, are cut out of the texts.

    n_chars, if there is such a column, is set anew for the texts that were cut. A text of which no word remains goes. All other rows
    and columns stay as they are, whatever they are called, null ids and texts without words included. An empty table stays one.
    """
    cuts, _ = store(repeats(docs, settings).where("duplicate").groupBy("doc_id").agg(F.collect_list(F.struct("first_word", "n_words")).alias("_cuts")), "cuts")
    names = docs.columns
    plain, _ = hidden(docs)
    joined = plain.join(cuts.withColumnRenamed("doc_id", "_cut_id"), F.col("doc_id") == F.col("_cut_id"), "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, c) for t, c in zip(text, spans)])

    touched = joined.where("_cuts is not null").withColumn("_new", cut("text", "_cuts")).where("_new is not null")
    values = {c: F.col(f"_kept_{i}") for i, c in enumerate(names)}
    changed = values | {"text": F.col("_new")} | ({"n_chars": F.length("_new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    rest = joined.where("_cuts is null").select(*(v.alias(c) for c, v in values.items()))
    return rest.unionByName(touched.select(*(v.alias(c) for c, v in changed.items())))


def _cut(text: str, spans: list) -> str | None:
    """The text without the spans' words; None if no word remains."""
    w = words(pa.array([text], pa.string()))
    gone = np.zeros(len(w.hash), dtype=bool)
    for s in spans:
        gone[s["first_word"] : s["first_word"] + s["n_words"]] = True
    if gone.all():
        return None
    keep = np.ones(len(w.raw), dtype=bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        keep[w.start[a] : w.start[b] if b < len(gone) else len(w.raw)] = False
    return w.raw[keep].tobytes().decode()
