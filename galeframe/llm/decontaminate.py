"""Benchmark decontamination over a distributed positional inverted index.

The index has a row for each segment of the training texts: its terms (word hashes) in order, and
for each term the ascending list of the places at which it occurs. A test item is looked up from its
rarest terms: the list of each is shifted by the term's offset in the item, so that equal values are places
where the item could begin, and these are intersected with the shifted lists of the other terms.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import prepare, quoted, store
from galeframe.llm.textarray import CHUNK, slices, words

INDEX = "doc_ids array<long>, first binary, terms binary, counts binary, places binary"
SCHEMA = "doc_id long, item_id long, kind string, first_word long, n_words long, matched long, share double"


@dataclass(frozen=True)
class Settings:
    """A phrase match is a run of phrase consecutive words of an item (of all its words, if it has fewer).

    A proximity match has share of an item's words, each within slop words of where it would stand, in items of
    least words or more. block: words of test items that are broadcast at a time.
    """

    phrase: int = 13
    share: float = 0.8
    slop: int = 3
    least: int = 8
    block: int = 2_000_000


def build(docs: DataFrame) -> DataFrame:
    """The index of all texts, a row for each segment of up to four million bytes or a single text.

    doc_ids: the segment's documents; first: where each one's words begin in the segment (int64, and the end of the last);
    terms: word hashes, ascending (uint64); counts: of each term (int32); places: ascending for each term (int32).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=4 * CHUNK - 16):  # just under a power of two, to which words() rounds its tables up
                w = words(part.column(1))
                order = np.argsort(w.hash, kind="stable")
                h = w.hash[order]
                begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                counts = np.diff(np.append(begin, len(h))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                        *(pa.array([x.tobytes()], pa.binary()) for x in (w.first.astype(np.int64), h[begin], counts, order.astype(np.int32))),
                    ],
                    names=["doc_ids", "first", "terms", "counts", "places"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, INDEX)


class Segment:
    """One row of the index."""

    def __init__(self, doc_ids: list, first: bytes, terms: bytes, counts: bytes, places: bytes):
        self.doc_ids = doc_ids
        self.first = np.frombuffer(first, np.int64)
        self.terms = np.frombuffer(terms, np.uint64)
        self.ends = np.concatenate([[0], np.cumsum(np.frombuffer(counts, np.int32), dtype=np.int64)])
        self.places = np.frombuffer(places, np.int32)

    def has(self, terms: np.ndarray) -> np.ndarray:
        """Whether each term occurs."""
        if not len(self.terms):
            return np.zeros(len(terms), dtype=bool)
        return self.terms[np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)] == terms

    def list_of(self, term: int) -> np.ndarray:
        """Where the term occurs, ascending."""
        i = int(np.searchsorted(self.terms, np.uint64(term)))
        if i == len(self.terms) or self.terms[i] != term:
            return np.zeros(0, np.int32)
        return self.places[self.ends[i] : self.ends[i + 1]]


def _has(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether the ascending places have one in each low..high."""
    return np.searchsorted(places, low) < np.searchsorted(places, high, side="right")


def search(segment: Segment, item: np.ndarray, counts: np.ndarray, s: Settings) -> list[tuple]:
    """(document's number, kind, first word, words, matched words) of every match of one item in a segment.

    counts: of each of the item's words in all training texts. Where a word occurs more than once in the
    item, each occurrence counts for itself.
    """
    m = len(item)
    if not m:
        return []
    lists = {t: segment.list_of(t) for t in dict.fromkeys(item.tolist())}
    at = [lists[t] for t in item.tolist()]
    rarest = np.argsort(counts, kind="stable")
    return _phrases(segment, at, counts, min(s.phrase, m)) + (_near(segment, at, rarest, s) if m >= s.least else [])


def _phrases(segment: Segment, at: list[np.ndarray], counts: np.ndarray, n: int) -> list[tuple]:
    m = len(at)
    lead = {i + int(np.argmin(counts[i : i + n])) for i in range(m - n + 1)}  # the rarest word of each run of n
    starts = []
    for o in sorted(lead):
        p = at[o].astype(np.int64)
        if not len(p):
            continue
        if n > 1:
            beside = np.zeros(len(p), dtype=bool)
            for step in (-1, 1):
                if 0 <= o + step < m:
                    beside |= _has(at[o + step], p + step, p + step)
            p = p[beside]
        starts.append(p - o)
    diagonals = np.unique(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
    if not len(diagonals):
        return []
    hit = np.zeros((len(diagonals), m + 2), dtype=np.int8)
    for o in range(m):
        hit[:, o + 1] = _has(at[o], diagonals + o, diagonals + o)
    change = np.diff(hit, axis=1)
    row, begin = np.nonzero(change == 1)
    end = np.nonzero(change == -1)[1]
    out = []
    for r, b, e in zip(row.tolist(), begin.tolist(), end.tolist()):
        place = int(diagonals[r]) + b
        while e - b >= n:  # a run over a text's end is cut there
            doc = int(np.searchsorted(segment.first, place, side="right")) - 1
            stop = int(segment.first[doc + 1])
            length = min(e - b, stop - place)
            if length >= n:
                out.append((doc, "phrase", place - int(segment.first[doc]), length, length))
            b, place = b + length, place + length
    return out


def _near(segment: Segment, at: list[np.ndarray], rarest: np.ndarray, s: Settings) -> list[tuple]:
    m = len(at)
    need = int(np.ceil(s.share * m - 1e-9))
    spare = m - need
    # A match lacks at most spare words, so it has one of the spare + 1 rarest, up to slop from where it would stand.
    anchors = np.unique(np.concatenate([at[o].astype(np.int64) - o for o in rarest[: spare + 1]]))
    anchors = _enough(at, anchors, 2 * s.slop, rarest, spare)  # what is near a start is at most twice as far from its anchor
    starts = np.unique(anchors[:, None] + np.arange(-s.slop, s.slop + 1))
    starts = _enough(at, starts, s.slop, rarest, spare)
    if not len(starts):
        return []
    # Words beyond a text's bounds belong to other texts, so a start is tried in each text that it reaches.
    last = int(segment.first[-1]) - 1
    a = np.searchsorted(segment.first, np.clip(starts - s.slop, 0, last), side="right") - 1
    b = np.searchsorted(segment.first, np.clip(starts + m - 1 + s.slop, 0, last), side="right") - 1
    many = b - a + 1
    d = np.repeat(starts, many)
    doc = np.repeat(a, many) + np.arange(len(d)) - np.repeat(np.cumsum(many) - many, many)
    low, high = segment.first[doc], segment.first[doc + 1] - 1
    matched, exact = np.zeros(len(d), dtype=np.int64), np.zeros(len(d), dtype=np.int64)
    for o in range(m):
        matched += _has(at[o], np.maximum(d + o - s.slop, low), np.minimum(d + o + s.slop, high))
        exact += _has(at[o], np.maximum(d + o, low), np.minimum(d + o, high))
    ok = matched >= need
    d, doc, matched, exact = d[ok], doc[ok], matched[ok], exact[ok]
    out = []
    taken: dict[int, list[int]] = {}
    for i in np.lexsort((d, -exact, -matched, doc)).tolist():
        # The best start stands for those whose words overlap in the slop.
        start, own = int(d[i]), taken.setdefault(int(doc[i]), [])
        k = bisect_left(own, start - 2 * s.slop)
        if k < len(own) and own[k] <= start + 2 * s.slop:
            continue
        insort(own, start)
        low, high = int(segment.first[doc[i]]), int(segment.first[doc[i] + 1])
        begin = min(max(start, low), high - 1)
        out.append((int(doc[i]), "proximity", begin - low, max(1, min(start + m, high) - begin), int(matched[i])))
    return out


def _enough(at: list[np.ndarray], starts: np.ndarray, slop: int, rarest: np.ndarray, spare: int) -> np.ndarray:
    """The starts that lack at most spare words within slop of where they would stand."""
    lacking = np.zeros(len(starts), dtype=np.int64)
    for o in rarest.tolist():
        lacking += ~_has(at[o], starts + o - slop, starts + o + slop)
        stay = lacking <= spare
        starts, lacking = starts[stay], lacking[stay]
        if not len(starts):
            break
    return starts


def _items(benchmark: DataFrame, block: int) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """The distinct test items in lists of about block words."""
    some, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        h = words(pa.array([r["text"]], pa.string())).hash
        if len(h):
            some.append((r["item_id"], h))
            size += len(h)
        if size >= block:
            yield some
            some, size = [], 0
    if some:
        yield some


def match(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, kind, first_word, n_words, matched, share) of every match of every item in every text.

    kind is phrase (the longest run of words, n_words from first_word on) or proximity (the best of the places within slop of each other).
    A word is compared without case and punctuation. Null and empty texts and items match nothing;
    repeated documents match each for itself, repeated items once. Null ids stay, an empty table of either kind gives no rows. Other columns are ignored.
    The index is a table in the shared folder; texts are read once. Test items go to the tasks
    in blocks of bounded size.
    """
    prepare(docs.sparkSession)
    spark, s = docs.sparkSession, settings
    index, _ = store(build(docs), "postings")
    out = spark.createDataFrame([], SCHEMA)
    for items in _items(benchmark, s.block):
        terms = np.unique(np.concatenate([h for _, h in items]))
        wanted = spark.sparkContext.broadcast(terms)

        def count(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            want = wanted.value
            total = np.zeros(len(want), dtype=np.int64)
            for batch in batches:
                for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    t, c = np.frombuffer(t, np.uint64), np.frombuffer(c, np.int32)
                    if len(t):
                        i = np.minimum(np.searchsorted(t, want), len(t) - 1)
                        total += np.where(t[i] == want, c[i], 0)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

        sums = index.select("terms", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        frequency = np.zeros(len(terms), dtype=np.int64)
        for r in sums.collect():
            frequency[r["term"]] = r["n"]
        at = [np.searchsorted(terms, h) for _, h in items]
        shared = spark.sparkContext.broadcast(([(i, h, frequency[a]) for (i, h), a in zip(items, at)], terms, np.concatenate(at)))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, terms, at = shared.value
            sizes = np.array([len(h) for _, h, _ in known])
            least = np.minimum(np.minimum(s.phrase, sizes), np.where(sizes >= s.least, np.ceil(s.share * sizes - 1e-9), sizes))
            begin = np.cumsum(sizes) - sizes
            for batch in batches:
                for row in range(batch.num_rows):
                    segment = Segment(*(c[row].as_py() for c in batch.columns))
                    # An item of which the segment lacks too many words isn't searched for.
                    here = np.add.reduceat(segment.has(terms)[at].astype(np.int64), begin) >= least
                    rows = [
                        (segment.doc_ids[doc], item, kind, first, n, matched, matched / len(h))
                        for item, h, counts in (known[i] for i in np.flatnonzero(here))
                        for doc, kind, first, n, matched in search(segment, h, counts, s)
                    ]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES)], names=_NAMES)

        out = out.unionByName(index.mapInArrow(find, SCHEMA))
    return out


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in SCHEMA.split(", ")]


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs in which no item is found. Rows with a null doc_id are judged by no match and stay."""
    hits, _ = store(match(docs, benchmark, settings).select("doc_id").where("doc_id is not null").distinct(), "contaminated")
    return docs.join(hits, "doc_id", "left_anti").select(*map(quoted, docs.columns))
