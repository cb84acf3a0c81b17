"""Byte-pair encoding and decoding by forced-boundary splitting.

Two bytes that stand side by side in no token of the vocabulary can never be merged over, so the
place between them is a certain cut. Pieces of the pre-tokenization are cut there, each fragment is
encoded by itself, and the ids are concatenated: the result is that of encoding the piece whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from galeframe.llm.common import prepare, quoted
from galeframe.llm.textarray import _TABLE, bytes_of, mix, powers, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of a fragment beyond which it is merged by itself.
LONG = 256
_LETTER, _DIGIT, _OTHER, _SPACE = range(4)
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)),
    T.StructField("round_trip", T.BooleanType()),
])


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes and their ids, read on the driver and sent along with the tasks (under 1 MB)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def character_classes() -> np.ndarray:
    """Letter, digit, other or white space for each code point, by Unicode's properties."""
    import regex

    points = np.array([p for p in range(0x110000) if not 0xD800 <= p < 0xE000])
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    kind = np.full(0x110000, _OTHER, dtype=np.uint8)
    for pattern, value in ((r"\p{L}+", _LETTER), (r"\p{N}+", _DIGIT), (r"\s+", _SPACE)):
        for found in regex.finditer(pattern, text):
            kind[points[found.start() : found.end()]] = value
    return kind


class Codec:
    """Encodes and decodes with one vocabulary of byte strings whose ids are their merge ranks."""

    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray):
        self.ranks, self.classes = ranks, classes
        most = max(ranks.values()) + 1
        tokens = [b""] * most
        for token, i in ranks.items():
            tokens[i] = token
        self.none = np.int64(most)
        self.token_len = np.array([len(x) for x in tokens], dtype=np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_raw = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.joined = np.zeros((256, 256), dtype=bool)
        inner = np.ones(len(self.token_raw), dtype=bool)
        inner[self.token_at[self.token_len > 0]] = False
        at = np.flatnonzero(inner)
        self.joined[self.token_raw[at - 1], self.token_raw[at]] = True
        pairs = {}
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id of each two tokens' concatenation, none where that is no token."""
        key = a << np.int64(32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], self.none)

    def pieces(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte offsets at which the pre-tokenization's pieces begin.

        The pattern: 's 't 're 've 'm 'll 'd, or runs of letters, of digits, or of other characters, each with
        a space before it, or white space, of which the last goes by itself if other text follows.
        """
        point = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        n = len(point)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        kind = self.classes[point]
        edge = np.zeros(n + 1, dtype=bool)
        edge[np.searchsorted(lead, offsets)] = True
        run = np.ones(n + 1, dtype=bool)
        run[1:n] = (kind[1:] != kind[:-1]) | edge[1:n]
        begins = run[:n].copy()
        last = np.flatnonzero(run[1:] & (kind == _SPACE) & ~edge[1:])  # the last white space before other text
        begins[last] = True
        begins[last[point[last] == 32] + 1] = False
        at = np.flatnonzero((point == 39) & begins)
        at = at[at + 1 < n]
        at = at[(kind[at + 1] == _LETTER) & ~edge[at + 1]]
        if len(at):
            one = point[at + 1]
            two = point[np.minimum(at + 2, n - 1)]
            more = (at + 2 < n) & ~edge[np.minimum(at + 2, n)]
            long = more & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
            short = (one == 115) | (one == 116) | (one == 109) | (one == 100)
            for which, size in ((short, 2), (long, 3)):
                begins[at[which] + 1] = False
                to = at[which] + size
                begins[to[to < n]] |= (kind[to[to < n]] == _LETTER)
        return lead[begins]

    def fragments(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where fragments begin: at pieces, and between all two bytes that no token has side by side."""
        cut = np.ones(len(raw), dtype=bool)
        cut[1:] = ~self.joined[raw[:-1], raw[1:]]
        cut[self.pieces(raw, offsets)] = True
        return np.flatnonzero(cut)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the n + 1 offsets of each text's."""
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        start = self.fragments(raw, offsets)
        end = np.append(start[1:], len(raw))
        up, down = powers(len(raw) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(raw) + 1, dtype=np.uint64)
            np.cumsum(_TABLE[raw] * up[: len(raw)], out=total[1:])
            h = mix((total[end] - total[start]) * down[start])
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        flat, lens = self.merge(raw, start[first], end[first])
        sizes = lens[which]
        ids = flat[_ranges((np.cumsum(lens) - lens)[which], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, ends[np.searchsorted(start, offsets)]

    def merge(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each fragment, one after the other, and their numbers.

        All fragments at once: in each round every fragment joins the leftmost of its adjacent pairs of
        least rank, until it has none. Fragments of over LONG bytes, for which rounds would be
        many, go one by one over a heap.
        """
        count = np.zeros(len(start), dtype=np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        size = end - start
        for i in np.flatnonzero(size > LONG):
            ids = np.array(self._merge_long(raw[start[i] : end[i]].tobytes()), dtype=np.int64)
            count[i] = len(ids)
            done.append((np.full(len(ids), i), ids))
        who = np.flatnonzero(size <= LONG)
        lens = size[who]
        some = raw[_ranges(start[who], lens)]
        sym = self.byte_id[some]
        rank = np.full(len(sym), self.none)
        if len(sym):
            rank[:-1] = self._byte_pairs()[some[:-1], some[1:]]
            rank[np.cumsum(lens) - 1] = self.none
        while len(who):
            at = np.cumsum(lens) - lens
            least = np.minimum.reduceat(rank, at)
            over = least == self.none
            if over.any():
                gone = np.repeat(over, lens)
                done.append((np.repeat(who[over], lens[over]), sym[gone]))
                count[who[over]] = lens[over]
                who, lens, least = who[~over], lens[~over], least[~over]
                sym, rank = sym[~gone], rank[~gone]
                if not len(who):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, lens))
            of = np.repeat(np.arange(len(who)), lens)[hit]
            hit = hit[np.concatenate([[True], of[1:] != of[:-1]])]
            sym[hit] = least
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            last = np.cumsum(lens) - 1
            sym, rank = sym[keep], rank[keep]
            spot = hit - np.arange(len(hit))
            lens = lens - 1
            tail = last - np.arange(1, len(who) + 1)
            rank[spot] = self.none
            right = spot < tail
            rank[spot[right]] = self.pair(sym[spot[right]], sym[spot[right] + 1])
            left = spot > tail - lens + 1
            rank[spot[left] - 1] = self.pair(sym[spot[left] - 1], sym[spot[left]])
        flat = np.zeros(count.sum(), dtype=np.int64)
        begin = np.cumsum(count) - count
        for owners, ids in done:
            if len(ids):
                fresh = np.concatenate([[True], owners[1:] != owners[:-1]])
                run = np.flatnonzero(fresh)
                within = np.arange(len(ids)) - np.repeat(run, np.diff(np.append(run, len(ids))))
                flat[begin[owners] + within] = ids
        return flat, count

    def _byte_pairs(self) -> np.ndarray:
        if not hasattr(self, "_pairs"):
            a, b = np.meshgrid(self.byte_id, self.byte_id, indexing="ij")
            self._pairs = self.pair(a.ravel(), b.ravel()).reshape(256, 256)
        return self._pairs

    def _merge_long(self, fragment: bytes) -> list[int]:
        """merge() with a heap and linked parts, for fragments where scanning would be quadratic."""
        import heapq

        ranks, n = self.ranks, len(fragment)
        end = list(range(1, n + 1))
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        alive = [True] * n

        def rank(i: int) -> int | None:
            return None if after[i] < 0 else ranks.get(fragment[i : end[after[i]]])

        heap = [(r, i, end[after[i]]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            if not alive[i] or after[i] < 0 or end[after[i]] != to or rank(i) is None:
                continue
            j = after[i]
            end[i], alive[j], after[i] = end[j], False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, end[after[k]]))
        return [ranks[fragment[i : end[i]]] for i in range(n) if alive[i]]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for."""
        return self.token_raw[_ranges(self.token_at[ids], self.token_len[ids])]


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lens[0] numbers, then the same for the next."""
    total = np.cumsum(lens)
    if not len(total) or not total[-1]:
        return np.zeros(0, dtype=np.int64)
    return np.repeat(starts - (total - lens), lens) + np.arange(total[-1])


_codecs: dict[str, Codec] = {}


def _codec(key: str, shared) -> Codec:
    """A worker's codec, kept from task to task."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(*shared.value)
    return _codecs[key]


def encode(docs: DataFrame, *, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, token_ids, round_trip) of each row of docs, whole texts.

    round_trip says whether decoding the ids gave the text's very bytes again. Null text: all but
    doc_id are null. Empty text: no ids, round_trip true. Null doc_id and repeated rows stay as they
    are; other columns are ignored, but for those named in keep, which come along unchanged. A map
    over the rows: no shuffle; an empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((load_ranks(vocabulary), character_classes()))
    schema = T.StructType([*SCHEMA.fields, *(docs.schema[c] for c in keep)])
    target = pa.list_(pa.field("element", pa.int32(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, shared)
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                column = part.column(1)
                absent = np.asarray(column.is_null())
                raw, offsets = bytes_of(column)
                ids, ends = codec.encode(raw, offsets)
                again = codec.decode(ids)
                back = np.concatenate([[0], np.cumsum(codec.token_len[ids])])[ends]
                same = np.array_equal(back, offsets) and np.array_equal(again, raw)
                fine = np.full(part.num_rows, same)
                if not same:
                    fine = np.array([np.array_equal(raw[a:b], again[c:d]) for a, b, c, d in zip(offsets, offsets[1:], back, back[1:])])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)), type=target)
                if absent.any():
                    lists = pa.array([None if x else y for x, y in zip(absent, lists.to_pylist())], target)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()),
                        pa.array(np.diff(offsets), mask=absent),
                        pa.array(np.diff(ends), mask=absent),
                        lists,
                        pa.array(fine, mask=absent),
                        *part.columns[2:],
                    ],
                    names=schema.names,
                )

    return docs.select("doc_id", "text", *map(quoted, keep)).mapInArrow(run, schema)


def decode(encoded: DataFrame, *, vocabulary: str = VOCABULARY, id_column: str = "doc_id", ids_column: str = "token_ids") -> DataFrame:
    """(doc_id, text) from token ids; null ids give null text, no ids an empty text.

    Bytes that are no UTF-8 (ids that came from elsewhere) become the replacement character; an id
    outside the vocabulary is an error.
    """
    prepare(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast((load_ranks(vocabulary), character_classes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, shared)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array(x, dtype=np.int64)).tobytes().decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(id_column, ids_column).mapInArrow(run, "doc_id long, text string")
