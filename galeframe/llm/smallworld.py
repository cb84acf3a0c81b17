"""Navigable small-world graphs over 128-bit codes under Hamming distance, in numpy.

Codes are inserted in batches: each new node is linked to the nearest nodes that a beam search over the
graph so far finds, and they are linked back to it; nodes of one batch are linked to their nearest in the batch
as well. Searches go forward for many queries at a time.
"""

from __future__ import annotations

import numpy as np

_MAX = np.iinfo(np.int64).max
FORWARD, BACK, PEERS, ENTRIES = 12, 20, 8, 12
#: Added to the distance of nodes that a search is not for; more than any distance.
SAME = 256


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance along the last axis of (..., 2) codes."""
    x = np.bitwise_count(a ^ b)
    return x[..., 0].astype(np.int64) + x[..., 1]


def exact(codes: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All (query, node) within radius, by comparing every code with every query."""
    rows, cols = [], []
    for i, q in enumerate(queries):
        hit = np.flatnonzero(distance(codes, q) <= radius)
        rows.append(np.full(len(hit), i))
        cols.append(hit)
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Graph:
    """codes: (n, 2) uint64; links: (n, FORWARD + BACK + PEERS) int32, -1 where there is none."""

    def __init__(self, codes: np.ndarray, links: np.ndarray):
        self.codes, self.links = codes, links

    @classmethod
    def build(cls, codes: np.ndarray, beam: int = 48) -> Graph:
        """The graph of all codes, inserted in their order, in batches of up to half the nodes there are."""
        n = len(codes)
        graph = cls(codes, np.full((n, FORWARD + BACK + PEERS), -1, dtype=np.int32))
        done = min(n, 256)
        for i in range(1, done):
            d = distance(codes[:i], codes[i])
            near = np.argsort(d, kind="stable")[:FORWARD]
            graph.links[i, : len(near)] = near
        graph._link_back(np.arange(done))
        while done < n:
            new = np.arange(done, min(n, done + max(64, min(done // 2, 8192))))
            ids, _ = graph.search(codes[new], max(beam, FORWARD), size=done)
            graph.links[new, :FORWARD] = ids[:, :FORWARD]
            graph._link_back(new)
            graph._link_peers(new)
            done = new[-1] + 1
        return graph

    def _link_back(self, new: np.ndarray) -> None:
        to = self.links[new, :FORWARD].astype(np.int64)
        source = np.broadcast_to(new[:, None], to.shape)
        keep = to >= 0
        to, source = to[keep], source[keep].astype(np.int64)
        if not len(to):
            return
        touched = np.unique(to)
        old = self.links[touched, FORWARD : FORWARD + BACK].astype(np.int64)
        have = old >= 0
        at = np.concatenate([np.broadcast_to(touched[:, None], old.shape)[have], to])
        of = np.concatenate([old[have], source])
        order = np.lexsort((of, distance(self.codes[at], self.codes[of]), at))
        at, of = at[order], of[order]
        begin = np.concatenate([[True], at[1:] != at[:-1]])
        start = np.flatnonzero(begin)
        rank = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
        stay = rank < BACK
        self.links[touched, FORWARD : FORWARD + BACK] = -1
        self.links[at[stay], FORWARD + rank[stay]] = of[stay]

    def _link_peers(self, new: np.ndarray, block: int = 256) -> None:
        """Links the nodes of a batch, which did not see each other, to their nearest among them."""
        many = min(PEERS, len(new) - 1)
        if many < 1:
            return
        for i in range(0, len(new), block):
            rows = new[i : i + block]
            key = (distance(self.codes[new][None], self.codes[rows][:, None]) << 16).astype(np.int32) | np.arange(len(new), dtype=np.int32)
            key[np.arange(len(rows)), rows - new[0]] = np.iinfo(np.int32).max
            near = np.partition(key, many - 1, axis=1)[:, :many] & 0xFFFF
            self.links[rows, FORWARD + BACK : FORWARD + BACK + many] = new[near]

    def search(
        self, queries: np.ndarray, beam: int, size: int | None = None, block: int = 1024, own: np.ndarray | None = None, apart: tuple[np.ndarray, np.ndarray] | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """The nearest beam nodes found for each query and their distances, ascending; -1 where fewer were found.

        own: the node that a query is, where its search starts too, or -1. apart: the labels of all nodes and of the queries. Nodes of a
        query's own label count as farther than all others: they are gone through, but come last.
        """
        size = len(self.codes) if size is None else size
        own = np.full(len(queries), -1) if own is None else own
        labels, asked = apart if apart is not None else (None, np.zeros(len(queries)))
        parts = [self._search(queries[i : i + block], beam, size, own[i : i + block], labels, asked[i : i + block]) for i in range(0, len(queries), block)]
        if not parts:
            return np.zeros((0, beam), np.int64), np.zeros((0, beam), np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _far(self, nodes: np.ndarray, queries: np.ndarray, labels: np.ndarray | None, asked: np.ndarray) -> np.ndarray:
        d = distance(self.codes[nodes], queries)
        return d if labels is None else d + SAME * (labels[nodes] == asked)

    def _search(self, queries: np.ndarray, beam: int, size: int, own: np.ndarray, labels: np.ndarray | None, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, width = len(queries), self.links.shape[1]
        step = max(2, beam // 16)
        room = beam + beam // 2
        final = np.full((count, beam), _MAX, dtype=np.int64)
        # A key is distance, node, and 0 if its links were followed already: a sort puts equal nodes side by side.
        entry = np.unique(np.linspace(0, size - 1, min(size, ENTRIES)).astype(np.int64))
        pool = (self._far(entry[None], queries[:, None], labels, asked[:, None]) << 34) | (entry << 1) | 1
        if (own >= 0).any():
            home = (self._far(own, queries, labels, asked) << 34) | (own << 1) | 1
            pool = np.concatenate([pool, np.where(own >= 0, home, _MAX)[:, None]], axis=1)
        rows, q, mine = np.arange(count), queries, asked
        while len(rows):
            pool.sort(axis=1)
            twin = (pool[:, 1:] >> 1) == (pool[:, :-1] >> 1)
            if twin.any():
                pool[:, 1:][twin] = _MAX
                pool.sort(axis=1)
            pool = pool[:, :room]
            top = pool[:, :beam]
            fresh = ((top & 1) == 1) & (top != _MAX)
            going = fresh.any(axis=1)
            if not going.all():
                over = ~going
                final[rows[over], : top.shape[1]] = top[over]
                rows, q, mine, pool, fresh = rows[going], q[going], mine[going], pool[going], fresh[going]
                if not len(rows):
                    break
                top = pool[:, :beam]
            nth = np.cumsum(fresh, axis=1)
            r, c = np.nonzero(fresh & (nth <= step))
            node = (pool[r, c] >> 1) & 0xFFFFFFFF
            pool[r, c] &= ~np.int64(1)
            near = self.links[node].astype(np.int64)
            key = (self._far(near, q[r][:, None], labels, mine[r][:, None]) << 34) | (near << 1) | 1
            key[(near < 0) | (near >= size)] = _MAX
            more = np.full((len(rows), step, width), _MAX, dtype=np.int64)
            more[r, nth[r, c] - 1] = key
            pool = np.concatenate([pool, more.reshape(len(rows), -1)], axis=1)
        none = final == _MAX
        return np.where(none, -1, (final >> 1) & 0xFFFFFFFF), np.where(none, 1 << 20, final >> 34)

    def within(
        self, queries: np.ndarray, radius: int, beam: int, own: np.ndarray | None = None, apart: tuple[np.ndarray, np.ndarray] | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node) pairs within radius, and whether each query may have more.

        own: the node that each query is, or -1; a query and its own node are no pair. apart: as in search(); pairs of equal labels are left out.
        A query gives its nearest pairs, as many as the beam has room for; where nothing but pairs is in its beam it may have more. Where
        a beam would look at as many nodes as there are, each query is compared with all of them.
        """
        if not len(self.codes) or not len(queries):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(queries), dtype=bool)
        own = np.full(len(queries), -1) if own is None else own
        if beam * self.links.shape[1] >= len(self.codes):
            ids, d = self._compared(queries, beam, apart)
        else:
            ids, d = self.search(queries, beam, block=max(16, 65536 // beam), own=own, apart=apart)
        near = (d <= radius) & (ids >= 0)
        r, c = np.nonzero(near)
        full = near.all(axis=1) & (beam < len(self.codes))
        return *_others(r, ids[r, c], own), full

    def _compared(self, queries: np.ndarray, beam: int, apart: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        n, many = len(self.codes), min(beam, len(self.codes))
        ids, d = np.full((len(queries), beam), -1, dtype=np.int64), np.full((len(queries), beam), 1 << 20, dtype=np.int64)
        for i, q in enumerate(queries):
            key = self._far(np.arange(n), q, None if apart is None else apart[0], 0 if apart is None else apart[1][i]) * n + np.arange(n)
            key = np.sort(np.partition(key, many - 1)[:many])
            ids[i, :many], d[i, :many] = key % n, key // n
        return ids, d


def _others(q: np.ndarray, node: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs without those of a query and its own node."""
    other = own[q] != node
    return q[other], node[other]
