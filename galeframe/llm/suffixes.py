"""Suffix arrays over word numbers, in numpy: Larsson-Sadakane refinement and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np


def sequence(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of several texts, each text followed by a number of its own, and each word's place in it.

    As no two texts end in the same number, no common prefix goes beyond the end of a text.
    """
    texts = len(first) - 1
    owner = np.repeat(np.arange(texts), np.diff(first))
    place = np.arange(len(hashes)) + owner
    out = np.empty(len(hashes) + texts, dtype=np.int64)
    out[first[1:] + np.arange(texts)] = np.arange(texts)
    out[place] = np.unique(hashes, return_inverse=True)[1].reshape(-1) + texts
    return out, place


def suffix_array(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and the group each place was in when suffixes were sorted by their first 32 numbers (-1: it was alone).

    Suffixes are sorted by two numbers at first. In each round the groups of suffixes that are still equal are sorted
    by the ranks of what follows, which doubles the numbers compared; suffixes that stand alone are left as they are.
    """
    n = len(numbers)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = numbers << np.int64(32)
    key[:-1] |= numbers[1:] + 1
    array = np.argsort(key, kind="stable")
    ordered = key[array]
    begin = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    group = np.maximum.accumulate(np.where(begin, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[array] = group
    single = begin & np.append(begin[1:], True)
    slot = np.flatnonzero(~single)
    alike = np.full(n, -1, dtype=np.int64)
    h = 2
    while len(slot):
        if h == 32:
            alike[array[slot]] = rank[array[slot]]
        place = array[slot]
        order = np.argsort(rank[place] * np.int64(n) + rank[np.minimum(place + h, n - 1)], kind="stable")
        old, place = rank[place[order]], place[order]
        follow = rank[np.minimum(place + h, n - 1)]
        array[slot] = place
        begin = np.concatenate([[True], (old[1:] != old[:-1]) | (follow[1:] != follow[:-1])])
        rank[place] = np.maximum.accumulate(np.where(begin, slot, 0))
        slot = slot[~(begin & np.append(begin[1:], True))]
        h *= 2
    return array, alike


def common_prefixes(numbers: np.ndarray, array: np.ndarray, places: np.ndarray, most: int, lane: int = 256) -> np.ndarray:
    """For each of the ascending places, the length of its suffix's longest common prefix with the suffix before it in the array, up to most.

    Kasai: going through the text, that length falls by one at most from one place to the next. Runs of adjacent
    places go forward side by side, cut after lane places.
    """
    out = np.zeros(len(places), dtype=np.int64)
    if not len(places):
        return out
    inverse = np.empty(len(array), dtype=np.int64)
    inverse[array] = np.arange(len(array))
    at = inverse[places]
    other = np.where(at > 0, array[at - 1], -1)
    fresh = np.concatenate([[True], places[1:] != places[:-1] + 1])
    start = np.flatnonzero(fresh)
    within = np.arange(len(places)) - np.repeat(start, np.diff(np.append(start, len(places))))
    start = np.flatnonzero(within % lane == 0)
    size = np.diff(np.append(start, len(places)))
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    length = np.zeros(len(start), dtype=np.int64)
    n = len(numbers)
    for t in range(int(size[0])):
        live = int(np.searchsorted(-size, -t))  # lanes of more than t places
        i = start[:live] + t
        p, q = places[i], other[i]
        length[:live] = np.maximum(length[:live] - 1, 0)
        length[:live][q < 0] = 0
        going = np.flatnonzero((q >= 0) & (length[:live] < most))
        while len(going):
            a, b = p[going] + length[going], q[going] + length[going]
            same = (np.maximum(a, b) < n) & (numbers[np.minimum(a, n - 1)] == numbers[np.minimum(b, n - 1)])
            going = going[same]
            length[going] += 1
            going = going[length[going] < most]
        out[i] = length[:live]
    return out


def classes(hashes: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that begin a run of least words which begins elsewhere in these texts too, and the number of the class of equal runs that each belongs to.

    Suffixes that agree in their first least words stand side by side in the array, so a class is a stretch of it over which
    no common prefix of neighbours is shorter. Words come in the array's order, so a class's members are adjacent.
    """
    numbers, place = sequence(hashes, first)
    array, alike = suffix_array(numbers)
    some = np.arange(len(numbers)) if least <= 32 else np.flatnonzero(alike >= 0)
    common = common_prefixes(numbers, array, some, least)
    inverse = np.empty(len(array), dtype=np.int64)
    inverse[array] = np.arange(len(array))
    like_last = np.zeros(len(array) + 1, dtype=bool)  # by rank: whether a suffix agrees with the one before it
    like_last[inverse[some[common >= least]]] = True
    rank = np.flatnonzero(like_last[:-1] | like_last[1:])
    word_at = np.full(len(numbers), -1, dtype=np.int64)
    word_at[place] = np.arange(len(place))
    number = np.cumsum(~like_last[rank]) - 1
    return word_at[array[rank]], number


def anchors(hashes: np.ndarray, first: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of those runs of k words that have the least hash of some w adjacent runs (of equal ones the last).

    Any k + w - 1 words hold an anchor, and equal words hold equal anchors.
    """
    from galeframe.llm.textarray import grams

    at, h = grams(hashes, first, k)
    if not len(at):
        return at, h
    n = len(hashes)
    top = np.iinfo(np.uint64).max
    full = np.full(n + w, top, dtype=np.uint64)
    full[at] = h
    least, span = full.copy(), 1
    while span < w:  # the least of the next span values, by doubling
        step = min(span, w - span)
        least[:-step] = np.minimum(least[:-step], least[step:])
        span += step
    starts = grams(hashes, first, k + w - 1)[0]
    value = least[starts]
    chosen = np.zeros(n, dtype=bool)
    left = np.arange(len(starts))
    for back in range(w - 1, -1, -1):
        hit = full[starts[left] + back] == value[left]
        chosen[starts[left][hit] + back] = True
        left = left[~hit]
        if not len(left):
            break
    place = np.flatnonzero(chosen)
    return place, full[place]
