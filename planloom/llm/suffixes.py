"""Byte windows of texts in numpy: rolling hashes, anchors, suffix arrays and common prefixes."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the two lanes of rolling hashes.
_LANES = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _mixed(left: np.ndarray, right: np.ndarray, lane: int) -> np.ndarray:
    a, b = (np.uint64(x) for x in _LANES[lane])
    both = left * a
    both ^= right
    both ^= both >> np.uint64(29)
    both *= b
    both ^= both >> np.uint64(32)
    return both


def window_hashes(data: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """64-bit hashes of all windows of ``size`` bytes, by doubling; equal windows have equal hashes."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, width, found, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if size & width:
            part = level[done:done + n]
            found = part if found is None else _mixed(found, part, lane)
            done += width
        if done == size:
            return found if size > 1 else _mixed(found, found, lane)
        level = _mixed(level[:-width], level[width:], lane)
        width *= 2


def anchors(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last): which gram stands for which windows.

    A window is represented by the gram in it with the smallest hash (the leftmost of equal ones), so equal windows
    have equal representatives at equal distances. Windows that start from first to last have that at place.
    """
    hashes = window_hashes(data, gram)
    n, span = len(data) - window + 1, window - gram + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    bits = np.uint64(len(hashes).bit_length())
    low = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[span - width:span - width + n])
    place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:], [n])) - 1
    return hashes[place[first]], place[first], first, last


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes or more, by Larsson-Sadakane refinement.

    Suffixes are ranked by seven bytes, then by twice as many in each round: suffixes of one rank are sorted by the
    rank of what follows. Ranks that only one suffix has are final and are left alone.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    # nine bits a byte, so that the end of the text comes before a zero byte
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
    key = np.zeros(n, np.uint64)
    for byte in range(7):
        key = (key << np.uint64(9)) | padded[byte:byte + n]
    order = np.argsort(key)
    # a rank is the place of its last suffix in the order, plus one; 0 is the end of the text
    rank = np.zeros(n + 1, np.int64)
    ends = _group_ends(key[order])
    rank[order] = ends + 1
    reach = 7
    open_ = np.flatnonzero(_shared(ends))
    while reach < depth and len(open_):
        members = order[open_]
        follow = rank[np.minimum(members + reach, n)]
        by = np.lexsort((follow, ends[open_]))
        members, follow, group = members[by], follow[by], ends[open_][by]
        order[open_] = members
        change = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        last = np.flatnonzero(np.concatenate((change, [True])))
        fresh = open_[np.repeat(last, np.diff(np.concatenate(([-1], last))))]
        rank[members] = fresh + 1
        ends[open_] = fresh
        open_ = open_[_shared(fresh)]
        reach *= 2
    return order


def _group_ends(sorted_keys: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(np.concatenate((sorted_keys[1:] != sorted_keys[:-1], [True])))
    return np.repeat(last, np.diff(np.concatenate(([-1], last))))


def _shared(groups: np.ndarray) -> np.ndarray:
    """Which entries have a neighbour of the same group."""
    same = groups[1:] == groups[:-1]
    return np.concatenate((same, [False])) | np.concatenate(([False], same))


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each entry of ``order`` and the one before it, up to ``most``; the first has 0.

    As Kasai does, in text order: where the predecessor moves on by one with the suffix, a common prefix gets one
    shorter. Only the others are compared, all together, eight bytes a step.
    """
    n = len(data)
    if not len(order):
        return np.zeros(0, np.int64)
    before = np.full(n, -2, np.int64)
    before[order[1:]] = order[:-1]
    listed = np.sort(order)
    previous = before[listed]
    follows = (listed[1:] == listed[:-1] + 1) & (previous[1:] == previous[:-1] + 1) & (previous[:-1] >= 0)
    moved = np.concatenate(([False], follows & (data[listed[:-1]] == data[previous[:-1]])))
    own, other = listed[~moved], previous[~moved]
    length = np.zeros(len(own), np.int64)
    live = np.flatnonzero(other >= 0)
    limit = most + n  # lengths fall by one along a run, so its head must be known beyond ``most``
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    while len(live):
        a, b = own[live] + length[live], other[live] + length[live]
        room = np.minimum(n - np.maximum(a, b), 8)
        a, b = np.minimum(a, n), np.minimum(b, n)
        differ = words[a] != words[b]
        same = np.where(differ.any(1), differ.argmax(1), 8)
        step = np.minimum(same, room)
        length[live] += step
        live = live[(step == 8) & (length[live] < limit)]
    run = np.cumsum(~moved) - 1
    head = np.flatnonzero(~moved)
    in_text = np.maximum(length[run] - (np.arange(len(listed)) - head[run]), 0)
    found = np.zeros(n, np.int64)
    found[listed] = np.minimum(in_text, most)
    return found[order]
