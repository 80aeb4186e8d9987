"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Induced sorting scans the array under construction and puts the suffix before each
scanned one into the next free slot of its first symbol. Here a scan takes as many
slots at once as are sure to be complete: those before the first slot that any of
them fills.
"""

from __future__ import annotations

import numpy as np


def _smaller_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last one is not."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = (text[1:] > text[:-1]).astype(np.int8) - (text[1:] < text[:-1])
    # Equal neighbours are like the next pair that differs.
    differs = np.where(step != 0, np.arange(n), n - 1)
    following = np.minimum.accumulate(differs[::-1])[::-1]
    return step[following] > 0


def _induce(text: np.ndarray, precedes: np.ndarray, slots: np.ndarray, free: np.ndarray, down: bool) -> None:
    """Fill suffixes of one type into ``slots`` (-1 where empty) from those before them in a scan.

    Upwards the greater ones go to the first free slot of their symbol, downwards the
    smaller ones to the last free one; ``free`` has that slot by symbol. ``precedes`` says, last
    for an empty slot, whether the suffix before one is of the type.
    """
    n, width, sign = len(slots), 1024, -1 if down else 1
    at = n - 1 if down else 0
    while 0 <= at < n:
        view = slots[max(0, at - width + 1) : at + 1][::-1] if down else slots[at : at + width]
        where = precedes[view].nonzero()[0]
        end = len(view)
        if len(where):
            suffix = view[where] - 1
            symbol = text[suffix]
            # A slot may be read once nothing that is scanned before it can still fill it.
            bound = np.minimum.accumulate((free[symbol] - at) * sign)
            late = bound[:-1] <= where[1:]
            take = int(late.argmax()) + 1 if len(late) and late[-1] else len(where)
            end = min(int(bound[take - 1]), end)
            if take < len(where):
                suffix, symbol = suffix[:take], symbol[:take]
            order = symbol.argsort(kind="stable")
            ordered = symbol[order]
            new = np.ones(take, bool)
            np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
            heads = new.nonzero()[0]
            if len(heads) == take:
                slots[free[ordered]] = suffix[order]
                free[ordered] += sign
            else:
                sizes = np.append(heads[1:], take) - heads
                rank = np.arange(take) - heads.repeat(sizes)
                slots[free[ordered] + sign * rank] = suffix[order]
                free[ordered[heads]] += sign * sizes
        width = min(max(256, 2 * end), 1 << 20)
        at += end * sign


def _from_leftmost(text: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All suffixes, induced from the leftmost smaller ones in the given order."""
    n = len(text)
    ends = np.cumsum(size)
    slots = np.full(n, -1, np.int32)
    seeds = leftmost[text[leftmost].argsort(kind="stable")]
    symbols = text[seeds]
    # Seeds stand at the ends of their symbols' ranges.
    count = np.bincount(symbols, minlength=len(size))
    place = ends[symbols] - np.cumsum(count)[symbols] + np.arange(len(seeds))
    slots[place] = seeds
    free = ends - size
    # The last suffix is greater than nothing after it: it comes first of its symbol.
    last = n - 1
    slots[free[text[last]]] = last
    free[text[last]] += 1
    precedes = np.zeros(n + 1, bool)
    precedes[1:n] = ~smaller[:-1]
    _induce(text, precedes, slots, free, down=False)
    slots[place] = -1
    precedes[1:n] = smaller[:-1]
    _induce(text, precedes, slots, ends - 1, down=True)
    return slots


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of non-negative symbols in ascending order; a suffix comes before what it begins."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    size = np.bincount(text)
    # Symbols of 16 bits are sorted by radix.
    text = text.astype(np.uint16 if len(size) <= 1 << 16 else np.int32)
    smaller = _smaller_types(text)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    m = len(leftmost)
    if m < 2:
        return _from_leftmost(text, smaller, leftmost, size)
    # Sort the substrings between leftmost smaller suffixes and name them by rank.
    slots = _from_leftmost(text, smaller, leftmost, size)
    place = np.full(n, -1, np.int64)
    place[leftmost] = np.arange(m)
    by_rank = place[slots]
    by_rank = by_rank[by_rank >= 0]
    width = np.diff(leftmost, append=n - 1) + 1
    rank_width = width[by_rank]
    new = np.ones(m, bool)
    alike = np.flatnonzero(rank_width[1:] == rank_width[:-1]) + 1
    spans = rank_width[alike]
    inner = np.arange(int(spans.sum())) - np.repeat(np.cumsum(spans) - spans, spans)
    a, b = (np.repeat(leftmost[by_rank[alike - k]], spans) + inner for k in (0, 1))
    differ = np.add.reduceat(text[a] != text[b], np.cumsum(spans) - spans) if len(alike) else spans
    new[alike] = differ > 0
    new[by_rank == m - 1] = True  # the last one ends with the text: equal to no other
    follower = np.flatnonzero(by_rank == m - 1) + 1
    new[follower[follower < m]] = True
    names = np.empty(m, np.int64)
    names[by_rank] = np.cumsum(new) - 1
    if names.max() + 1 == m:
        order = by_rank
    else:
        order = suffix_array(names)
    return _from_leftmost(text, smaller, leftmost[order], size)


def permuted_common_prefixes(text: np.ndarray, suffixes: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, common): for each position, the suffix before its own in order, -1 for the first, and their common prefix.

    ``until`` is the position's bound: prefixes end before it. Only where the symbols
    before the two suffixes differ is a prefix counted; else it is the one of the
    position before, less 1.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    at = np.arange(n)
    carried = (before > 0) & (at > 0)
    carried[carried] = (text[at[carried] - 1] == text[before[carried] - 1]) & (before[at[carried] - 1] == before[carried] - 1)
    carried[carried] &= until[at[carried] - 1] == until[at[carried]]
    carried[carried] &= until[before[at[carried]] - 1] == until[before[carried]]
    own = np.flatnonzero(~carried)
    room = np.where(before[own] >= 0, np.minimum(until[own] - own, until[before[own]] - before[own]), 0)
    count = np.zeros(len(own), np.int64)
    raw = np.concatenate([text.astype(np.uint8), np.zeros(8, np.uint8)])
    words = np.ndarray(n + 1, "<u8", raw.tobytes(), strides=(1,))
    active = np.flatnonzero(room > 0)
    while len(active):
        u = own[active] + count[active]
        v = before[own[active]] + count[active]
        apart = words[u] ^ words[v]
        # Bytes that agree: trailing zero bits of the difference, by eights.
        low = apart & (~apart + np.uint64(1))
        agree = np.where(apart == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        count[active] = np.minimum(count[active] + agree, room[active])
        active = active[(agree == 8) & (count[active] < room[active])]
    common = np.zeros(n, np.int64)
    common[own] = count
    source = np.maximum.accumulate(np.where(carried, -1, at))
    return before, common[source] - (at - source)
