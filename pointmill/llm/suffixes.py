"""Suffix arrays in numpy: Larsson-Sadakane refinement, common prefixes, binary search."""

from __future__ import annotations

import numpy as np

from pointmill.llm import common

#: Sequences shorter than this have their places in 32 bits.
NARROW = 1 << 30


def refine(rank: np.ndarray, shift: int) -> np.ndarray:
    """One round of refinement: order within groups of equal rank by the rank `shift` places on.

    A rank is the number of suffixes in earlier groups, so groups that are already single keep theirs
    and only the unsorted groups are touched. Suffixes that end before `shift` come first.
    """
    n, kind = rank.size, rank.dtype
    todo = np.flatnonzero((np.bincount(rank, minlength=n) > 1)[rank]).astype(kind)
    if not todo.size:
        return rank
    key = rank[todo].astype(np.int64)
    key *= n + 1
    inside = int(np.searchsorted(todo, n - shift))
    key[:inside] += rank[todo[:inside] + shift]
    key[:inside] += 1
    order = np.argsort(key)
    key, todo = key[order], todo[order]
    del order
    part = np.flatnonzero(common.firsts(key)).astype(kind)
    key //= n + 1  # the group
    begun = np.where(common.firsts(key)[part], part, 0)
    np.maximum.accumulate(begun, out=begun)
    fresh = key[part] + (part - begun)
    del key, begun
    out = rank.copy()
    out[todo] = np.repeat(fresh.astype(kind), np.diff(part, append=todo.size))
    return out


def dense_start(keys: np.ndarray) -> np.ndarray:
    """Ranks by one key: how many keys are smaller. Numbers of 32 bits where these do."""
    kind = np.int32 if keys.size < NARROW else np.int64
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(common.firsts(keys[order])).astype(kind)
    out = np.empty(keys.size, kind)
    out[order] = np.repeat(first, np.diff(first, append=keys.size))
    return out


def packed_start(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, int]:
    """Ranks by as many first symbols, up to `depth`, as fit one number, and how many these are.

    A suffix that ends earlier comes before its continuations.
    """
    if not symbols.size:
        return np.empty(0, np.int64), depth
    bits = (int(symbols.max()) + 1).bit_length()
    have = max(1, min(depth, 63 // bits))
    key = np.zeros(symbols.size, np.int64)
    for i in range(have):
        key <<= bits
        there = key[: max(0, symbols.size - i)]
        there += symbols[i:]
        there += 1
    return dense_start(key), have


def ranks_to_depth(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes by their first `depth` symbols.

    Each round at most doubles the depth; the last one is shortened so that equal ranks mean exactly that
    the first `depth` symbols are equal.
    """
    rank, have = packed_start(symbols, depth)
    while have < depth:
        step = min(have, depth - have)
        rank = refine(rank, step)
        have += step
    return rank


def suffix_array(rank: np.ndarray) -> np.ndarray:
    """Suffix positions in order of rank."""
    return np.argsort(rank, kind="stable")


def sorted_suffixes(symbols: np.ndarray) -> np.ndarray:
    """The whole suffix array: refinement until no two suffixes share a rank."""
    rank, have = packed_start(symbols, 64)
    while have < symbols.size:
        finer = refine(rank, have)
        if finer is rank:  # nothing was left to sort
            break
        rank, have = finer, 2 * have
    return suffix_array(rank)


def kasai(symbols: np.ndarray, sa: np.ndarray, depth: int, lanes: int = 4096) -> np.ndarray:
    """Kasai's array of byte strings: common prefix, up to `depth`, of each suffix with the one before it in `sa`.

    Kasai's scan goes through the text from left to right and carries the length, less one, from each
    position to the next. The text is cut into runs and all runs are scanned in step, one position a step;
    lengths grow by up to eight bytes at a time. `sa` must be the whole suffix array.
    """
    n = symbols.size
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([symbols, np.zeros(8, np.uint8)])
    eight = np.zeros(n + 1, np.uint64)
    for k in range(8):
        eight[:n] = (eight[:n] << np.uint64(8)) | padded[k : k + n].astype(np.uint64)
    lanes = min(lanes, n)
    run = -(-n // lanes)
    start, h = np.arange(lanes) * run, np.zeros(lanes, np.int64)
    for step in range(run):
        i = start + step
        i = i[i < n]
        j, h = before[i], np.maximum(h[: i.size] - 1, 0)
        h[j < 0] = 0
        most = np.minimum(depth, n - np.maximum(i, j))
        most[j < 0] = 0
        grow = np.flatnonzero(h < most)
        while grow.size:
            differs = eight[i[grow] + h[grow]] ^ eight[j[grow] + h[grow]]
            same = np.full(grow.size, 8)
            for k in range(8):  # whole bytes before the first bit that differs
                same[differs >= np.uint64(1) << np.uint64(8 * k)] = 7 - k
            h[grow] = np.minimum(h[grow] + same, most[grow])
            grow = grow[(same == 8) & (h[grow] < most[grow])]
        out[i] = h
    return out[sa]


def compare(text: np.ndarray, at: np.ndarray, other: np.ndarray, start: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common prefix (at most `width`) of text suffixes and other suffixes, and the order at the first difference."""
    got, sign = np.zeros(at.size, np.int64), np.zeros(at.size, np.int8)
    live = np.flatnonzero(width > 0)
    while live.size:
        i, j = at[live] + got[live], start[live] + got[live]
        x = np.where(i < text.size, text[np.minimum(i, text.size - 1)], -1)
        y = np.where(j < other.size, other[np.minimum(j, other.size - 1)], -1)
        same = (x == y) & (x >= 0)
        off = live[~same]
        sign[off] = np.sign(x[~same] - y[~same])
        live = live[same]
        got[live] += 1
        live = live[got[live] < width[live]]
    return got, sign


def search(text: np.ndarray, sa: np.ndarray, other: np.ndarray, start: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of `other`, the range of `sa` whose suffixes begin with its first `width` symbols, by binary search."""
    bounds = []
    for upper in (False, True):
        lo, hi = np.zeros(start.size, np.int64), np.full(start.size, sa.size, np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not open_.size:
                break
            mid = (lo[open_] + hi[open_]) // 2
            got, sign = compare(text, sa[mid], other, start[open_], width[open_])
            below = (sign < 0) | (upper & (got >= width[open_]))
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
        bounds.append(lo)
    return bounds[0], bounds[1]


def bounds_within(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where `wanted` begins and ends in each ascending stretch values[lo:hi], by binary search of all at once."""
    out = []
    for upper in (False, True):
        a, b = lo.copy(), hi.copy()
        while (open_ := np.flatnonzero(a < b)).size:
            mid = (a[open_] + b[open_]) // 2
            below = values[mid] <= wanted[open_] if upper else values[mid] < wanted[open_]
            a[open_[below]] = mid[below] + 1
            b[open_[~below]] = mid[~below]
        out.append(a)
    return out[0], out[1]
