"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

Suffixes are classed as smaller or larger than their right neighbour; the leftmost-smaller substrings
are sorted by one round of induction, named, and sorted as suffixes by recursion where names repeat; a second
induction orders all suffixes. Induction walks the buckets of the alphabet in order and moves each
bucket's suffixes at once, so its work is linear and its loops run over symbols, not positions.
"""

from __future__ import annotations

import numpy as np

from .shared import ranges


BASE = 1 << 18  # names up to which the recursion ends in rank doubling


def _doubled(names: np.ndarray) -> np.ndarray:
    """The recursion's base: suffixes of names by doubling the length that ranks tell apart."""
    rank, width, n = names.astype(np.int64), 1, len(names)
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(key[order[1:]] != key[order[:-1]])))
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        width *= 2


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the end counts as smaller than all."""
    n = len(s)
    differs = np.empty(n, bool)
    np.not_equal(s[:-1], s[1:], out=differs[:-1])
    differs[-1] = True
    rise = np.zeros(n, bool)
    np.less(s[:-1], s[1:], out=rise[:-1])
    at = np.flatnonzero(differs)
    return np.repeat(rise[at], np.diff(at, prepend=-1))


def _induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes in order, given the leftmost-smaller ones in order."""
    n = len(s)
    out = np.empty(n, np.int32)
    counts = np.bincount(s, minlength=sigma)
    heads = np.cumsum(counts) - counts
    tails = heads + counts
    larger = np.bincount(s[~smaller], minlength=sigma)
    lms_counts = np.bincount(s[lms], minlength=sigma)
    lms_ends = np.cumsum(lms_counts)
    next_ = heads.copy()
    # Each suffix's left neighbour, if that is to be induced in the pass; else -1.
    left = np.arange(-1, n - 1, dtype=np.int32)
    left_larger = np.where(np.concatenate(([True], smaller[:-1])), np.int32(-1), left)
    left_smaller = np.where(np.concatenate(([False], smaller[:-1])), left, np.int32(-1))

    def place(rows: np.ndarray, step: int) -> None:
        symbols = s[rows]
        order = np.argsort(symbols, kind="stable")  # radix sort: symbols have 16 bits
        symbols = symbols[order]
        first = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
        held = symbols[first]
        size = np.diff(np.append(first, len(symbols)))
        out[np.repeat(next_[held] - step * first, size) + step * np.arange(len(symbols))] = rows[order]
        next_[held] += step * size

    place(np.array([n - 1], np.int32), 1)
    for c in np.flatnonzero(counts).tolist():
        done = heads[c]
        while done < next_[c]:
            before = left_larger[out[done : next_[c]]]
            done = next_[c]
            before = before[before >= 0]
            if len(before):
                place(before, 1)
        if lms_counts[c]:
            place(lms[lms_ends[c] - lms_counts[c] : lms_ends[c]] - np.int32(1), 1)
    next_ = tails - 1
    for c in np.flatnonzero(counts)[::-1].tolist():
        done = tails[c] - 1
        while done > next_[c]:
            before = left_smaller[out[next_[c] + 1 : done + 1][::-1]]
            done = next_[c]
            before = before[before >= 0]
            if len(before):
                place(before, -1)
        if larger[c]:
            before = left_smaller[out[heads[c] : heads[c] + larger[c]][::-1]]
            before = before[before >= 0]
            if len(before):
                place(before, -1)
    return out


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """The starts of all suffixes of ``s`` (symbols below ``sigma``, at most 2^16) in order."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = s.astype(np.uint16)
    smaller = _types(s)
    is_lms = smaller.copy()
    is_lms[0] = False
    is_lms[1:] &= ~smaller[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    if len(lms) > 1:
        by_symbol = lms[np.argsort(s[lms], kind="stable")]
        rough = _induce(s, smaller, by_symbol, sigma)
        rough = rough[is_lms[rough]]
        # A leftmost-smaller substring reaches to the next one's first symbol. Equal ones are neighbours by
        # now; those of equal length are compared symbol by symbol.
        ends = np.append(lms[1:] + 1, n)
        length = ends - lms
        length[-1] = 0  # the last one ends in the end itself: like no other
        index = np.searchsorted(lms, rough)
        size = length[index]
        new = np.ones(len(rough), np.int64)
        alike = np.flatnonzero((size[1:] == size[:-1]) & (size[1:] > 0)) + 1
        if len(alike):
            n_symbols = size[alike].astype(np.int64)
            differs = s[ranges(rough[alike].astype(np.int64), n_symbols)] != s[ranges(rough[alike - 1].astype(np.int64), n_symbols)]
            new[alike] = np.logical_or.reduceat(differs, np.cumsum(n_symbols) - n_symbols)
        names = np.empty(len(lms), np.int64)
        names[index] = np.cumsum(new) - 1
        distinct = int(names.max()) + 1
        if distinct == len(lms):
            lms = rough
        elif len(names) <= BASE:
            lms = lms[_doubled(names)]
        elif distinct <= 1024:
            lms = lms[suffix_array(names, distinct)]
        else:  # two digits a name keep the alphabet small
            radix = int(np.ceil(distinct**0.5))
            digits = np.empty(2 * len(names), np.int64)
            digits[::2], digits[1::2] = names // radix, names % radix
            order = suffix_array(digits, radix)
            lms = lms[order[order % 2 == 0] // 2]
    return _induce(s, smaller, lms, sigma)


def permuted_common_prefixes(s: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position, its suffix's predecessor in order (-1: none) and the length of their common
    prefix, by text position.

    Only irreducible values (where the symbols to the left differ) and those of every ``most // 2``-th place are compared, up
    to ``most`` symbols; every other value is its left neighbour's less one. So what is less than ``most // 2`` is exact,
    and what isn't comes out as that much at least."""
    n = len(s)
    previous = np.full(n, -1)
    previous[order[1:]] = order[:-1]
    irreducible = np.ones(n, bool)
    inner = np.flatnonzero((previous[1:] > 0) & (previous[:-1] >= 0)) + 1
    irreducible[inner] = s[inner - 1] != s[previous[inner] - 1]
    irreducible[:: most // 2] = True
    length = np.zeros(n, np.int64)
    at = np.flatnonzero(irreducible & (previous >= 0))
    for k in range(most):
        at = at[np.maximum(at, previous[at]) + k < n]
        at = at[s[at + k] == s[previous[at] + k]]
        if not len(at):
            break
        length[at] += 1
    last = np.maximum.accumulate(np.where(irreducible, np.arange(n), 0))
    return previous, np.maximum(0, length[last] - (np.arange(n) - last))
