"""Locally consistent grammar compression (recompression) of token sequences.

A round first names maximal runs of one symbol, then names pairs whose left
symbol falls in the left half and whose right symbol falls in the right half of
the alphabet. A name is a 64-bit hash of what it stands for, so every task of
the cluster gives one content one name without exchanging a dictionary, and
equal token sequences get equal symbols wherever the symbol's *support* - the
tokens that its formation looked at - lies inside them.
"""

from __future__ import annotations

import numpy as np

from .textops import U64, mix

#: Support that no window can contain; symbols beside a document's end get it.
FAR = 1 << 40


def parse(tokens: np.ndarray, doc: np.ndarray, rounds: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols of each level as (name, first supporting token, one past the last).

    ``tokens`` are hashes of the words of consecutive documents and ``doc`` the
    (non-decreasing) document of each. Level 0 holds the tokens themselves.
    """
    n = len(tokens)
    levels = [(tokens, np.arange(n), np.arange(n) + 1)]
    if n == 0:
        return levels
    # a barrier before, between and after documents keeps symbols from crossing
    cut = np.flatnonzero(np.diff(doc)) + 1
    at = np.concatenate(([0], cut, [n]))
    name = np.insert(tokens, at, U64(0))
    lo = np.insert(np.arange(n), at, -FAR)
    hi = np.insert(np.arange(n) + 1, at, FAR)
    wall = np.insert(np.zeros(n, bool), at, True)
    for level in range(1, rounds + 1):
        # maximal runs; that a run ends is seen from its neighbours
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | wall[1:] | wall[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(name)))
        last = first + size - 1
        lo, hi = (np.minimum(lo[np.maximum(first - 1, 0)], lo[first]), np.maximum(hi[np.minimum(last + 1, len(hi) - 1)], hi[last]))
        name, wall = name[first], wall[first]
        long = size > 1
        name = np.where(long, mix(name + size.astype(U64) * U64(0xA24BAED4963EE407)), name)
        # pairs of a left and a right symbol
        side = (mix(name ^ U64(level * 0x632BE59BD9B4E019 & (1 << 64) - 1)) >> U64(63)).astype(bool)
        left, right = ~side & ~wall, side & ~wall
        joined = np.zeros(len(name), bool)
        joined[:-1] = left[:-1] & right[1:]
        second = np.zeros(len(name), bool)
        second[1:] = joined[:-1]
        # a lone symbol has seen the neighbour that did not fit
        nxt = np.minimum(np.arange(len(name)) + 1, len(name) - 1)
        prv = np.maximum(np.arange(len(name)) - 1, 0)
        new_hi = np.where(joined | (left & ~joined), np.maximum(hi, hi[nxt]), hi)
        new_lo = np.where(right & ~second, np.minimum(lo, lo[prv]), lo)
        new_lo = np.where(joined, np.minimum(lo, lo[nxt]), new_lo)
        new_name = np.where(joined, mix(name * U64(0x9FB21C651E98DF25) + mix(name[nxt] + U64(level))), name)
        keep = ~second
        name, lo, hi, wall = new_name[keep], new_lo[keep], new_hi[keep], wall[keep]
        lo, hi = np.where(wall, -FAR, lo), np.where(wall, FAR, hi)
        real = ~wall & (lo >= 0) & (hi <= n)
        levels.append((name[real], lo[real], hi[real]))
    return levels


#: (level, consecutive symbols, longest support) of the anchors tried, best first.
#: Five neighbouring first-level symbols stand for about seven words; what short or
#: unusual windows lack is taken from higher levels, and at last from single tokens.
ANCHORS = ((1, 5, 11), (2, 2, 13), (1, 2, 13), (0, 1, 13))


def phrases(symbols: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names and supports of ``k`` consecutive symbols."""
    name, lo, hi = symbols
    n = max(0, len(name) - k + 1)
    x = name[:n]
    for j in range(1, k):
        x = mix(x * U64(0x9FB21C651E98DF25) + name[j : j + n])
    return x, lo[:n], hi[len(hi) - n :]


def window_anchors(tokens: np.ndarray, doc: np.ndarray, width: int, plan: tuple = ANCHORS) -> np.ndarray:
    """For each token, the anchor of the window of ``width`` tokens that starts there.

    The anchor is, of the first kind in ``plan`` of which the window holds one
    with all its support, the one with the smallest name. Equal windows have
    equal anchors, and neighbouring windows mostly share one. Entries of
    windows that run past their document are meaningless.
    """
    n = len(tokens)
    best = np.full(n, U64(0xFFFFFFFFFFFFFFFF))
    if n == 0:
        return best
    levels = parse(tokens, doc, max(level for level, _, _ in plan))
    todo = np.arange(n)
    for kind, (level, k, longest) in enumerate(plan):
        name, lo, hi = phrases(levels[level], k)
        fits = hi - lo <= min(longest, width)
        name, lo, hi = name[fits], lo[fits], hi[fits]
        # supports are in order, so those inside a window are neighbours
        first = np.searchsorted(lo, todo, side="left")
        after = np.searchsorted(hi, todo + width, side="right")
        here = after > first
        first, after, at = first[here], after[here], todo[here]
        least = name[first] if len(name) else np.zeros(0, U64)
        for j in range(1, int((after - first).max(initial=1))):
            more = np.flatnonzero(after - first > j)
            least[more] = np.minimum(least[more], name[first[more] + j])
        best[at] = (least >> U64(4)) | U64(kind << 60)
        todo = todo[~here]
        if not len(todo):
            break
    return best

