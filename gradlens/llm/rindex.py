"""A run-length index over many short strings: a run-compressed Burrows-Wheeler transform with samples at run ends.

Suffixes are sorted by prefix doubling in NumPy, while the index is built; each string ends in a terminator of its own, so
the order is total and LF steps are exact. What is kept is as large as the number of runs: where each run starts, its
symbol, its LF shift, and a sample at its upper end: which text position stands above the run's first row after an LF
step, and how many symbols the two have in common.

That is enough to stream matching statistics. Going left by one symbol in a text, a row that is not the first of its run
takes the row above it along, so the position above goes left too and one more symbol matches; at a run's first row
both are read from its sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Symbols that the first sort key holds.
_FIRST = 7


def _ranks(key: np.ndarray, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order and dense ranks of keys. Positions in `apart` are never equal to another one: of equal keys, the earlier stands first."""
    order = np.argsort(key)
    k = key[order]
    new = np.ones(len(key), bool)
    np.not_equal(k[1:], k[:-1], out=new[1:])
    if apart is not None:
        at = np.flatnonzero(apart[order])  # equal keys are all in `apart`, or none is
        order[at] = order[at][np.lexsort((order[at], k[at]))]
        new[at] = True
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new) - 1
    return order, rank


def _common(a: np.ndarray, b: np.ndarray, levels: list[tuple[int, np.ndarray]], text: np.ndarray, n: int) -> np.ndarray:
    """Symbols that the suffixes at a and b have in common, from ranks of ever shorter prefixes. A terminator equals none."""
    size = np.zeros(len(a), np.int64)
    for h, rank in reversed(levels):
        x, y = np.minimum(a + size, n - 1), np.minimum(b + size, n - 1)
        size += h * ((rank[x] == rank[y]) & (x != y))
    open_ = np.ones(len(a), bool)
    for _ in range(_FIRST):
        x, y = text[np.minimum(a + size, n - 1)], text[np.minimum(b + size, n - 1)]
        open_ &= (x == y) & (x > 0)
        size += open_
    return size


class RunIndex:
    """Run-length index of `strings` (flat bytes and their bounds)."""

    def __init__(self, flat: np.ndarray, bounds: np.ndarray) -> None:
        sizes = np.diff(bounds)
        n = int(sizes.sum()) + len(sizes)
        self.n_strings = len(sizes)
        starts = bounds[:-1] + np.arange(len(sizes))  # where each string begins in the text with terminators
        self.ends = starts + sizes  # its terminator
        text = np.zeros(n + _FIRST, np.int64)
        inside = np.ones(n, bool)
        inside[self.ends] = False
        text[:n][inside] = flat.astype(np.int64) + 1
        left = np.repeat(self.ends, sizes + 1) - np.arange(n)  # symbols before the terminator
        key = np.zeros(n, np.int64)
        for j in range(_FIRST):
            key = key * 257 + np.where(left > j, text[j : j + n], 0)
        h = _FIRST
        order, rank = _ranks(key, left < h)
        levels = [(h, rank.astype(np.int32))]
        longest = int(sizes.max()) + 1 if len(sizes) else 0
        while h < longest:
            padded = np.concatenate([rank, np.zeros(h, np.int64)])
            order, rank = _ranks(rank * (n + 1) + np.where(left >= h, padded[h : h + n] + 1, 0))
            h *= 2
            levels.append((h, rank.astype(np.int32)))
        # The transform: the symbol before each suffix; before a string's first symbol stands its terminator.
        at_start = np.zeros(n, bool)
        at_start[starts] = True
        symbol = np.where(at_start[order], 0, text[order - 1])
        # Runs; a terminator is a run by itself, for each is another symbol.
        head = np.ones(n, bool)
        head[1:] = (symbol[1:] != symbol[:-1]) | (symbol[1:] == 0)
        self.run_start = np.flatnonzero(head)
        self.run_symbol = symbol[self.run_start]
        lengths = np.diff(np.append(self.run_start, n))
        by_symbol = np.lexsort((self.run_start, self.run_symbol))
        target = np.empty(len(lengths), np.int64)
        target[by_symbol] = np.cumsum(lengths[by_symbol]) - lengths[by_symbol]
        # A terminator's row is the number of its string: terminators sort first, in the strings' order.
        ended = self.run_symbol == 0
        target[ended] = np.searchsorted(starts, order[self.run_start[ended]])
        self.shift = target - self.run_start
        #: By run: the position above its first row's LF image, and the symbols that the two share.
        self.above = np.where(target > 0, order[target - 1], -1) if n else target
        own = order[target] if n else target
        self.shared = np.where(target > 0, _common(own, np.maximum(self.above, 0), levels, text, n), 0) if n else target

    def stream(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of all strings at once, read from their ends to their starts.

        Yields (position, position above it in the order of suffixes, symbols in common), a position of each string that
        goes on. Positions count in the text with terminators; -1 where nothing is above.
        """
        rows, at = np.arange(self.n_strings), self.ends.copy()
        above, shared = np.concatenate([[-1], self.ends[:-1]]).astype(np.int64)[: self.n_strings], np.zeros(self.n_strings, np.int64)
        while len(rows):
            run = np.searchsorted(self.run_start, rows, "right") - 1
            head = rows == self.run_start[run]
            above, shared = np.where(head, self.above[run], above - 1), np.where(head, self.shared[run], shared + 1)
            rows, on = rows + self.shift[run], self.run_symbol[run] > 0
            rows, at, above, shared = rows[on], at[on] - 1, above[on], shared[on]
            if len(rows):
                yield at, above, shared


def repeated(index: RunIndex, when: np.ndarray, depth: int) -> np.ndarray:
    """By position of the text with terminators: whether its next `depth` symbols also start at one with a smaller `when`.

    Positions whose next `depth` symbols are equal stand together in the order of suffixes: each but the first is linked
    to the one above. The links of a group are followed to its first position in doubling steps.
    """
    first = np.arange(len(when))
    linked = []
    for at, above, shared in index.stream():
        on = shared >= depth
        first[at[on]] = above[on]
        linked.append(at[on])
    at = np.concatenate(linked) if linked else np.empty(0, np.int64)
    while True:
        further = first[first[at]]
        if (further == first[at]).all():
            break
        first[at] = further
    least = when.copy()
    np.minimum.at(least, first[at], when[at])
    return when > least[first]
