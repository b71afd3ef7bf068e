"""Recompression of word sequences: a run-length grammar, and longest common extensions by walking it.

Rounds of block compression (a symbol repeated k times becomes one symbol) and pair compression (a symbol of
the left half of the alphabet followed by one of the right half becomes one symbol) shorten the sequence
until no symbol repeats. Whether two neighbours are joined depends on these two alone, so equal stretches are
compressed alike but for their ends, and a longest common extension climbs from the words to the first level
with a difference and goes down again: a few steps per level, for many places at once.

All arrays of a grammar together hold about ten numbers per word.
"""

from dataclasses import dataclass

import numpy as np


@dataclass
class Level:
    """A level's symbols, and how they are joined in the next level: `parent` is the place there of each symbol, `first`
    whether it begins that place; `block_end` the end of each symbol's block, for rounds of blocks only."""

    symbols: np.ndarray
    parent: np.ndarray = None
    first: np.ndarray = None
    block_end: np.ndarray = None
    #: Where each symbol begins in the level below.
    below: np.ndarray = None

    def mirrored(self, n_below, next_size):
        """The level of the sequence read backwards; its parts begin where they ended."""
        below = None
        if self.below is not None:
            below = (n_below - np.append(self.below[1:], n_below))[::-1]
        if self.parent is None:
            return Level(self.symbols[::-1], below=below)
        size = len(self.symbols)
        last = np.append(self.first[1:], True)[::-1]
        block_end = None
        if self.block_end is not None:
            starts = np.flatnonzero(self.first)
            block_end = (size - starts[self.parent])[::-1]
        return Level(self.symbols[::-1], (next_size - 1 - self.parent)[::-1], last, block_end, below)


def _renamed(keys, fresh):
    """Numbers from `fresh` on for equal keys, and how many there are."""
    distinct, names = np.unique(keys, return_inverse=True)
    return fresh + names, len(distinct)


class Grammar:
    """The levels over `words`, whole numbers from 0. The first and the last have to occur once, as they end all extensions."""

    def __init__(self, words: np.ndarray, seed: int = 1):
        draw = np.random.default_rng(seed)
        symbols = words.astype(np.int64)
        fresh = int(symbols.max()) + 1
        self.levels = [Level(symbols)]
        while True:
            level = self.levels[-1]
            symbols = level.symbols
            counts = np.bincount(symbols - symbols.min()) if fresh < 4 * len(symbols) else np.unique(symbols, return_counts=True)[1]
            if counts.max() == 1:
                break
            fresh = self._blocks(level, fresh)
            fresh = self._pairs(self.levels[-1], fresh, draw)

    def _add(self, level, first, block_end, symbols):
        level.first, level.block_end = first, block_end
        level.parent = np.cumsum(first) - 1
        self.levels.append(Level(symbols, below=np.flatnonzero(first)))

    def _blocks(self, level, fresh):
        symbols = level.symbols
        first = np.append(True, symbols[1:] != symbols[:-1])
        if first.all():
            return fresh
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(symbols))
        lengths, above = ends - starts, symbols[starts]
        long = lengths > 1
        above[long], n = _renamed(above[long] * (len(symbols) + 1) + lengths[long], fresh)
        self._add(level, first, ends[np.cumsum(first) - 1], above)
        return fresh + n

    def _pairs(self, level, fresh, draw):
        symbols = level.symbols
        # A random half of the alphabet: a quarter of all neighbours are joined on average. Symbols are hashed
        # by an odd factor of the round, of which one high bit is taken.
        factor = int(draw.integers(1 << 62)) | 1
        left = (symbols * factor) & (1 << 40) != 0
        joined = left[:-1] & ~left[1:]
        if not joined.any():
            return fresh
        first = np.append(True, ~joined)
        starts = np.flatnonzero(first)
        pair = np.append(joined, False)[starts]
        above = symbols[starts]
        begins = starts[pair]
        above[pair], n = _renamed(symbols[begins] * fresh + symbols[begins + 1], fresh)
        self._add(level, first, None, above)
        return fresh + n

    def mirrored(self):
        made = object.__new__(Grammar)
        sizes = [len(level.symbols) for level in self.levels]
        made.levels = [
            level.mirrored(sizes[h - 1] if h else None, sizes[h + 1] if h + 1 < len(sizes) else None)
            for h, level in enumerate(self.levels)
        ]
        return made

    def extensions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words are equal from the places a and b on, for each pair of different places."""
        start, a, b = a, a.copy(), b.copy()
        stopped = np.zeros(len(a), np.int64)
        going = np.arange(len(a))
        for h, level in enumerate(self.levels):
            symbols = level.symbols
            going = going[symbols[a[going]] == symbols[b[going]]]
            if level.parent is None or not len(going):
                break
            stopped[going] = h
            x, y = a[going], b[going]
            inside = np.flatnonzero(~(level.first[x] & level.first[y]))
            i, j = x[inside], y[inside]
            if level.block_end is not None:
                left_a, left_b = level.block_end[i] - i, level.block_end[j] - j
                step = np.minimum(left_a, left_b)
                i, j, differ = i + step, j + step, left_a != left_b
            else:
                i, j = i + 1, j + 1
                differ = symbols[i] != symbols[j]
                # Both second parts of pairs are equal too; what follows a pair begins a part.
                more = ~differ & ~level.first[i]
                i, j = i + more, j + more
            x[inside], y[inside] = i, j
            a[going], b[going] = x, y
            ended = np.zeros(len(going), bool)
            ended[inside] = differ
            going, x, y = going[~ended], x[~ended], y[~ended]
            a[going], b[going] = level.parent[x], level.parent[y]
            stopped[going] = h + 1
        for h in range(len(self.levels) - 1, 0, -1):
            going = np.flatnonzero(stopped >= h)
            if not len(going):
                continue
            upper, level = self.levels[h], self.levels[h - 1]
            x, y = upper.below[a[going]], upper.below[b[going]]
            same = level.symbols[x] == level.symbols[y]
            if level.block_end is not None:
                step = np.where(same, np.minimum(level.block_end[x] - x, level.block_end[y] - y), 0)
            else:
                step = same
            a[going], b[going] = x + step, y + step
        return a - start
