"""Similar titles of two lists, without loss: cheap bounds from counts before the common subsequence.

With similarity 2 LCS / (la + lb) >= t, the longest common subsequence has at least t (la + lb) / 2
characters, so many must the two titles have in common by count.  Leaving out a character parts two
pairs of neighbours, putting one in parts one; so at least la - 1 - 2 (la - LCS) - (lb - LCS) pairs of
neighbours are common, too.  Characters and pairs are counted in hashed classes, which only raises what
seems common.  Lengths come first, then characters, then pairs, then the subsequence itself, of all that are left at once.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

CLASSES, PAIRS = 32, 256
#: Titles that are compared with all others at a time.
BLOCK = 256
#: Bytes of the bit masks of one character, and of all characters that are kept.
MASK, MASKS = 1 << 20, 1 << 25


def hashed(numbers: np.ndarray, row: np.ndarray, rows: int, classes: int) -> np.ndarray:
    """Counts by row and class."""
    mixed = (numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return np.bincount(row * classes + (mixed % np.uint64(classes)).astype(np.int64), minlength=rows * classes).reshape(rows, classes).astype(np.int16)


class Titles:
    def __init__(self, titles: Iterable[str | None]):
        self.titles = [t or "" for t in titles]
        self.length = np.array([len(t) for t in self.titles], np.int64)
        low = [t.lower() for t in self.titles]
        self.low = np.array([len(t) for t in low], np.int64)
        codes = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.codes, self.masks = codes, {}
        row = np.repeat(np.arange(len(low)), self.low)
        self.letters = hashed(codes, row, len(low), CLASSES)
        inside = row[1:] == row[:-1]
        self.pairs = hashed((codes[:-1] << 21 | codes[1:])[inside], row[1:][inside], len(low), PAIRS)


    def mask(self, code: int, first: int, last: int, size: int) -> np.ndarray:
        """Where titles ``first`` to ``last`` have a character: a row of ``size`` bytes each, the lowest bit first."""
        ends = np.cumsum(self.low)
        begin, end = ends[first] - self.low[first], ends[last - 1]
        at = np.flatnonzero(self.codes[begin:end] == code) + begin
        row = np.searchsorted(ends, at, side="right")
        bits = np.zeros((last - first, 8 * size), bool)
        bits[row - first, at - ends[row] + self.low[row]] = True
        return np.packbits(bits, axis=1, bitorder="little")


def common_lengths(title: str, b: Titles, chosen: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of a lower-cased title with chosen ones (ascending places).

    The update of udfs.common_length() for all of them at once: their bits stand side by side in one integer, and at
    least one empty bit after each title takes what its addition carries.
    """
    size = int(b.low.max(initial=0)) // 8 + 1
    every = size * len(b.titles) <= MASK  # else the masks of those chosen only, MASK bytes at a time
    if not every:
        size = int(b.low[chosen].max()) // 8 + 1
        step = max(1, MASK // size)
        if len(chosen) > step:
            return np.concatenate([common_lengths(title, b, chosen[k : k + step]) for k in range(0, len(chosen), step)])
    picked = None if every else Titles([b.titles[j] for j in chosen])

    def bits(code: int) -> int:
        if picked is not None:
            rows = picked.mask(code, 0, len(chosen), size)
        else:
            if code not in b.masks:
                if size * len(b.titles) * len(b.masks) >= MASKS:
                    b.masks.clear()
                b.masks[code] = b.mask(code, 0, len(b.titles), size)
            rows = b.masks[code][chosen]
        return int.from_bytes(rows.tobytes(), "little")

    inside = np.arange(8 * size) < b.low[chosen, None]
    full = int.from_bytes(np.packbits(inside, axis=1, bitorder="little").tobytes(), "little")
    where = {ch: bits(ord(ch)) for ch in set(title)}
    v = full
    for ch in title:
        hit = v & where[ch]
        v = (v + hit | v - hit) & full
    left = np.frombuffer(v.to_bytes(size * len(chosen), "little"), np.uint8).reshape(-1, size)
    return b.low[chosen] - np.bitwise_count(left).sum(axis=1, dtype=np.int64)


def candidates(a: Titles, b: Titles, threshold: float, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of titles that the bounds don't part, in order."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    longest = max(int(a.low.max(initial=0)), int(b.low.max(initial=0)))
    whole = np.int16 if longest < 1 << 15 else np.int64
    letters, pairs = np.ascontiguousarray(b.letters.T), b.pairs.astype(np.float32)  # floats are added up fastest, and exactly
    for k in range(0, len(a.titles), BLOCK):
        la, lb = a.length[k : k + BLOCK, None], b.length[None, :]
        common = np.zeros((len(la), len(b.titles)), whole)
        for own, other in zip(a.letters[k : k + BLOCK].T, letters, strict=True):
            common += np.minimum(own[:, None], other)
        least = np.ceil(threshold * (a.low[k : k + BLOCK, None] + b.low) / 2 - 1e-9)
        near = (np.minimum(la, lb) > 0) & (np.minimum(la, lb) >= ratio * np.maximum(la, lb) - 1e-9) & (common >= least)
        for n in range(len(la)):
            j = np.flatnonzero(near[n])
            x, y, need = a.low[k + n], b.low[j], least[n, j]
            need = np.maximum(x - 1 - 2 * (x - need) - (y - need), y - 1 - 2 * (y - need) - (x - need))
            j = j[np.minimum(pairs[j], a.pairs[k + n].astype(np.float32)) @ np.ones(PAIRS, np.float32) >= need]
            found.append((np.full(len(j), k + n), j))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def resembling(a: Titles, b: Titles, threshold: float, ratio: float) -> np.ndarray:
    """Whether each title of ``a`` is similar to any of ``b``; one that ``b`` has as it is needs no comparison."""
    have = set(b.titles) - {""}
    out = np.array([t in have for t in a.titles], bool)
    asked = np.flatnonzero(~out)
    rest = Titles([a.titles[i] for i in asked])
    i, j = candidates(rest, b, threshold, ratio)
    starts = np.flatnonzero(np.diff(i, prepend=-1))
    for n, chosen in zip(i[starts], np.split(j, starts[1:]) if len(i) else [], strict=True):
        la, lb = rest.length[n], b.length[chosen]
        alike = 2.0 * common_lengths(rest.titles[n].lower(), b, chosen) / (rest.low[n] + b.low[chosen])
        out[asked[n]] = np.any((alike >= threshold) & (np.minimum(la, lb) / np.maximum(la, lb) >= ratio))
    return out


def may_be_similar(a: Iterable[str | None], b: Iterable[str | None], threshold: float, ratio: float) -> np.ndarray:
    """Of titles side by side, whether the bounds leave the pair."""
    x, y = Titles(a), Titles(b)
    lengths = (np.minimum(x.length, y.length) > 0) & (np.minimum(x.length, y.length) >= ratio * np.maximum(x.length, y.length) - 1e-9)
    least = np.ceil(threshold * (x.low + y.low) / 2 - 1e-9)
    pairs = np.maximum(x.low - 1 - 2 * (x.low - least) - (y.low - least), y.low - 1 - 2 * (y.low - least) - (x.low - least))
    return lengths & (np.minimum(x.letters, y.letters).sum(axis=1) >= least) & (np.minimum(x.pairs, y.pairs).sum(axis=1) >= pairs)
