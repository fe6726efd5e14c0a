"""Token counts by rank-synchronous array merging (operator 10).

Counts equal those of the tokenizers library for a byte-level vocabulary file,
without added tokens; a special token's string inside a text counts as that one
token, which is the library's default.  Null and empty texts count 0 tokens.
Rows with equal ids or texts are counted one by one, each with the same result.  Very
long texts are counted whole.  Other columns aren't read, whatever their names.  An
empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from pyspark.sql import DataFrame

from .bpe import BYTE_PATTERN, SPACE, ArrayBPE
from .common import map_column

#: Entries that a worker's table of known pieces may hold before it starts anew.
CACHE_ENTRIES = 300_000
#: Marks a piece that can't be counted apart from its neighbours.
_JOINED = -(1 << 40)
_EDGE = re.compile(rf"^[{SPACE}]|[{SPACE}]\Z")


class TokenCounter:
    """Counts of one vocabulary; pieces seen before are looked up.

    A blank between two characters that aren't white space always begins a
    pre-token, so a text is cut at its blanks and its pieces are counted apart.
    Where a piece is empty or has white space at an edge, the text is cut into
    pre-tokens instead.
    """

    def __init__(self, path: str):
        self.bpe = ArrayBPE(path)
        self.marks = re.compile("|".join(map(re.escape, self.bpe.special))) if self.bpe.special else None
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def learn(self, pieces: set[str]) -> None:
        """Enter pieces that follow a blank.  A full table becomes the older one; what is
        met again is taken over from that, so frequent pieces aren't merged anew."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > CACHE_ENTRIES:
            self.older, self.known = self.known, {}
            new = list(pieces)
        if self.older:
            self.known.update((p, self.older[p]) for p in new if p in self.older)
            new = [p for p in new if p not in self.known]
        words = [p for p in new if p.isalpha()]
        _, sizes = self.bpe.merge([b" " + p.encode() for p in words])
        self.known.update(zip(words, sizes.tolist()))
        rest = [p for p in new if not p.isalpha()]
        apart = [p for p in rest if p and not _EDGE.search(p)]
        self.known.update(dict.fromkeys(rest, _JOINED))
        self.known.update(zip(apart, self.each([BYTE_PATTERN.findall(" " + p) for p in apart])))

    def each(self, lists: list[list[str]]) -> list[int]:
        """Tokens of each list of pre-tokens."""
        index: dict[str, int] = {}
        of = [index.setdefault(t, len(index)) for tokens in lists for t in tokens]
        _, sizes = self.bpe.merge([t.encode() for t in index])
        sums = np.r_[0, np.cumsum(sizes[np.array(of, np.int64)])]
        ends = np.cumsum([len(tokens) for tokens in lists], dtype=np.int64)
        return (sums[ends] - sums[np.r_[0, ends[:-1]]]).tolist() if lists else []

    def count(self, texts: list[str]) -> list[int]:
        out, parts, owner = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            if any(mark in text for mark in self.bpe.special):
                segments = self.marks.split(text)
                out[i] = len(segments) - 1
            else:
                segments = [text]
            for segment in filter(None, segments):
                parts.append(segment)
                owner.append(i)
        cut = [p.split(" ") for p in parts]
        first = [p[0] for p in cut]
        for p in cut:
            del p[0]
        distinct: set[str] = set()
        distinct.update(*cut)
        self.learn(distinct)
        get = self.known.__getitem__
        totals = [sum(map(get, p)) for p in cut]
        slow = [k for k, n in enumerate(totals) if n < 0 or not first[k] or _EDGE.search(first[k])]
        heads = self.each([BYTE_PATTERN.findall(p) for p in first])
        whole = dict(zip(slow, self.each([BYTE_PATTERN.findall(parts[k]) for k in slow])))
        for k, i in enumerate(owner):
            out[i] += whole[k] if k in whole else heads[k] + totals[k]
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    """One counter for all tasks of a worker."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row's whole text."""

    def make():
        counting = counter(path)

        def work(texts: list[str]) -> dict:
            n = counting.count(texts)
            return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return work

    return map_column(docs, make, "n_bytes long, n_tokens long, over_limit boolean", text, (id_col,))
