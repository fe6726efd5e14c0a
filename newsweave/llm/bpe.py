"""Byte-pair merging over batches: rank-synchronous merging of ragged arrays.

All pre-tokens of a batch lie end to end in one symbol array.  A round looks up
the rank of every adjacent pair, finds each sequence's lowest rank, applies that
pair everywhere in its sequence at once (left to right where occurrences
overlap), and drops sequences that have no pair left.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex

#: Unicode white space, as the vocabularies' patterns mean by \s.
SPACE = r"\t-\r \x85\xa0  -     　"
BYTE_PATTERN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
WORD_PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
NO_RANK = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 stands for itself, the other bytes take code points from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class PairRanks:
    """Open-addressing hash table from a symbol pair to its merge rank."""

    BITS = 18
    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, left: np.ndarray, right: np.ndarray):
        keys = left.astype(np.int64) << 20 | right
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.ranks = np.full(1 << self.BITS, NO_RANK, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]] = keys[todo[put]]
            self.ranks[slot[put]] = todo[put]
            todo, slot = todo[~put], slot[~put]
            taken = self.keys[slot] >= 0
            slot = np.where(taken, (slot + 1) & ((1 << self.BITS) - 1), slot)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.MIX) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 20 | right
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.ranks[slot], NO_RANK)
        miss = np.flatnonzero((held != keys) & (held >= 0))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & ((1 << self.BITS) - 1)
            held = self.keys[slot[miss]]
            hit = held == keys[miss]
            out[miss[hit]] = self.ranks[slot[miss[hit]]]
            miss = miss[~hit & (held >= 0)]
        return out


class ArrayBPE:
    """Merges of one vocabulary file (``.json`` of the tokenizers library)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, self.special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.pairs = PairRanks(left, right)
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int32)
        self.last = np.array([vocab[c + suffix] for c in symbols], np.int32)
        self.width = max(max(vocab.values()), *self.special.values()) + 1

    def merge(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of non-empty pre-tokens end to end, and how many each has."""
        lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
        return self.merge_flat(np.frombuffer(b"".join(tokens), np.uint8), lens)

    def merge_flat(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As merge(), for pre-tokens given as bytes end to end and their lengths."""
        if not len(lens):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        sym = self.inner[data]
        ends = np.cumsum(lens)
        sym[ends - 1] = self.last[data[ends - 1]]
        seq = np.repeat(np.arange(len(lens)), lens)
        out_sym, out_seq = [], []
        while len(sym):
            rank = np.full(len(sym), NO_RANK, np.int32)
            inside = np.flatnonzero(seq[1:] == seq[:-1])
            rank[inside] = self.pairs.find(sym[inside], sym[inside + 1])
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            size = np.diff(np.r_[starts, len(sym)])
            low = np.repeat(np.minimum.reduceat(rank, starts), size)
            done = low == NO_RANK
            if done.any():
                out_sym.append(sym[done])
                out_seq.append(seq[done])
                sym, seq, rank, low = (x[~done] for x in (sym, seq, rank, low))
            at = np.flatnonzero(rank == low)
            if not len(at):
                break
            new_run = np.r_[True, np.diff(at) != 1]
            run_start = np.maximum.accumulate(np.where(new_run, at, 0))
            at = at[(at - run_start) % 2 == 0]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, seq = sym[keep], seq[keep]
        sym, seq = np.concatenate(out_sym or [sym]), np.concatenate(out_seq or [seq])
        order = np.argsort(seq, kind="stable")
        return sym[order], np.bincount(seq, minlength=len(lens))


def normal_word(word: str) -> str:
    """NFC and lower case, code point by code point (no final-sigma rule)."""
    if word.isascii():
        return word.lower()
    return "".join(map(str.lower, unicodedata.normalize("NFC", word)))
