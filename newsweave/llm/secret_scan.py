"""Secret scans (operator 2): pattern detectors and password guess cost.

Base detectors (fixed patterns below) give spans of kinds assign, access and
hex.  The method adds spans of kind ``guess``: values that stand in a credential
context ("password is ...", "pin: ...") are segmented at least cost, by dynamic
programming, into known words, dates, repeats, keyboard walks and brute-force
spans; a value that needs at least ``bits`` bits of guesses is a secret.

Known words are frequent words of passwords and the whole words of a public vocabulary, in their
order; the places in these lists are the guesses.  Nothing is learnt from the documents, so what is a
secret in a text doesn't depend on the others.

A value reaches to the next white space, letters of any script included.  A context begins where a
word does.  What only refers to something is no secret: addresses without credentials, e-mail and
network addresses, times, expressions of program code, placeholders.  A value of letters alone
whose pairs of letters are those of words (by the vocabulary) isn't either, as prose and names stand
there, too; after "is" other letters need ``PROSE_BITS``.

Offsets are code points, ends exclusive.  Null and empty texts have no spans.
Repeated rows give the same spans.  Texts of any length are scanned whole;
values are scanned whole too, in time proportional to their length.  An empty table
gives no rows.  redact() passes other columns on, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_column, slices

#: The base detectors.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "guess")
LEAST = {"assign": 12, "access": 18, "hex": 16}

_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
# A run of the class is matched whole, so runs that are too short can be left out at once.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_ -]?key|login|pin)["']?\s{0,3}([:=]|\bis\b)\s{0,3}["'«„“”‘’]?(\S{6,})""",
    re.ASCII | re.IGNORECASE,
)
#: Frequent words of passwords, most frequent first; the place is the number of guesses.
COMMON = (
    "password qwerty admin welcome login letmein dragon monkey master sunshine princess football baseball "
    "shadow superman batman secret hello freedom whatever trustno starwars computer internet service "
    "summer winter spring autumn monday friday january march april june july august october december "
    "love money family friend flower orange purple silver golden cookie pepper ginger summer test demo "
    "user guest root changeme default system server access key token pass word temp new my the and you "
    "for not with this that from have one two red blue green black white dog cat home work school"
).split()
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
BITS = 40.0
#: After "is" stands mostly prose, so a value of letters alone needs so many bits.
PROSE_BITS = 60.0
#: Letters of which each pair costs so many bits at most read like a word.
WORDLIKE_BITS = 4.4
#: What only refers to something: addresses without a user's name and password, e-mail and network addresses, times,
#: program code (a name with a call, an index or parts), placeholders.
_REFERENCE = re.compile(
    r"[A-Za-z][A-Za-z0-9+.-]*://[^@\s]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\d{1,3}(?:\.\d{1,3}){3}(?::\d+|/\d+)?|(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{0,4}"
    r"|\d{4}-\d\d-\d\d(?:T[\d:.]*(?:Z|[+-][\d:]+)?)?|\d\d?[./]\d\d?[./]\d{4}|\d\d?:\d\d(?::\d\d)?"
    r"|[$%#@]?[{(\[<].*|\$\w+|[$A-Za-z_][A-Za-z_]*(?:\d?\.[A-Za-z_]+\d?)*[(\[].*|[A-Za-z_]+(?:(?:\.|::|->)[A-Za-z_]+)+"
    r"|(?-i:[A-Z]+(?:[_-][A-Z]+)+)|(?:your|my|the|enter|insert|example|sample|dummy)[_-].*|(.)\1*",
    re.ASCII | re.IGNORECASE,
)
#: Letters of a word.
LETTERS = (3, 24)


def word_costs() -> dict[str, float]:
    return {w: math.log2(i + 2) for i, w in reversed(list(enumerate(dict.fromkeys(COMMON))))}


def neighbours() -> set[tuple[str, str]]:
    """Keys next to each other along a row or across two rows, both ways."""
    out = set()
    for r, row in enumerate(ROWS):
        for c, key in enumerate(row):
            near = [row[c + 1]] if c + 1 < len(row) else []
            if r + 1 < len(ROWS):
                near += [ROWS[r + 1][k] for k in (c - 1, c) if 0 <= k < len(ROWS[r + 1])]
            out |= {(key, n) for n in near} | {(n, key) for n in near}
    return out


_WORDS, _NEAR = word_costs(), neighbours()
_WORD = re.compile("[a-z]{%d,%d}" % LETTERS)
_DATE = re.compile(r"(?:19|20)\d\d(?:([-/.]?)(?:0[1-9]|1[0-2])(?:\1(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d", re.ASCII)
_LEET = str.maketrans("4@8301!5$7", "aabeoliSst".lower())


@lru_cache(maxsize=1)
def vocabulary() -> tuple[str, ...]:
    """Whole words of the public vocabulary, most frequent first."""
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        ids = json.load(f)["model"]["vocab"]
    whole = (w.removesuffix("</w>") for w in sorted(ids, key=ids.get) if w.endswith("</w>"))
    return tuple(w for w in whole if _WORD.fullmatch(w))


@lru_cache(maxsize=1)
def dictionary() -> dict[str, float]:
    """Cost of each known word: of its better place in the two lists."""
    costs = dict(_WORDS)
    for i, w in enumerate(vocabulary()):
        costs[w] = min(costs.get(w, math.inf), math.log2(i + 2))
    return costs


@lru_cache(maxsize=1)
def pair_bits() -> dict[str, float]:
    """Bits of a letter behind the one before it in the words of the vocabulary, each pair counted once more."""
    ends = "abcdefghijklmnopqrstuvwxyz"
    pairs = Counter(w[i : i + 2] for w in vocabulary() for i in range(len(w) - 1))
    first = Counter()
    for pair, n in pairs.items():
        first[pair[0]] += n
    return {a + b: -math.log2((pairs[a + b] + 1) / (first[a] + len(ends))) for a in ends for b in ends}


def wordlike(value: str) -> bool:
    """Letters alone, of one case but for the first, that read like a word; letters beyond a to z count as such."""
    if not value.isalpha() or not (value[1:].islower() or value.isupper()):
        return False
    bits, low = pair_bits(), value.lower()
    found = [bits[p] for p in (low[i : i + 2] for i in range(len(low) - 1)) if p in bits]
    return not found or sum(found) / len(found) <= WORDLIKE_BITS


def alphabet(value: str) -> float:
    """Bits of one brute-force character, from the kinds of characters that occur."""
    size = sum(n for n, p in ((26, "[a-z]"), (26, "[A-Z]"), (10, "[0-9]"), (33, "[!-/:-@[-`{-~]"), (100, "[^!-~]")) if re.search(p, value))
    return math.log2(max(size, 2))


def guess_bits(value: str, words: dict[str, float] = _WORDS) -> float:
    """Least log2 guesses over all segmentations of ``value``.

    best[i] is the least cost of the first i characters.  Segments that end at
    or start from each place: one brute-force character; a known word (also
    upper case or with digits for letters, one bit each); a date (log2 of the
    days of two centuries); a run of one character or of a repeated unit of two
    to four (the unit's brute force and the number of times); a keyboard walk of
    three keys or more (start key, and one bit and a half a step).  Every segment
    costs one bit besides, for where it is cut.
    """
    n, low = len(value), value.lower()
    plain = low.translate(_LEET)
    per_char = alphabet(value)
    best = [0.0] + [math.inf] * n
    brute = [False] * (n + 1)

    def reach(i: int, j: int, cost: float) -> None:
        if best[i] + cost < best[j]:
            best[j], brute[j] = best[i] + cost, False

    walk_from, walk_end = 0, {}
    for i in range(1, n + 1):
        if i == n or (low[i - 1], low[i]) not in _NEAR:
            for s in range(walk_from, i - 2):
                walk_end[s] = i
            walk_from = i
    unit_end = [dict() for _ in range(n)]
    for u in (1, 2, 3, 4):
        run = 0
        for i in range(n - u - 1, -1, -1):
            run = run + 1 if low[i] == low[i + u] else 0
            if run >= max(u, 2):
                unit_end[i][u] = i + u + run // u * u
    for i in range(n):
        step = per_char + (0.0 if brute[i] else 1.0)
        if best[i] + step < best[i + 1]:
            best[i + 1], brute[i + 1] = best[i] + step, True
        for j in range(i + 2, min(n, i + LETTERS[1]) + 1):
            for form, extra in ((low, 0.0), (plain, 1.0)):
                if (cost := words.get(form[i:j])) is not None:
                    cased = 0.0 if value[i:j] == low[i:j] else 1.0
                    reach(i, j, 1.0 + cost + extra + cased)
        if found := _DATE.match(value, i):
            reach(i, found.end(), 1.0 + math.log2(365 * 200 if found.end() - i > 4 else 200))
        for u, j in unit_end[i].items():
            reach(i, j, 1.0 + u * per_char + math.log2((j - i) / u))
        if i in walk_end:
            j = walk_end[i]
            reach(i, j, 1.0 + math.log2(47) + 1.5 * (j - i - 1))
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base detectors, in order."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def is_guess(sign: str, value: str, bits: float, words: dict[str, float]) -> bool:
    if len(value) < 6 or _REFERENCE.fullmatch(value) or wordlike(value):
        return False
    prose = sign not in ":=" and value.isalpha() and (value[1:].islower() or value.isupper())
    return guess_bits(value, words) >= (max(bits, PROSE_BITS) if prose else bits)


def guess_spans(text: str, bits: float = BITS, words: dict[str, float] = _WORDS) -> list[tuple[int, int, int]]:
    return [
        (m.start(2), 3, m.start(2) + len(value))
        for m in _CONTEXT.finditer(text)
        if is_guess(m[1], value := m[2].rstrip("\"',;)]}>.»“”’"), bits, words)
    ]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, bits: float = BITS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, n_guess of each row's whole text."""

    def make():
        words = dictionary()

        def work(texts: list[str]) -> dict:
            base = [base_spans(t) for t in texts]
            guess = [guess_spans(t, bits, words) for t in texts]
            counts = [[sum(k == kind for _, k, _ in s) for s in base] for kind in range(3)]
            return {
                "n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2],
                "base_sha256": [hashlib.sha256(joined(s).encode()).hexdigest() for s in base],
                "spans": [joined(sorted(s + g)) for s, g in zip(base, guess)],
                "n_guess": [len(g) for g in guess],
            }

        return work

    schema = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"
    return map_column(docs, make, schema, text, (id_col,))


def redacted(text: str, mark: str = "[SECRET]", bits: float = BITS, words: dict[str, float] = _WORDS) -> str:
    """The text with every span replaced by the mark; overlapping spans by one."""
    out, upto = [], 0
    for a, _, b in sorted(base_spans(text) + guess_spans(text, bits, words)):
        if b <= upto:
            continue
        if a >= upto:
            out += [text[upto:a], mark]
        upto = b
    return "".join([*out, text[upto:]]) if out else text


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars", bits: float = BITS) -> DataFrame:
    """docs with secrets replaced in the text and, where there is such a column, its
    length brought up to date in rows that changed.  Null texts stay null."""
    at = docs.columns.index(text)
    size_at = docs.columns.index(length) if length in docs.columns else None
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = dictionary()
        for batch in batches:
            for a, b, old in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                new = [redacted(t, bits=bits, words=words) for t in old]
                if new != old:  # most slices have no secret
                    columns, changed = list(part.columns), [n != o for n, o in zip(new, old)]
                    columns[at] = pa.array([n if c else t for n, c, t in zip(new, changed, columns[at].to_pylist())], columns[at].type)
                    if size_at is not None:
                        sizes = [len(n) if c else s for n, c, s in zip(new, changed, columns[size_at].to_pylist())]
                        columns[size_at] = pa.array(sizes, columns[size_at].type)
                    part = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
                yield part
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)
