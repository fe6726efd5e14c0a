"""How the sources of a language differ in their terms (operator 12).

Terms are counted in tasks, with sums handed on whenever a task holds many of them, so a hot term
or source moves as a few rows.  The counts of a language form a matrix of sources by kept terms.
It is cut into tiles of 64 sources by about 512 terms (by hash; the commonest come first in a
tile), and each pair of source bands meets in one group for each range of terms.  There a
k-squared tree with k = 2 marks which quadrants hold any count.  Pairs of source quadrants are
traversed jointly: where both are all zero nothing is done, else both are cut into four, down to
leaves of eight by eight, which are compared cell by cell.  The columns that no leaf of a pair covers
are uniform, and priced at once: their number times the distance of the two sources' shares
of an absent term.

All arithmetic is in integers.  A share, 1 + floor(10^9 (count + 5) / (N + 5 V)), is found with
decimals.

Null texts, languages and sources are empty ones.  A document without terms makes its group known
all the same.  Repeated rows count again.  A language without kept terms has pairs of value 0 and
no rows of terms; a language of one source has no pairs.  Very long texts are counted in one piece
but hold only their distinct terms.  Other columns are left out, so clashing names don't matter.
An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, slices, stored, text_col

LEAST_DOCS, TOP, PRIOR, UNIT = 30, 50, 5, 1_000_000_000
#: Sources and terms (about) of a tile; side of a leaf.
BAND, SPAN, LEAF = 64, 512, 8
#: A task hands on its counts whenever it holds so many.
HELD = 400_000

#: Letters of ASCII in lower case and bytes of other characters stay, the rest parts terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

CELLS = "lang string, source string, term string, n bigint, docs bigint"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (lang, source, term) of a task; the empty term stands for the group itself."""
    held: dict[tuple, dict[bytes, list[int]]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in held.items():
            n, docs = zip(*counts.values(), strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * len(n), pa.string()) for x in (lang, source)]
                + [pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, _, texts in slices(batch.column(2), binary=True):
            for i, text in enumerate(texts, a):
                counts = held.setdefault((langs[i], sources[i]), {b"": [0, 0]})
                size -= len(counts)
                for term, n in Counter(terms_of(text)).items():
                    found = counts.get(term)
                    if found is None:
                        counts[term] = [n, 1]
                    else:
                        found[0] += n
                        found[1] += 1
                size += len(counts)
                if size > HELD:
                    yield from flush()
                    size = 0
    yield from flush()


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)); null where there is nothing to divide by."""
    over = (n + PRIOR).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    under = F.nullif((total + PRIOR * terms).cast("decimal(20,0)"), F.lit(0))
    return ((over - F.pmod(over, under)) / under).cast("long") + 1


def tree(cells: np.ndarray) -> list[np.ndarray]:
    """Which quadrants hold a count, from the leaves (``LEAF`` a side) up to one root."""
    rows, cols = cells.shape
    side = LEAF
    while side < max(rows, cols):
        side *= 2
    full = np.zeros((side, side), bool)
    full[:rows, :cols] = cells
    levels = [full.reshape(side // LEAF, LEAF, side // LEAF, LEAF).any(axis=(1, 3))]
    while levels[-1].shape[0] > 1:
        half = levels[-1].shape[0] // 2
        levels.append(levels[-1].reshape(half, 2, half, 2).any(axis=(1, 3)))
    return levels


def joint_leaves(levels: list[np.ndarray], row_leaves: int) -> np.ndarray:
    """(row leaf, other row leaf, column leaf) with a count on either side, first row leaf not
    above the other, all below ``row_leaves``; found from the root down, a pair of quadrants at a time."""
    at = np.zeros((1, 3), np.int64)
    for level in reversed(levels):
        leaves = len(levels[0]) // len(level)
        at = at[(level[at[:, 0], at[:, 2]] | level[at[:, 1], at[:, 2]]) & (at[:, 1] * leaves < row_leaves)]
        if level is levels[0]:
            return at
        halves = np.array([(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)])
        at = (2 * at[:, None, :] + halves).reshape(-1, 3)
        at = at[at[:, 0] <= at[:, 1]]
    return at


def tile_pairs(shares: np.ndarray, absent: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of share distances, columns covered) at the leaves, by pair of rows.

    ``shares`` has ``absent`` of its row wherever ``some`` (the counts above zero) doesn't hold."""
    rows, cols = shares.shape
    levels = tree(some)
    side = len(levels[0]) * LEAF
    full = np.zeros((-(-rows // LEAF) * LEAF, side), np.int64)
    full[:rows] = absent[:, None]
    full[:rows, :cols] = shares
    inside = (np.arange(side) < cols).reshape(-1, LEAF)
    value = np.zeros((len(full), len(full)), np.int64)
    covered = np.zeros_like(value)
    at = joint_leaves(levels, len(full) // LEAF)
    blocks = full.reshape(len(full) // LEAF, LEAF, side // LEAF, LEAF).transpose(0, 2, 1, 3)
    views = [x.reshape(len(full) // LEAF, LEAF, -1, LEAF).transpose(0, 2, 1, 3) for x in (value, covered)]
    for k in range(0, len(at), 1024):
        a, b, c = at[k : k + 1024].T
        apart = np.abs(blocks[a, c][:, :, None, :] - blocks[b, c][:, None, :, :]) * inside[c][:, None, None, :]
        np.add.at(views[0], (a, b), apart.sum(axis=3))
        np.add.at(views[1], (a, b), inside[c].sum(axis=1)[:, None, None])
    return value[:rows, :rows], covered[:rows, :rows]


PAIRS = "lang string, g int, h int, value bigint, covered bigint"


def compare_tile(cells: pd.DataFrame) -> pd.DataFrame:
    """Cells (lang, g, band, other, absent, term, n, p) of two bands of sources (or one) in one range of
    terms, and a row without a term for each of these sources."""
    lang, band, other = cells["lang"].iloc[0], int(cells["band"].iloc[0]), int(cells["other"].iloc[0])
    rows, row_at = np.unique(cells["g"].to_numpy(), return_inverse=True)
    absent = np.zeros(len(rows), np.int64)
    absent[row_at] = cells["absent"]
    used = cells["term"].notna().to_numpy()
    row_at, cells = row_at[used], cells[used]
    found, names = pd.factorize(cells["term"])
    order = np.argsort(-np.bincount(found, weights=cells["n"].to_numpy(), minlength=len(names)), kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    shares = np.repeat(absent[:, None], len(names), axis=1)
    shares[row_at, place[found]] = cells["p"]
    some = np.zeros(shares.shape, bool)
    some[row_at, place[found]] = True
    value, covered = tile_pairs(shares, absent, some)
    a, b = np.nonzero(np.triu(covered, 1))
    if band != other:  # pairs within a band have a group of their own
        across = rows[a] // BAND != rows[b] // BAND
        a, b = a[across], b[across]
    return pd.DataFrame({"lang": lang, "g": rows[a].astype("int32"), "h": rows[b].astype("int32"), "value": value[a, b], "covered": covered[a, b]})


def cells_of(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs); the empty term for each group."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))], text_col(text).alias("text"))
    counted = named.mapInArrow(_count, CELLS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def audit(
    docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source the other sources of its language by
    distance (part ``pair``), and the ``top`` terms that it uses more than its language (``term``)."""
    cells = stored(cells_of(docs, text, lang, source))
    kept = checkpoint(
        cells.where("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= least_docs).drop("docs")
    )
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    own = checkpoint(cells.where("term != ''").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = checkpoint(  # one short row for each source of a language
        cells.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", number.alias("g"), zero("total"), zero("v"), zero("lang_total"))
        .withColumn("absent", F.coalesce(share(F.lit(0), F.col("total"), F.col("v")), F.lit(0)))
    )
    known = checkpoint(
        own.join(groups, ["lang", "source"])
        .select("lang", "source", "g", "term", "n", "v", "absent", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))
    )
    return _pairs(known, groups).unionByName(_terms(known, top))


def _ranked(df: DataFrame, top: int | None = None) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    ranked = df.withColumn("rank", place)
    ranked = ranked.where(F.col("rank") <= top) if top is not None else ranked
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def _terms(known: DataFrame, top: int) -> DataFrame:
    above = known.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(above, top)


def _pairs(known: DataFrame, groups: DataFrame) -> DataFrame:
    last = groups.groupBy(F.col("lang").alias("of")).agg(F.floor(F.max("g") / BAND).alias("last"))
    spans = F.greatest(F.ceil(F.col("v") / SPAN), F.lit(1))
    every = groups.where("v > 0").select("lang", "g", "v", "absent", F.lit(None).cast("string").alias("term"), F.lit(0).alias("n"), F.lit(0).alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), spans - 1)).alias("span"))
    cells = known.select("lang", "g", "v", "absent", "term", "n", "p", F.pmod(F.xxhash64("term"), spans).alias("span")).unionByName(every)
    band = F.floor(F.col("g") / BAND)
    dealt = (
        cells.join(F.broadcast(last) if last.count() <= 100_000 else last, F.col("lang") == F.col("of"))
        .withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
        .select("lang", "g", "term", "n", "p", "absent", "span", F.least(band, F.col("with")).alias("band"), F.greatest(band, F.col("with")).alias("other"))
    )
    compared = dealt.groupBy("lang", "span", "band", "other").applyInPandas(compare_tile, PAIRS)
    at_leaves = compared.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"), F.sum("covered").alias("covered"))
    left = groups.select("lang", "source", "g", "absent", "v")
    right = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("absent").alias("other_absent"))
    # the result itself has a row for each pair of a language's sources
    pairs = left.join(right, "lang").where("g < h").join(at_leaves, ["lang", "g", "h"], "left")
    uniform = (F.col("v") - F.coalesce("covered", F.lit(0))) * F.abs(F.col("absent") - F.col("other_absent"))
    priced = pairs.select("lang", "source", "item", (F.coalesce("value", F.lit(0)) + uniform).alias("value"))
    both = priced.unionByName(priced.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    return _ranked(both.withColumn("part", F.lit("pair")))


#: The contract in DuckDB: every cell of every pair.
SQL = r"""
WITH base AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
grp AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS ln FROM base GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(ln) AS lt FROM kept GROUP BY lang),
cnt AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM base SEMI JOIN kept USING (lang, term) GROUP BY ALL),
tot AS (SELECT lang, source, sum(n) AS total FROM cnt GROUP BY ALL),
cell AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.ln + 5)) // (l.lt + 5 * l.v) AS q
  FROM grp g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN tot t USING (lang, source) LEFT JOIN cnt c USING (lang, source, term)),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
  FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source != b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM cell WHERE n > 0 AND p > q)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 50
"""
