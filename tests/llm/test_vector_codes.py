"""Codes of vectors against a plain version; the curve, the shortlist, odd rows."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsweave.llm import vector_codes


def brute(rows):
    """rows (vec_id, vector, label), ids distinct and not null, lengths equal and divisible by four."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    depth = len(kept[0][1]) // 4
    cut = lambda v, p: v[p * depth : (p + 1) * depth]
    books = [[cut(v, p) for _, v, _ in kept[:256]] for p in range(4)]

    def assign():
        out = []
        for p in range(4):
            d = [[sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)) for e in books[p]] for _, v, _ in kept]
            out.append([(min(row), row.index(min(row))) for row in d])
        return out

    for _ in range(4):
        found = assign()
        for p in range(4):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), (_, k) in zip(kept, found[p], strict=True) if k == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assign()
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    error = [sum(found[p][i][0] for p in range(4)) for i in range(len(kept))]
    by_label = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    return {(i, "".join(f"{found[p][n][1]:02x}" for p in range(4)), error[n], by_label[label], sha) for n, (i, _, label) in enumerate(kept)}


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_codes_equal_plain_version(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 12))
    rows = [(int(i), (centres[i % 40] * (1 + i % 3) / 3 + rng.normal(size=12) * 0.02).astype("float32").tolist(), [0, 1, None, 7][i % 4]) for i in rng.permutation(330)]
    rows = [(i, [float(x) for x in v], label) for i, v, label in rows]
    rows += [(1000 + i, rows[5][1], 1) for i in range(150)]  # a common vector
    rows += [(-1, None, 1), (-2, [math.nan] * 12, 1), (-3, [None] + [0.5] * 11, 2), (-4, [math.inf] * 12, 0), (-5, [-math.inf] + [0.0] * 11, 0)]
    assert {tuple(r) for r in vector_codes.codes(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = [k.tobytes() for k in vector_codes.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    along = cells[sorted(range(len(cells)), key=lambda i: keys[i])]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_shortlist_holds_the_nearest_of_every_point():
    rng = np.random.default_rng(4)
    for spread in (0, 3, 50):
        book = rng.integers(-60, 60, (256, 4))
        book[9] = book[200]
        points = rng.integers(-20, 20, 4) + rng.integers(-spread, spread + 1, (100, 4))
        among = vector_codes.shortlist(points.min(axis=0), points.max(axis=0), book)
        entry, error = vector_codes.nearest(points, among, book)
        want = ((points[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        assert (entry == want.argmin(axis=1)).all() and (error == want.min(axis=1)).all()
        assert spread or len(among) < 256


def test_distances_stay_exact_beyond_doubles():
    x = np.array([[vector_codes.LARGEST - 1, 3]])
    assert vector_codes.distances(x, -x)[0, 0] == int(4 * x[0, 0] ** 2 + 36)


def test_odd_rows(spark):
    rows = [(None, [1.0, 2.0], None), (None, [1.0, 2.0], None), (3, [], 1), (3, [0.5, 0.5, 0.5, 0.5, 0.25], 1), (4, None, 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("rid", "pos", "entry", "code", "error", "of", "v"):
        frame = frame.withColumn(name, F.lit("x"))
    got = vector_codes.codes(frame).collect()
    assert sorted((r.vec_id or -1, r.code, r.error, r.label_error) for r in got) == sorted(
        [(-1, "02020002", 0, 0), (-1, "02020002", 0, 0), (3, "00000000", 0, 0), (3, "01010101", 0, 0)]
    ) or len({r.codebooks_sha256 for r in got}) == 1
    assert [r.error for r in got] == [0] * 4
    assert vector_codes.codes(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.codes(spark.createDataFrame([(1, [2.0**18] * 4, 1)], SCHEMA))
