"""The pipeline's near-dedup stage against exact five-word similarity."""

import random

import numpy as np
import pytest

import corpus_pipeline
from newsweave.llm import near_copies, simhash
from newsweave.llm.components import connected_components


def near(text, rng, changes):
    words = text.split()
    for k in rng.sample(range(0, len(words), 7), changes):
        words[k] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike_sets(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


def edited(words, rate, rng):
    return " ".join(f"e{rng.randrange(10**9)}" if rng.random() < rate else w for w in words)


def classes_of(texts):
    """Least number reachable from each text over pairs of similarity 0.8 or more, all pairs compared."""
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if top(i) != top(j) and alike_sets(x, sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


def kept_ids(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    return sorted(r.doc_id for r in near_copies.drop_near_copies(docs, **more).collect())


@pytest.mark.parametrize("families,members,rate", [(3, 40, 0.02), (2, 200, 0.03), (1, 600, 0.03), (1, 600, 0.035), (2, 100, 0.033)])
def test_no_link_of_a_family_is_lost(spark, families, members, rate):
    rng = random.Random(members)
    texts = []
    for f in range(families):
        base = [f"w{f}x{rng.randrange(4000)}" for _ in range(300)]
        texts += [edited(base, rate, rng) for _ in range(members)]
    rng.shuffle(texts)
    want = classes_of(texts)
    assert 1 < len(set(want)) < len(texts)
    assert kept_ids(spark, texts) == sorted(set(want))


def test_buckets_over_most_and_families_of_many_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "MEMBERS", 30)  # read where the plan is made
    rng = random.Random(8)
    base = [f"w{rng.randrange(4000)}" for _ in range(300)]
    texts = [edited(base, 0.03, rng) for _ in range(250)] + [edited(base, 0.001, rng) for _ in range(100)]
    want = sorted(set(classes_of(texts)))
    assert kept_ids(spark, texts, most=16) == want
    assert kept_ids(spark, texts, most=2) == want


def test_checked_equals_all_pairs(monkeypatch):
    monkeypatch.setattr(near_copies, "COLUMNS", 64)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**64, 200, np.uint64)
    sets = [np.unique(np.r_[base[rng.random(200) < keep], rng.integers(0, 2**64, 5, np.uint64)]) for keep in rng.choice([0.85, 0.9, 0.95, 1], 60)]
    sets += [np.zeros(0, np.uint64)] * 2 + [sets[0]]
    for first in (len(sets), 20):
        pairs = [
            (i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
            if (first == len(sets) or (i < first) != (j < first)) and 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))
        ]
        want, got = np.arange(len(sets)), np.arange(len(sets))
        near_copies.join(want, *np.array(pairs).T)
        near_copies.join(got, *near_copies.checked(sets, first))
        assert (want == got).all()


def test_stage_drops_copies_beyond_three_bits(spark):
    rng = random.Random(1)
    first = [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(60)]
    alike = [near(x, rng, 4) for x in first]  # similarity 176/216 = 0.81
    other = [near(x, rng, 9) for x in first]  # similarity 151/241 = 0.63
    assert all(alike_sets(shingle_set(a), shingle_set(b)) for a, b in zip(first, alike))
    fps = simhash.fingerprints([x.encode() for x in first + alike])
    assert sum((int(a) ^ int(b)).bit_count() > 3 for a, b in zip(fps[:60], fps[60:])) > 30
    rows = [(k, x) for k, x in enumerate(first + alike + other)]
    kept = corpus_pipeline.drop_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [*range(60), *range(120, 180)]


def test_large_buckets_stay_one_class(spark):
    rng = random.Random(2)
    base = " ".join(f"w{k}" for k in range(200))
    rows = [(k, near(base, rng, 1)) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in near_copies.drop_near_copies(docs, most=16).collect()] == [0]


def test_odd_rows(odd_docs, no_docs):
    kept = near_copies.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "6", "8", "None"]
    assert near_copies.drop_near_copies(no_docs).count() == 0


def test_wide_bit_sliced_distances():
    rng = np.random.default_rng(3)
    fps = np.cumsum(rng.integers(0, 2**40, 300, np.uint64), dtype=np.uint64)
    cut = simhash.Sliced(fps, np.array([0, 5, 70]))
    rows = np.arange(300)
    for radius in (0, 1, 2, 3, 6, 13, 20, 26):
        for run, (s, e) in enumerate([(0, 5), (5, 70), (70, 300)]):
            width = cut.blocks[run]
            row = np.repeat(rows[s:e], width)
            block = np.tile(np.arange(cut.first_block[run], cut.first_block[run] + width), e - s)
            got = set(zip(*(x.tolist() for x in cut.pairs(row, block, radius))))
            assert got == {(i, j) for i in range(s, e) for j in range(s, e) if i != j and (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}


def test_forest_joins_what_the_radius_joins():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 2**64, 40, np.uint64)[rng.integers(0, 40, 500)] ^ (np.uint64(1) << rng.integers(0, 64, 500, np.uint64))
    a, b = near_copies.near_forest(fps, np.zeros(1, np.int64))
    label, all_pairs = np.arange(500), np.array([(i, j) for i in range(500) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 26])
    near_copies.join(label, *all_pairs.T)
    own = np.arange(500)
    near_copies.join(own, a, b)
    assert (own == label).all() and len(a) == 500 - len(set(label.tolist()))


def test_stage_equals_brute_force_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    want = classes_of([t for _, t in rows])
    kept = near_copies.drop_near_copies(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({rows[i][0] for i in want})


def test_repeated_rows_that_differ_elsewhere_leave_one_always(spark):
    rows = [(i % 5, f"the text of number {i % 5} is long enough to have shingles", i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other_h int")
    runs = [sorted(tuple(r) for r in near_copies.drop_near_copies(docs.repartition(n)).collect()) for n in (1, 7)]
    assert runs[0] == runs[1] and [r[0] for r in runs[0]] == [0, 1, 2, 3, 4]


def test_repeated_rows_stay_once(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, None), (None, ""), (3, "")]
    kept = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a b c d e f"), (3, "")]


def test_components_of_a_long_chain_and_of_no_edges(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(None, 7), (900, 900)], "a long, b long")
    assert {(r.node, r.root) for r in connected_components(chain, broadcast_rows=10).collect()} == {(k, 0) for k in range(301)}
    assert connected_components(chain.limit(0)).count() == 0
