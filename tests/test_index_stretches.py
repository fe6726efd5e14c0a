"""Words are counted where their item is; no text moves, and a term moves once for many items."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from newsweave.operators import search_index, store
from newsweave.plans import items_queries
from newsweave.plans.bindings import searched

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("held", [300_000, 50])
def test_a_term_is_a_row_for_a_stretch_of_items(spark, monkeypatch, held):
    monkeypatch.setattr(search_index, "HELD", held)
    rows = [(1, ["a", "b", "a"]), (2, []), (None, ["b"]), (3, ["b", "c", "é"]), (1, ["a"])]
    items = spark.createDataFrame(rows, "id int, search_vector array<string>").coalesce(1)
    found = search_index.postings(items).cache()
    assert found.count() == 4 and dict(found.dtypes)["ids"] == "array<int>"
    got = sorted(map(str, (tuple(r) for r in search_index.flat(found).select("term", "id", "tf").collect())))
    assert got == sorted(map(str, [("a", 1, 2), ("b", 1, 1), ("b", None, 1), ("b", 3, 1), ("c", 3, 1), ("é", 3, 1), ("a", 1, 1)]))


def test_stretches_end(spark):
    import pyarrow as pa

    many = pa.RecordBatch.from_arrays([pa.array(range(40_000), pa.int64()), pa.array([" ".join(f"w{k}" for k in range(20))] * 40_000)], ["id", "words"])
    out = list(search_index.counted([many]))
    assert len(out) == 3 and sum(len(b) for b in out) == 60 and sum(len(x) for b in out for x in b.column(1)) == 800_000


def test_texts_of_the_index_pass_no_join_or_shuffle_by_row(spark, monkeypatch):
    seen, real = [], search_index.write_batch
    monkeypatch.setattr(search_index, "write_batch", lambda items, *a: (seen.append(items), real(items, *a))[1])
    entry.queries()["P11_full_text_index"](spark, SF)
    plan = search_index.postings(seen[0])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_searched_columns_are_those_of_items(spark):
    names = ["id", "title", "full_text", "source"]
    assert sorted(map(str, searched(spark, SF).select(names).collect())) == sorted(map(str, items_queries.items(spark, SF).select(names).collect()))


def test_search_by_the_index_passes_no_join_of_items(spark):
    plan = entry.queries()["Q13_search_index"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "page" not in plan and "event" not in plan and "LeftOuter" not in plan


@pytest.mark.parametrize("gathered", [2_000_000, 7, 1])
def test_a_term_moves_once_for_many_stretches(monkeypatch, gathered):
    import pyarrow as pa

    monkeypatch.setattr(search_index, "HELD", 4)
    monkeypatch.setattr(search_index, "GATHERED", gathered)
    rows = pa.RecordBatch.from_arrays([pa.array([*range(29), None], pa.int64()), pa.array([f" a b  a w{i}" for i in range(30)])], ["id", "words"])
    out = list(search_index.gathered(search_index.counted([rows.slice(0, 9), rows.slice(9, 0), rows.slice(9)])))
    assert len(out) == {2_000_000: 1, 7: 10, 1: 30}[gathered] and all(len(set(b.column(0).to_pylist())) == len(b) for b in out)
    got = sorted((t, str(i), n) for b in out for t, ids, tfs in zip(*(c.to_pylist() for c in b.columns), strict=True) for i, n in zip(ids, tfs, strict=True))
    assert got == sorted(row for i in [*range(29), None] for row in (("a", str(i), 2), ("b", str(i), 1), (f"w{29 if i is None else i}", str(i), 1)))


def test_words_of_ascii_and_other_texts_are_those_of_the_regular_expression(spark):
    texts = ["".join(map(chr, range(1, 128))), "A_b C9-d, e", "ÀB c\u2019d Σ ΑΣ'Β ΑΣ K İx ٣ ½ ß_Ǆ", "", " ", None, "x" * 70_000, "a\u00a0b e\u0301", "𝐀b 日本 語,x"]
    rows = [(i, t, t, s) for i, (t, s) in enumerate((t, s) for t in texts for s in ("RSS", "ÉS", None))]
    items = spark.createDataFrame(rows, "id int, title string, full_text string, source string").coalesce(2)
    words = items.select("id", F.explode(store.search_vector()).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    got = search_index.flat(search_index.postings(items)).select("id", "term", "tf")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, words.collect()))


def test_texts_of_ascii_pass_no_regular_expression(spark):
    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["", "The LICENSE_2, of\nReddit!", "é ß"])], ["id", "words"]).slice(1)
    assert search_index.words_of_ascii(rows).column(1).to_pylist() == ["the license_2  of reddit ", "é ß"]


def test_written_postings_are_read_back(spark, tmp_path):
    items = spark.createDataFrame([(i, ["a", f"w{i % 7}"]) for i in range(50)], "id long, search_vector array<string>")
    search_index.write_batch(items, str(tmp_path), 0, buckets=4)
    got = search_index.flat(spark.read.parquet(f"{tmp_path}/postings")).select("term", "id", "tf").collect()
    assert sorted(map(tuple, got)) == sorted(row for i in range(50) for row in (("a", i, 1), (f"w{i % 7}", i, 1)))
