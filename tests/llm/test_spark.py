"""Operators on tables: odd rows, empty tables, clashing columns, brute force on a small fixture."""

import hashlib
import re
import zlib

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from test_texts import all_links, families, labels_of

from newsweave.llm import bottomk, chat, components, mixing, mpegts, packing, quality, queries, secret_scan, simhash, token_counts, toxicity
from newsweave.llm.common import labelled_sample

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def by_id(df):
    return sorted(df.collect(), key=lambda r: (r[0] is None, r[0]))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


PLAIN = {
    "secrets": secret_scan.scan,
    "fingerprints": bottomk.fingerprint_edits,
    "simhash": simhash.near_duplicates,
    "mixing": mixing.mix_plan,
    "media": mpegts.media_columns,
    "tokens": lambda d: token_counts.count_tokens(d, BYTE),
    "toxicity": lambda d: toxicity.score(d, toxicity.train([], None)),
}


@pytest.mark.parametrize("name", PLAIN)
def test_odd_rows_keep_one_result_each_and_empty_tables_none(name, odd_docs, no_docs):
    rows = by_id(PLAIN[name](odd_docs))
    assert [r[0] for r in rows] == [1, 2, 3, 4, 5, 6, 7, 7, 8, None]
    # equal texts, equal values
    same = [r[1:] for r in rows if r[0] in (6, 7)]
    if name not in ("mixing", "fingerprints"):
        assert same[0] == same[1] == same[2]
    assert PLAIN[name](no_docs).count() == 0


def test_packing_odd_rows(odd_docs, no_docs):
    pieces = packing.pack(odd_docs, WORD).collect()
    assert packing.pack(no_docs, WORD).count() == 0
    assert sorted({p.doc_id for p in pieces}, key=str) == sorted([1, 2, 3, 4, 5, 6, 7, 8, None], key=str)
    assert sum(p.length for p in pieces) == sum({(p.doc_id, p.doc_tokens): p.doc_tokens for p in pieces}.values()) + next(p.doc_tokens for p in pieces if p.doc_id == 7)


def test_packing_holds_every_id_once(docs, texts):
    library = Tokenizer.from_file(WORD)
    pieces = packing.pack(docs, WORD, group_tokens=20_000).collect()
    rooms, at = {}, {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids = library.encode(texts[p.doc_id], add_special_tokens=False).ids + [1]
        assert p.doc_tokens == len(ids) and p.start == at.get(p.doc_id, 0)
        part = ids[p.start : p.start + p.length]
        at[p.doc_id] = p.start + p.length
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) == p.ids_crc32 and len(part) == p.length > 0
        rooms.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert len(at) == len(texts)
    for parts in rooms.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048 and end & (end - 1) == 0  # nothing is padded


def test_mix_reaches_targets(docs, texts, odd_docs):
    rows = mixing.mix_plan(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in texts.items()}
    weights, sources = {}, sorted({r.source for r in rows})
    for k, s in enumerate(sources):
        weights[s] = (3, 1, 2)[k % 3]
    own = {s: sum(r["size"] for r in rows if r.source == s) for s in sources}
    total, target, open_ = 1.5 * sum(own.values()), {}, set(sources)
    while open_:  # water-filling, one round of clamping at a time
        left = total - sum(target.values())
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 2 * own[s]}
        target |= {s: 2.0 * own[s] for s in over} if over else {s: level * weights[s] for s in open_}
        open_ = open_ - over if over else set()
    for r in rows:
        assert r["size"] == sizes[r.doc_id] and r.source_size == own[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r["size"]
    for s in sources:
        assert abs(sum(r.taken for r in rows if r.source == s) - target[s]) < 2
    assert sorted(mixing.mix_plan(docs).collect()) == sorted(mixing.mix_plan(docs.repartition(7)).collect())
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.where("n_chars > 1000").count() <= 2
    assert "Python" not in mixing.mix_plan(docs)._jdf.queryExecution().toString()


def test_edited_fingerprints(docs, texts):
    order = sorted(texts, reverse=True)
    rows = {r.doc_id: r for r in bottomk.fingerprint_edits(docs).collect()}

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    for k, d in enumerate(order):
        t, n = texts[d], texts[order[(k + 1) % len(order)]]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + n[:cut]
        r = rows[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t), shingles(edited)
        if len(a | b) <= bottomk.K:
            assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 1e-9
        else:
            assert abs(r.near_edited - len(a & b) / len(a | b)) < 0.2


def test_sketches_merge_by_source(docs, texts, odd_docs, no_docs):
    rows = docs.select("doc_id", "source").collect()
    sketches = bottomk.fingerprint(docs).join(docs.select("doc_id", "source"), "doc_id").repartition(5)
    got = {r.source: r for r in bottomk.merge_by(sketches, "source").collect()}
    sketch = bottomk.Sketcher()
    for source in {r.source for r in rows}:
        whole = sketch(b"")
        for r in rows:
            if r.source == source:
                whole = bottomk.merge(whole, sketch(texts[r.doc_id].encode()))
        assert got[source].fingerprint == bottomk.dump(whole)
    odd = bottomk.fingerprint(odd_docs, "source").select("source", "fingerprint")
    assert {r.source for r in bottomk.merge_by(odd, "source").collect()} == {"a", "b", "c", None}
    assert bottomk.merge_by(bottomk.fingerprint(no_docs), "doc_id").count() == 0


def test_near_duplicates_equal_brute_force(docs, texts, spark):
    rows = simhash.near_duplicates(docs).collect()
    fp = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    label = {d: d for d in fp}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sorted(fp):
        for b in sorted(fp):
            if b < a and (fp[a] ^ fp[b]).bit_count() <= 3:
                i, j = root(a), root(b)
                label[max(i, j)] = min(i, j)
    assert all(root(r.doc_id) == r.component_id for r in rows)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in rows})


def test_large_buckets_are_dealt_anew_without_loss(spark):
    fps = families(1, 2, 150)
    table = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps.tolist()], "fp long")
    edges = [(r.a & simhash.FULL, r.b & simhash.FULL) for r in simhash.links(table, most=20).collect()]
    assert labels_of(fps, edges) == labels_of(fps, all_links(fps))


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_components(spark, broadcast_rows):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (12, 12), (20, 5), (5, 4)] + [(100, 100 + k) for k in range(1, 40)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), broadcast_rows).collect()}
    assert got == {**{k: 1 for k in (1, 2, 3, 4, 5, 20)}, 10: 10, 11: 10, **{k: 100 for k in range(100, 140)}}


def test_drop_near_duplicates_odd_rows(odd_docs, no_docs):
    kept = simhash.drop_near_duplicates(odd_docs)
    # the three rows without words are one class, the three equal texts another
    assert kept.columns == odd_docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "6", "8", "None"]
    assert simhash.drop_near_duplicates(no_docs).count() == 0


def test_redaction_keeps_other_rows(odd_docs, spark):
    out = secret_scan.redact(odd_docs).collect()
    assert sorted(map(str, out)) == sorted(map(str, odd_docs.collect()))
    one = spark.createDataFrame([(1, "é token = abcdefghijkl1 x", 99)], "doc_id long, text string, n_chars long")
    r = secret_scan.redact(one).first()
    assert r.text == "é [SECRET] x" and r.n_chars == len(r.text)


def test_classifiers_on_tables(docs, labels, odd_docs, no_docs):
    for module, scored in ((quality, 3), (toxicity, 4)):
        model = module.fit(docs, labels)
        rows = by_id(module.score(odd_docs, model))
        assert len(rows) == 10 and all(0.0 <= r.score <= 1.0 for r in rows) and len(rows[0]) == scored
        assert module.score(no_docs, model).count() == 0
        empty = module.fit(docs, labels.limit(0))
        assert module.score(odd_docs, empty).count() == 10
    kept = toxicity.keep_clean(odd_docs, toxicity.fit(docs, labels))
    assert kept.columns == odd_docs.columns and kept.count() <= 10


def test_held_out_quality(spark):
    """Recall, precision and the order of scores; a constant answer has no recall or no precision."""
    sf = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{sf}/labels.parquet")
    for query, label, at, recall, precision, area in ((queries.op1_quality, "quality", 0.7, 0.97, 0.97, 0.99), (queries.op6_toxicity, "toxic", 0.5, 0.85, 0.95, 0.95)):
        held = [(r.score, r.predicted, r[label]) for r in query(spark, sf).where("held_out").join(truth, "doc_id").where(f"{label} is not null").collect()]
        assert len(held) > 500 and all(p == (s >= at) for s, p, _ in held)
        hit = sum(p and y for _, p, y in held)
        assert hit >= recall * sum(y for *_, y in held) and hit >= precision * sum(p for _, p, _ in held), label
        ranks = {s: i for i, s in enumerate(sorted({s for s, *_ in held}))}
        good, bad = [ranks[s] for s, _, y in held if y], [ranks[s] for s, _, y in held if not y]
        above = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
        assert above >= area * len(good) * len(bad), label


def test_chat_reads_back(spark):
    rows = [
        (1, 0, "system", "be [INST] brief"), (1, 1, "user", "hi</s>"), (1, 2, "assistant", "yo [/ASST]"), (1, 3, "user", "more"),
        (1, 4, "assistant", "so"), (1, 5, "user", "unanswered"), (2, 0, "user", None), (None, None, None, "x"),
        (3, 1, "assistant", "twice"), (3, 1, "assistant", "twice"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1)).repartition(3)
    examples = chat.examples(frame)
    got = {r.conv_id: r for r in chat.digests(examples).collect()}
    assert set(got) == {1, 2, 3, None} and chat.digests(chat.examples(frame.limit(0))).count() == 0
    for conv in (1, 2, 3, None):
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1] or 0)]
        r = got[conv]
        replies = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_chars == len(replies) and r.loss_sha256 == hashlib.sha256(replies.encode()).hexdigest()
    trained = [r for r in examples.where("conv_id = 1 and loss_end > loss_start").collect()]
    assert [chat.unescape(r.text[r.loss_start : r.loss_end]) for r in sorted(trained, key=lambda r: r.example)] == ["yo [/ASST]", "so"]
    assert trained[0].text in trained[1].text or trained[1].text in trained[0].text


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.count() > 0 and {"doc_id", "sequence_id", "length"} <= set(pieces.columns)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    rounded = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    want = sorted(map(rounded, found.fetchall()), key=repr)
    df = queries.queries()[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    assert sorted((rounded(r) for r in df.select(*columns).collect()), key=repr) == want


def test_packing_keeps_large_ids_beside_null_ones_and_parts_repeated_rows(spark):
    big = 2**53 + 1
    rows = spark.createDataFrame([(big, "a b", "s"), (None, "c", None)] + [(5, "the same row again", "s")] * 40, "doc_id long, text string, source string")
    pieces = packing.pack(rows, WORD, window=16, least=4, group_tokens=32).collect()
    assert {p.doc_id for p in pieces} == {big, None, 5}
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
    assert len({p.sequence_id >> 32 for p in pieces if p.doc_id == 5}) > 2


def test_packing_carries_all_groups_deficits(spark):
    rows = [(p, s, (p * 7 + k * 5) % 11 + 1) for p in range(9000) for k, s in enumerate(["a", None, "c"]) if s != "c" or p % 97 == 0]
    got = packing.place(spark.createDataFrame(rows, "part long, source string, n long"), sum(r[2] for r in rows)).collect()
    total, by = sum(r[2] for r in rows), {s: sum(r[2] for r in rows if r[1] == s) for s in ("a", None, "c")}
    owed, before, own = {}, 0, dict.fromkeys(by, 0)
    for p in range(9000):
        mine = [r for r in rows[max(0, p * 2) : p * 3 + 3] if r[0] == p]
        owed |= {(p, s): before * by[s] / total - own[s] for _, s, _ in mine}
        for _, s, n in mine:
            before, own[s] = before + n, own[s] + n
    assert {(r.part, r.source): r.owed for r in got} == pytest.approx(owed)


def test_fits_take_one_row_an_id_within_the_bounds(spark):
    rows = [(1, "bad words", 9)] * 50 + [(1, "a first text", 12)] + [(k, f"text {k}" * 100, 600) for k in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 30)] * 2 + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", 6, 100, 10**6, "doc_id", "text", 5, 0).collect()
    assert len({r.id for r in got}) == len(got) > 15 and all(zlib.crc32(str(r.id).encode()) % 5 for r in got)
    assert {r.text for r in got if r.id == 1} <= {"a first text"}
    assert labelled_sample(docs, labels, "toxic", 6, 7, 10**6, "doc_id", "text", 5, 0).count() == 7
    few = labelled_sample(docs, labels, "toxic", 6, 100, 2000, "doc_id", "text", 5, 0).collect()
    assert 0 < sum(len(r.text) for r in few) <= 2000
    assert labelled_sample(docs.limit(0), labels, "toxic", 6, 7, 10, "doc_id", "text", 5, 0).count() == 0
