"""The pipeline's rows against a plain version of its stages; odd and empty tables through run()."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from test_near_copies import classes_of

from newsweave.llm import secret_scan, toxicity

SF = "/root/testdata/sf0.001"


def filled(sizes, weights, budget, epochs):
    """Targets by clamping again and again; sizes by source, in order."""
    target, total, clamped = {}, budget * sum(sizes.values()), set()
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    while True:
        rest = total - sum(epochs * sizes[s] for s in clamped)
        level = rest / sum(weight[s] for s in sizes if s not in clamped) if len(clamped) < len(sizes) else 0
        target = {s: epochs * sizes[s] if s in clamped else level * weight[s] for s in sizes}
        over = {s for s in sizes if target[s] > epochs * sizes[s] and s not in clamped}
        if not over:
            return target
        clamped |= over


def mixed(docs):
    """How often each (doc_id, text, source) stays; texts may be null."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) for d in docs}
    place = {d: int(hashlib.md5(f"17:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:15], 16) for d in docs}
    by_source = defaultdict(int)
    for d, n in docs.items():
        by_source[d[2]] += n * size[d]
    ordered = {s: by_source[s] for s in sorted(by_source, key=lambda s: (s is None, s or ""))}
    out = {}
    for s, target in filled(ordered, (3, 1, 2), 1.5, 2.0).items():
        own = sorted((place[d], d) for d in docs if d[2] == s)
        whole = int(target // by_source[s]) if by_source[s] else 0
        rest, upto = target - whole * by_source[s], 0
        for h in sorted({h for h, _ in own}):
            tied = [d for g, d in own if g == h]
            words = sum(size[d] * docs[d] for d in tied)
            more = upto + words <= rest or upto <= rest < upto + words and 2 * int(rest - upto) >= words
            if upto > rest:
                more = False
            for d in tied:
                out[d] = (whole + more) * docs[d]
            upto += words
    return {d: n for d, n in out.items() if n}


def test_pipeline_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = sorted(r.doc_id for r in toxicity.score(docs, model).collect() if not r.predicted)
    classes = classes_of([rows[d].text or "" for d in clean])
    kept = sorted({clean[i] for i in classes})
    words = secret_scan.dictionary()
    hidden = Counter((d, secret_scan.redacted(rows[d].text or "", words=words), rows[d].source) for d in kept)
    wanted = mixed(hidden)
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d[0]: [*encoder.encode(d[1], add_special_tokens=False).ids, 1] for d in wanted}
    copies = {d[0]: n for d, n in wanted.items()}

    pieces = corpus_pipeline.run(spark, SF).collect()
    tokens, starts = Counter(), defaultdict(Counter)
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(b"".join(t.to_bytes(4, "little") for t in part)) and p.doc_tokens == len(ids[p.doc_id])
        tokens[p.doc_id] += p.length
        starts[p.doc_id][p.start] += 1
    assert tokens == {d: n * len(ids[d]) for d, n in copies.items()}
    assert all(starts[d][0] == n for d, n in copies.items())
    taken = defaultdict(list)
    for p in pieces:
        taken[p.sequence_id].append((p.offset, p.length))
    for parts in taken.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and sum(parts[-1]) <= 2048


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_tables_pass_through_all_stages(spark, tmp_path, odd_docs, labelled):
    folder = str(tmp_path)
    odd = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    odd.write.parquet(f"{folder}/documents.parquet")
    truth = [(4, 1, 0), (5, 1, 0), (99, 0, 1), (None, 1, 1), (6, None, None)] if labelled else []
    spark.createDataFrame(truth, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} <= {1, 4, 5, 6, 8, None} and len({p.doc_id for p in pieces}) >= 4


def test_empty_tables_give_no_rows(spark, tmp_path, no_docs):
    folder = str(tmp_path)
    no_docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
