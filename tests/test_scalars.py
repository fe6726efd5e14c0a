"""Golden values of the scalar functions."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsweave.functions import scalars as S
from newsweave.functions import udfs

def now():
    return F.lit("2025-06-15 12:00:00").cast("timestamp_ntz")


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


def test_hashes(spark):
    r = one(spark, a=S.content_hash(F.lit("A"), F.lit("http://a")), b=S.content_hash(F.lit("A"), F.lit(None).cast("string")), c=S.url_hash(F.lit("")), d=S.url_hash(F.lit("u")))
    assert r.a == hashlib.sha256(b"A|http://a").hexdigest()[:16] and r.b == hashlib.sha256(b"A|").hexdigest()[:16]
    assert r.c is None and len(r.d) == 16


@pytest.mark.parametrize("title, name", [
    ("TheBloke/Llama-2-7B-GGUF", "llama-2"), ("bartowski/Mistral-7B-GPTQ", "mistral"), ("mistralai/Mistral-7B-v0.1", "mistral-v0.1"),
    ("google/gemma-2b", "gemma"), ("Qwen/Qwen3.5-397B-A17B", "qwen3.5"), ("meta-llama/Llama-3-70B", "llama-3"), ("plain", None),
])
def test_model_names(spark, title, name):
    assert one(spark, n=S.model_name(F.lit(title))).n == name


def naive_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            row[j + 1], left = (left + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcé ", max_size=30), st.text("abcé ", max_size=30))
def test_common_length_equals_the_table(a, b):
    assert udfs.common_length(a, b) == naive_lcs(a, b)


def test_similarity_goldens():
    assert udfs.similarity("GPT-5 Released", "gpt-5 released") == 1.0
    assert round(udfs.similarity("GPT-5 Released by OpenAI", "OpenAI Releases GPT-5"), 4) == 0.4889
    assert udfs.similarity("GPT-5 Released", "EU AI Act Regulation Update") == 0.0 and udfs.similarity("", "a") == 0.0


def test_keyword_classes(spark):
    rows = spark.createDataFrame([
        (1, "GPT-5 LLM achieves SOTA on MMLU benchmark with transformer architecture", None), (2, "Best pizza recipe for dinner tonight", None), (3, "New GPT model release", None),
    ], "id int, title string, full_text string")
    got = {r.id: r for r in S.with_keyword_class(rows).withColumn("gate", S.gate(F.col("matches"))).collect()}
    assert got[1].topic == "models" and got[1].matches == 7 and abs(got[1].relevance - 21 / 26) < 1e-12 and got[1].gate == "accept"
    assert got[2].topic is None and got[2].gate == "reject"
    assert got[3].topic == "models" and got[3].matches == 2 and got[3].gate == "ambiguous"


def test_composite_golden_and_edges(spark):
    rows = spark.createDataFrame([
        (1, "arxiv", "papers", 0.9, None, "2025-06-15 12:00:00"), (2, "webscraper", "models", 0.9, 0, None), (3, "hackernews", None, 0.7, 100, "2025-06-15 11:59:00"),
        (4, "reddit", "models", 1.0, 5, "2025-06-16 12:00:00"),
    ], "id int, source string, topic string, relevance_score double, score int, published_at string").withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))
    got = {r.id: r for r in rows.select("id", S.composite(now()).alias("c"), S.velocity(now()).alias("v")).collect()}
    assert abs(got[1].c - 0.745) < 1e-9 and got[1].v is None
    assert got[2].v == 0.0  # a source that isn't listed as without engagement has velocity 0
    assert got[3].v == 100.0  # the age is at least an hour
    assert got[4].c > 1.0  # a future time decays upwards


def test_credibility_parts(spark):
    rows = spark.createDataFrame([
        (1, "arxiv", "https://www.arxiv.org/abs/1", "A research paper", "x", 600), (2, "other", "https://notarxiv.org/", "SHOCKING!! miracle", None, None),
    ], "id int, source string, url string, title string, full_text string, score int")
    got = {r.id: r for r in rows.select("id", S.credibility().alias("c"), S.tone().alias("t"), S.engagement().alias("e")).collect()}
    assert abs(got[1].c - (0.3 + 0.3 + 0.2 + 0.1)) < 1e-9 and got[1].e == 1.0
    assert got[2].c == 0.0 and abs(got[2].t + 0.4) < 1e-9 and got[2].e == 0.1


def test_text_helpers(spark):
    r = one(
        spark, a=udfs.strip_html(F.lit("<p>a&amp;b</p>  <b>c</b> ")), b=S.word_count(F.lit("  a b\tc ")), c=S.thousands(F.lit("1,234")),
        d=S.arxiv_id(F.lit("https://arxiv.org/abs/2401.00001v3?x")), e=S.pdf_url(F.lit("http://x/abs/1")), f=S.trim_publisher(F.lit("Stitch - blog.google"), F.lit("blog.google")),
        g=S.compose_title(F.lit("n"), F.lit("")), h=S.host(F.lit("https://Sub.Example.com:80/x")), i=S.jaccard(F.array(F.lit("a")), F.array().cast("array<string>")),
        j=S.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0))), k=S.prepare_text(F.lit("t"), F.lit("")), l=S.strip_tags(F.lit("<i>x</i>  y")),
        m=S.parse_iso(F.lit("2024-01-02T03:04:05Z")), n=S.parse_iso(F.lit("junk")),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i, r.j, r.k, r.l) == ("a&b c", 3, 1234, "2401.00001", "http://x/pdf/1", "Stitch", "n", "sub.example.com", 0.0, None, "t", "x y")
    assert str(r.m) == "2024-01-02 03:04:05" and r.n is None


@pytest.mark.parametrize("url, safe", [("https://example.com/x", True), ("http://127.0.0.1/", False), ("http://[::1]/", False), ("ftp://example.com", False), ("http://10.0.0.8/", False), ("http://8.8.8.8/", True), ("nonsense", False)])
def test_safe_urls(spark, url, safe):
    assert one(spark, s=udfs.safe_url(F.lit(url))).s is safe
