"""Landed payloads of each source as raw items."""

import json

import pytest
from pyspark.sql import functions as F

from newsweave.sources import payloads as P


def landed(spark, *docs):
    return spark.createDataFrame([(k, d if isinstance(d, str) else json.dumps(d)) for k, d in enumerate(docs)], "ord long, payload string")


def now():
    return F.lit("2025-06-15 12:00:00").cast("timestamp")


def titles(df):
    return [r.title for r in df.collect()]


HITS = [
    {"objectID": "1", "title": "A &amp; B", "url": "https://openai.com/x", "author": "u", "points": 50, "num_comments": 3, "created_at_i": 1_700_000_000},
    {"objectID": "2", "title": "ten", "url": None, "author": "u", "points": 10, "created_at_i": 1_700_000_000},
    {"objectID": "3", "title": "self", "url": "", "author": "u", "points": 90, "created_at_i": 1_700_000_000},
    {"objectID": "4", "title": "sub", "url": "https://blog.mistral.ai/y", "author": "u", "points": 0, "created_at_i": 1_700_000_000},
    {"objectID": "5", "title": "fake", "url": "https://notopenai.com/", "author": "u", "points": 0, "created_at_i": 1_700_000_000},
]


def test_hackernews(spark):
    pages = landed(spark, {"hits": HITS}, {"hits": [{**HITS[0], "title": "again"}]})
    got = P.hackernews(pages).collect()
    assert [r.title for r in got] == ["self", "A & B"]  # 10 points aren't above 10; first of a story wins
    assert got[0].url == "https://news.ycombinator.com/item?id=3" and got[0].source == "hackernews"
    lead = P.hackernews_leading(pages).collect()
    assert [r.title for r in lead] == ["A & B", "sub"] and json.loads(lead[1].metadata)["lane"] == "leading"
    assert P.hackernews(pages, since=1_700_000_000).count() == 0


RSS = """<rss><channel>
<item><title>New - Pub</title><link>https://a.com/1</link><description>&lt;p&gt;Text&lt;/p&gt;</description><pubDate>Sun, 15 Jun 2025 10:00:00 GMT</pubDate><source url="x">Pub</source><category>ai</category></item>
<item><title>Old</title><link>https://a.com/2</link><pubDate>Sun, 01 Jun 2025 10:00:00 GMT</pubDate></item>
<item><title>Undated</title><link>https://a.com/3</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Atom</title><link href="https://a.com/1"/><updated>2025-06-15T11:00:00Z</updated><author><name>N</name></author></entry>
<entry><title>Other</title><link href="https://b.com/1"/><published>2025-06-15T11:30:00Z</published><author><name>N</name></author><author><name>M</name></author></entry></feed>"""


def test_rss(spark):
    got = P.rss(landed(spark, RSS, ATOM, "not xml <"), F.lit("2025-06-13").cast("timestamp")).collect()
    assert [r.title for r in got] == ["Other", "New", "Undated"]  # newest first, undated kept, first of a link wins
    assert got[0].author == "N, M" and got[1].text == "Text"


ARXIV = """<rss><channel>
<item><title>Deep agents</title><link>https://arxiv.org/abs/2501.00001v2</link><description>Announce Type: new
Abstract: about LLMs</description></item>
<item><title>Deep agents v1</title><link>https://arxiv.org/abs/2501.00001v1</link><description>no marker LLM</description></item>
<item><title>Replaced LLM</title><link>https://arxiv.org/abs/2501.00002</link><description>Announce Type: replace</description></item>
<item><title>Botany</title><link>https://arxiv.org/abs/2501.00003</link><description>Announce Type: new plants</description></item></channel></rss>"""


def test_arxiv(spark):
    got = P.arxiv(landed(spark, ARXIV), ("LLM", "C++")).collect()
    assert titles(P.arxiv(landed(spark, ARXIV), ("LLM", "C++"))) == ["Deep agents"]
    meta = json.loads(got[0].metadata)
    assert meta["arxiv_id"] == "2501.00001" and meta["pdf_url"].startswith("https://arxiv.org/pdf/") and got[0].author == "unknown" and got[0].score == 0


def test_reddit(spark):
    post = lambda **x: {"data": {"title": "t", "url": "https://l.com", "permalink": "/r/x/1", "is_self": False, "stickied": False, "score": 1, "created_utc": 1.7e9, **x}}
    page = {"data": {"children": [post(id="a", score=5), post(id="b", stickied=True), post(id="c", is_self=True, selftext="body", score=9), post(id="a", score=99), post(id=None)]}}
    got = P.reddit(landed(spark, page)).collect()
    assert [(r.url, r.text) for r in got] == [("https://www.reddit.com/r/x/1", "body"), ("https://l.com", "t")]


TRENDING = "".join(
    f'<article class="Box-row"><h2 class="h3"><a href="/{n}">x</a></h2><p class="col">{d}</p><span itemprop="programmingLanguage">Python</span><a href="/{n}/stargazers" class="m">svg {s}</a> <span>{t} stars today</span></article>'
    for n, d, s, t in (("o/agent", "An LLM &amp; agent", "1,234", "56"), ("o/game", "A chess game", "9", "1"))
)


def test_github(spark):
    got = P.github_trending(landed(spark, "<html>" + TRENDING), now()).collect()
    assert len(got) == 1 and got[0].title == "o/agent: An LLM & agent" and got[0].score == 1234 and json.loads(got[0].metadata)["stars_today"] == 56
    repo = lambda **x: {"full_name": "o/r", "html_url": "https://g/o/r", "description": None, "stargazers_count": 500, "created_at": "2025-05-01T00:00:00Z", "pushed_at": "2025-06-01T00:00:00Z", "owner": {"login": "o"}, **x}
    page = {"items": [repo(), repo(html_url="https://g/old", created_at="2020-01-01T00:00:00Z"), repo(html_url="https://g/few", stargazers_count=200), repo(html_url="https://g/no", created_at=None)]}
    assert sorted(r.url for r in P.github_search(landed(spark, page), now()).collect()) == ["https://g/no", "https://g/o/r"]


def test_huggingface(spark):
    model = lambda i, **x: {"id": i, "pipeline_tag": "text", "library_name": "lib", "downloads": 500, "tags": [], "lastModified": "2025-06-14T00:00:00Z", **x}
    page = [model("a/b"), model("a/q", tags=["base_model:quantized:x"]), model("a/n", library_name=None), model("a/f", downloads=99), model("a/o", lastModified="2020-01-01T00:00:00Z"), model("a/u", lastModified=None)]
    got = P.huggingface_models(landed(spark, page), F.lit("2025-06-13").cast("timestamp")).collect()
    assert [r.title for r in got] == ["a/b", "a/u"] and got[0].text == "a/b | Task: text | Library: lib"
    papers = [{"paper": {"id": "2501.1", "title": "P", "upvotes": 4, "publishedAt": "2025-06-14T00:00:00Z"}}, {"paper": {"id": None, "title": "x"}}]
    abstracts = spark.createDataFrame([("2501.1v2", "abs")], "arxiv_id string, abstract string")
    r = P.huggingface_papers(landed(spark, papers), abstracts).collect()
    assert len(r) == 1 and r[0].text == "P\nabs" and r[0].score == 4


def test_web_pages_and_links(spark):
    html = '<html><title>T</title><script>x</script><body><a href="/2025/story">s</a><a href="/2025/story?a=1">dup</a><a href="#x">n</a><a href="mailto:a@b">m</a><a href="/about/us">u</a><p>Body text</p></body></html>'
    pages = spark.createDataFrame([("https://e.com/ai/", html), ("https://e.com/empty", "<p></p>")], "url string, html string")
    assert [r.href for r in P.page_links(pages).collect()] == ["https://e.com/2025/story"]
    r = P.web_pages(pages).collect()
    assert len(r) == 1 and r[0].title == "T" and "Body text" in r[0].text and json.loads(r[0].metadata)["domain"] == "e.com"


def test_union_of_sources_keeps_enabled_order(spark):
    pages = landed(spark, {"hits": HITS})
    found = {"hackernews": P.hackernews(pages), "hackernews_leading": P.hackernews_leading(pages)}
    got = P.union_sources(found, ["hackernews_leading", "hackernews"])
    assert {(r.source_ord, r.title) for r in got.collect()} >= {(0, "sub"), (1, "self")}
    assert P.union_sources(found, ["hackernews_leading", "hackernews"], ["hackernews"]).select("source_ord").distinct().count() == 1
    with pytest.raises(ValueError):
        P.union_sources(found, ["hackernews"], ["rss"])
    with pytest.raises(KeyError):
        P.REGISTRY["unknown"]


def test_raw_json_and_months(spark):
    raw = spark.createDataFrame([("hackernews", '{"title":"t","objectID":"7","points":5}'), ("github", '{"full_name":"a/b","stargazers_count":500}'), ("huggingface", '{"id":"x/y","downloads":3}')], "source string, raw_json string").withColumn("extracted_at", now())
    got = {r.source: r for r in P.raw_to_items(raw).collect()}
    assert got["hackernews"].url.endswith("id=7") and got["github"].score == 500 and got["huggingface"].url == "https://huggingface.co/x/y"
    assert [r.month for r in P.month_ranges(spark, "2024-11", "2025-02").collect()] == ["2024-11", "2024-12", "2025-01", "2025-02"]
