"""Feeds are read a few documents at a time, not by Arrow batches of thousands of whole ones."""

import datetime

from newsweave.sources import payloads

FEED = "<rss><channel>{}</channel></rss>"
ITEM = "<item><title>T{k}</title><link>https://x.org/{k}</link><pubDate>{when}</pubDate><category>c</category></item>"


def test_entries_in_small_batches(spark):
    when = ("Mon, 06 Jan 2025 01:02:03 +0200", "Thu, 01 Jan 1500 00:00:00 GMT", "never")
    rows = [(7, FEED.format("".join(ITEM.format(k=k, when=w) for k, w in enumerate(when)))), (8, "<rss"), (9, None)]
    df = payloads.feed_entries(spark.createDataFrame(rows, "ord long, payload string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "InPandas" not in plan and "Arrow" not in plan
    got = df.selectExpr("ord", "title", "link", "unix_micros(published) AS us", "tags").collect()
    utc = datetime.timezone.utc
    first = datetime.datetime(2025, 1, 5, 23, 2, 3, tzinfo=utc), datetime.datetime(1500, 1, 1, tzinfo=utc)
    epoch = datetime.datetime(1970, 1, 1, tzinfo=utc)
    want = [(t - epoch) // datetime.timedelta(microseconds=1) for t in first]
    assert [(r.ord, r.title, r.link, r.us, r.tags) for r in got] == [(700_000 + k, f"T{k}", f"https://x.org/{k}", u, ["c"]) for k, u in enumerate([*want, None])]
