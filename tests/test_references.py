"""Character references without a semicolon: the queries on pages read them as their SQL does."""

import duckdb
import pytest

import __spark_entry__ as entry

BODY = "Long enough a paragraph to be content, with a comma, and R&D and &copy 1 and &lt; &#39;x&#39; at AT&ampT"
HTML = f'<html><head><title>One &amp; two&amp</title></head><body><article><p>{BODY}</p></article></body></html>'


def both(spark, tmp_path, name):
    spark.createDataFrame([(1, "https://x.org/a", HTML)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = entry.queries()[name](spark, str(tmp_path))
    base = duckdb.connect()
    base.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = base.sql(entry.oracle_sql()[name])
    return [tuple(r[c] for c in want.columns) for r in got.collect()], want.fetchall()


@pytest.mark.parametrize("name", ["F44_page_titles", "F4_strip_html", "S10_web_pages"])
def test_as_sql(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name)
    assert got == want and "&amp" in str(got)
