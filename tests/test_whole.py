"""Queries that cover every row, against their SQL and against the rows that a cut leaves out."""

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
WHOLE = ["J8_absent_hashes_all", "K16_cascade_all", "K4_briefing_upsert_all", "P22_repo_keywords_whole", "P9_hashes_in_window_all"]


@pytest.mark.parametrize("name", WHOLE)
def test_whole_queries_equal_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "events", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    df = __spark_entry__.queries()[name](spark, SF)
    plain = lambda rows: sorted((tuple(str(x) for x in r) for r in rows))
    assert plain(df.select(*columns).collect()) == plain(found.fetchall())


def test_every_event_is_counted(spark):
    days = __spark_entry__.queries()["K4_briefing_upsert_all"](spark, SF).collect()
    assert sum(r.total_items for r in days) == spark.read.parquet(f"{SF}/events.parquet").count()
