"""Queries whose cuts were removed, on keys that are missing, empty or repeated, against their SQL."""

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["K16_cascade", "P9_hashes_in_window"])
def test_equal_duckdb_on_odd_keys(spark, tmp_path, name):
    con = duckdb.connect()
    for t, rows in {
        "documents": f"SELECT * FROM '{SF}/documents.parquet' WHERE doc_id % 4 <> 1", "events": f"SELECT * FROM '{SF}/events.parquet'",
        "embeddings": f"SELECT * REPLACE (CASE WHEN vec_id % 50 <> 7 THEN vec_id END AS vec_id) FROM '{SF}/embeddings.parquet' UNION ALL SELECT * FROM '{SF}/embeddings.parquet' WHERE vec_id < 20",
        "pages": f"SELECT * REPLACE (CASE page_id % 9 WHEN 3 THEN '' WHEN 2 THEN NULL ELSE url END AS url) FROM '{SF}/pages.parquet'",
    }.items():
        con.execute(f"COPY ({rows}) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    wanted = sorted(r[0] for r in con.execute(__spark_entry__.oracle_sql()[name]).fetchall())
    assert wanted and sorted(r[0] for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()) == wanted
