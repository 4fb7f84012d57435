"""A few registered queries against their DuckDB oracle on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
NAMES = ["expected_publication", "heal_diff", "fold_cancel", "delta_file_chunks", "cascade_deletes", "gate_messages", "error_debounce",
         "stream_bad_message", "logical_delete_applied", "heal_delta_files"]  # the streams: test_stream.py


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(E.oracle_sql()[name])
    want = sorted(tuple(str(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall())
    assert sorted(rel.columns) == cols
    assert got == want


def test_entry_smoke(spark):
    rows = E.entry(spark).collect()
    assert {r.op for r in rows} == {"insert", "delete"}
