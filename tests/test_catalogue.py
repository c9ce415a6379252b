"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from folio.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "conversations", "pages", "labels")


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(catalogue.ORACLE_SQL[name])
    want = canonical([d[0] for d in found.description], found.fetchall())
    frame = catalogue.QUERIES[name](spark, SF)
    assert canonical(frame.columns, [tuple(r) for r in frame.collect()]) == want


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 200 and {r["status"] for r in rows} >= {"ok", "skipped", "registered"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
