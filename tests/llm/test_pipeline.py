"""The pipeline's stages on a small table, and every query with SQL against it."""

import duckdb
import pytest

import corpus_pipeline
from folio.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    want = canonical([d[0] for d in found.description], found.fetchall())
    frame = QUERIES[name](spark, SF)
    assert canonical(frame.columns, [tuple(r) for r in frame.collect()]) == want


def test_one_query_each():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_stages(spark, odd, empty, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted = docs.limit(1).selectExpr("doc_id + 5000 AS doc_id", "concat(text, ' ') AS text", "lang", "source", "n_chars")
    changed = docs.orderBy("n_chars", ascending=False).limit(1).selectExpr("doc_id + 6000 AS doc_id", "concat('Anew ', text) AS text", "lang", "source", "n_chars")
    secret = docs.limit(1).selectExpr("7000L AS doc_id", "'a note with password=hunter2222 in it' AS text", "lang", "source", "n_chars")
    now = docs.unionByName(planted).unionByName(changed).unionByName(secret)
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, SF)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        seen[name] = {r["doc_id"] for r in now.select("doc_id").distinct().collect()}
    assert list(seen) == [n for n, _ in corpus_pipeline.STAGES]
    first = planted.first()["doc_id"]
    if first - 5000 in seen["exact_dedup"] or first in seen["toxicity"]:
        assert len({first, first - 5000} & seen["exact_dedup"]) == 1
    assert changed.first()["doc_id"] not in seen["simhash_near_dedup"]
    assert seen["secret_scan"] == seen["simhash_near_dedup"] == seen["best_fit_packing"]
    text = spark.read.parquet(f"{tmp_path}/3").where("doc_id = 7000").first()
    assert text is None or text["text"] == "a note with [SECRET] in it"


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    for frame in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            n = out.count()
            assert (n == 0) == (frame is empty)
            if name == "secret_scan":
                assert n == odd.count() if frame is odd else n == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert set(rows.columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and rows.count() > 100


def test_secrets_sql_on_odd_rows(spark, odd):
    """Rows that the tables lack: random strings beside and inside of base spans."""
    import pyarrow as pa

    from folio.llm import secrets

    from .conftest import odd_rows

    rng_rows = [(100 + i, f"x {t} y") for i, t in enumerate(["Zk9vQ2hXw7LrT4pB8sNd1", "key=Zk9vQ2hXw7LrT4pB8sNd1fG6jM3cY5eA0uI", "secret: Zk9vQ2hXw7LrT4pB8sNd1fG6jM3cY5eA0uI", "RandomButStillReadableIdentifier9", "QWERTYUIOP234567ASDFGHJKLZXCVBNM2"])]
    rows = [(i, t) for i, t, *_ in odd_rows()] + rng_rows
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}))
    found = con.execute(ORACLE_SQL["op5_secret_scan"])
    want = canonical([d[0] for d in found.description], found.fetchall())
    frame = secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    assert canonical(frame.columns, [tuple(r) for r in frame.collect()]) == want
    assert frame.where("n_random > 0").count() >= 2
