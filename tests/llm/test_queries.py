"""The registered queries over whole tables: their columns, and those with SQL against it."""

import duckdb
import pytest

from weft.llm.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id n_assign n_access n_hex base_sha256 spans", "op2": "doc_id item_id", "op3": "page_id payload_bytes payload_digest record_type refers_to",
    "op4": "doc_id class_id", "op5": "doc_id start n_tokens ids_crc32", "op6": "doc_id held_out score predicted",
    "op7": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op8": "doc_id keep_id group_size kept text_sha256",
    "op9": "doc_id n_bytes n_removed n_spans kept_sha256", "op10": "doc_id piece start length ids_crc32 sequence_id offset",
}


def test_all_ten():
    assert [q.split("_")[0] for q in QUERIES] == list(COLUMNS) and SQL.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    got = QUERIES[name](spark, SF)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(got.columns)
    rows = got.collect()
    if name in SQL:
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "conversations"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        found = con.execute(SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted((tuple(r[n] for n in names) for r in rows), key=str) == sorted(found.fetchall(), key=str)
    elif "doc_id" in got.columns:
        ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
        assert {r.doc_id for r in rows} == ids
