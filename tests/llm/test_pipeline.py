from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
import check_oracles as C
import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n in entry_module.oracle_sql() if n.startswith("op")))
def test_query_matches_its_oracle(spark, name):
    state, rows, _, note = C.compare(spark, C.duck_connection(SF), name, entry_module.queries()[name], entry_module.oracle_sql()[name], SF)
    assert state == "ok" and rows, note


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        after = after.checkpoint() if spark.sparkContext.getCheckpointDir() else after
        assert after.columns == columns, name
        counts.append(after.count())
        docs = after
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[3] <= counts[2] and counts[4] == counts[3]
    ids = {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == ids


def test_every_operator_is_registered():
    names = [n for n in entry_module.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry_module.queries()
