"""The driver contract, and a few registered queries against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
SAMPLE = ("recall_hybrid", "bm25_join_filtered", "knn_join", "search_snippets", "chunk_text", "ingest", "apply_updates",
          "refresh_indexes", "retrieval_eval", "conversation_entries", "integrity_audit", "stream_ingest")


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) >= 110


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    status, *_, detail = compare(spark, connect(SF), SF, name, contract.queries()[name], contract.oracle_sql()[name])
    assert status == "match", detail


@needs_data
def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0
