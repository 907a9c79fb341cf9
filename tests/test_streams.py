"""Streams read a table that is a folder of files as well as one that is a file."""

from __future__ import annotations

import pytest

from workload.streams import conversation_stream, stream_dedup_all


@pytest.mark.parametrize("parts", [1, 3])
def test_conversations_in_a_folder_are_streamed(spark, tmp_path, parts):
    rows = [(c, t, "user", f"text {c} {t}") for c in range(4) for t in range(2)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(parts) \
        .write.parquet(f"{tmp_path}/conversations.parquet")
    assert conversation_stream(spark, str(tmp_path)).isStreaming
    assert stream_dedup_all(spark, str(tmp_path)).distinct().count() == len(rows)
