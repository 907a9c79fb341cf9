"""Trigrams in Arrow batches, and the join of patterns to them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from anamnesis.functions.text import trigrams
from anamnesis.operators import kernels
from anamnesis.operators import search as S

TEXTS = [("a", "The rose, the Stone"), ("b", "x😀yz 中é ÀA"), ("c", "ab"), ("d", ""), ("e", None), (None, "the rose"),
         ("f", "the rose and the river"), ("f", "stone"), ("g", "rose " * 400)]
PATTERNS = [("p", "the rose"), ("q", "rose"), ("r", "😀yz"), ("s", "ab"), ("t", "nowhere"), (None, "rose"), ("u", None),
            ("v", "rose"), ("v", "stone")]


def tables(spark):
    return (spark.createDataFrame(TEXTS, "memory_id string, text string"),
            spark.createDataFrame(PATTERNS, "pattern_id string, pattern string"))


def rows(df):
    return sorted(map(repr, df.collect()))


def test_trigram_index_equals_the_column_expression(spark):
    memories, _ = tables(spark)
    assert rows(S.trigram_index(memories)) == rows(memories.select(F.explode(trigrams("text")).alias("trigram"), "memory_id"))


@pytest.mark.parametrize("pairs", [1, 1 << 19])
def test_trigram_join_makes_no_row_per_pattern_and_trigram(spark, monkeypatch, pairs):
    monkeypatch.setattr(kernels, "PAIRS", pairs)
    memories, patterns = tables(spark)
    index = S.trigram_index(memories)
    wanted = patterns.select("pattern_id", F.explode(trigrams("pattern")).alias("trigram"))
    needed = wanted.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("needed"))
    plain = index.join(wanted, "trigram").groupBy("pattern_id", "memory_id").agg(F.count(F.lit(1)).alias("held")).join(
        needed, "pattern_id").where("held = needed").select("pattern_id", "memory_id")
    found = S.trigram_join(patterns, index)
    assert rows(found) == rows(plain) and found.count() > 3
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in line and "pattern_id" in line for line in plan.splitlines())
    assert "Aggregate" not in plan


def test_an_id_meets_its_patterns_whole_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        memories, patterns = tables(spark)
        few = {tuple(r) for r in S.trigram_join(patterns, S.trigram_index(memories)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8192")
    assert {("p", "a"), ("p", "f"), ("q", "g"), ("r", "b"), ("p", None)} <= few


def test_term_lists_hold_places_and_not_ids(spark, tmp_path, monkeypatch):
    import anamnesis.stored_index as I
    from anamnesis.operators.bm25 import build_postings, chunk_terms

    monkeypatch.setattr(I, "BLOCK_ROWS", 3)
    chunks = spark.createDataFrame(
        [(i, n, t) for n, (i, t) in enumerate(TEXTS)] + [("a", 0, "the rose again the rose")], "memory_id string, chunk_index int, text string")
    index = I.StoredIndex(spark, f"{tmp_path}/index")
    index.build(chunks, chunks.select("memory_id", "text"))
    lists = index._rows("terms")
    assert "memory_id" not in lists.columns and lists.select("block").distinct().count() > 1
    fields = ["term", "memory_id", "chunk_index", "tf", "doc_len"]
    assert rows(index.live("terms").select(*fields)) == rows(build_postings(chunk_terms(chunks)).select(*fields))


def test_texts_are_embedded_in_pieces_of_bounded_bytes(spark, monkeypatch):
    import numpy as np

    from anamnesis.operators import embedding as E

    class Counting:
        name, dimensions, max_texts, max_chars = "counting", 1, 1024, None

        def load(self):
            return lambda texts: np.full((len(texts), 1), len(texts))

    monkeypatch.setattr(E, "PIECE_BYTES", 40)
    texts = spark.createDataFrame([(i, "0123456789") for i in range(30)], "n int, text string").coalesce(1)
    assert {r.vector[0] for r in E.embed_column(texts, Counting()).collect()} == {4.0, 2.0}


def test_known_rows_are_left_out_without_a_move_of_wide_rows(spark):
    from anamnesis.operators.sizing import without_known

    wide = spark.createDataFrame([(f"i{n}" if n else None, "x" * n) for n in range(12)], "memory_id string, text string")
    ids = spark.createDataFrame([("i1",), ("i3",), ("i3",), ("i7",), ("none",)], "memory_id string")
    left = without_known(wide, ids, max_rows=2)
    assert rows(left) == rows(wide.join(ids, "memory_id", "left_anti")) and left.count() == 9
    assert "hashpartitioning" not in left._jdf.queryExecution().executedPlan().toString()
    assert rows(without_known(wide, ids, max_rows=1, most_blocks=2)) == rows(left)
