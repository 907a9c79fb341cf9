"""The index beside the store: kept by every change, read by partition, equal to a rebuild."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from test_write_and_store import uid
from pyspark.sql import functions as F

from anamnesis.operators.bm25 import bm25_join, build_postings, chunk_terms, corpus_stats, term_stats
from anamnesis.operators.embedding import HashedEmbedder, embed_distinct
from anamnesis.operators.search import trigram_index, trigram_join
from anamnesis.plans.recall import recall_hybrid
from anamnesis.plans.search import search
from anamnesis.plans.write import delete_batch, ingest, reconcile, update_batch
from anamnesis.store import Store
from anamnesis.stored_index import rarest_first

EMB = HashedEmbedder()
TURNS = ("source string, conversation_id string, memory_id string, parent_id string, turn_index int, text string, "
         "created_at timestamp, tags array<string>")
WORDS = "alpha beta gamma delta omega the the the of of in rose stone river cloud amber é中x".split()


def sentence(rng, n=12):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + f" w{rng.randrange(40)}"


def turns(spark, numbers, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame(
        [("x", uid(900 + i % 3), uid(i), None, i, sentence(rng, 12 if i % 7 else 700), dt.datetime(2024, 1, 1), ["a"])
         for i in numbers], TURNS)


def now():
    return F.to_timestamp(F.lit("2025-01-01T00:00:00Z"))


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, str(tmp_path / "store"), buckets=3)
    made.apply(ingest(turns(spark, range(30)), made.read("memories"), now()))
    made.build_index()
    return made


QUERIES = [("q1", "rose stone w3"), ("q2", "the of in"), ("q3", "nowhere at all"), ("q4", "changed words w11 amber"), ("q5", "")]
PATTERNS = [("p1", "rose stone"), ("p2", "the the"), ("p3", "zzz"), ("p4", "changed"), ("p5", "é中x"), ("p6", "w1"),
            ("p7", "Amber of")]


def hits(df):
    return sorted(tuple(r) for r in df.select("query_id", "memory_id", "chunk_index", "score", "rank").collect())


def assert_equals_rebuild(spark, store, answers=False):
    """Lists and counts equal those of a rebuild; with `answers`, so do recall and search through them."""
    index, chunks, memories = store.index(), store.read("chunks"), store.read("memories")
    postings = build_postings(chunk_terms(chunks))
    held = index.live("terms").select("term", "memory_id", "chunk_index", "tf", "doc_len")
    assert sorted(map(tuple, held.collect())) == \
        sorted(map(tuple, postings.select("term", "memory_id", "chunk_index", "tf", "doc_len").collect()))
    assert sorted(map(tuple, index.live("trigrams").select("trigram", "memory_id").collect())) == \
        sorted(map(tuple, trigram_index(memories).select("trigram", "memory_id").collect()))
    terms = term_stats(postings)
    assert sorted(map(tuple, index.counts(terms.select("term"), "term").collect())) == sorted(map(tuple, terms.collect()))
    want = corpus_stats(chunk_terms(chunks)).select("n_docs", "total_len").first()
    assert tuple(index.corpus().select("n_docs", "total_len").first()) == tuple(want)
    if not answers:
        return
    queries = spark.createDataFrame(QUERIES, "query_id string, query_text string")
    assert hits(index.bm25(queries, 7)) == hits(bm25_join(queries, chunks, 7))
    allowed = memories.where("conversation_id = '%s'" % uid(901)).select("memory_id")
    assert hits(index.bm25(queries, 4, allowed)) == hits(bm25_join(queries, chunks, 4, allowed))
    patterns = spark.createDataFrame(PATTERNS, "pattern_id string, pattern string")
    found = {tuple(r) for r in index.candidates(patterns).collect()}
    assert found >= {tuple(r) for r in trigram_join(patterns, trigram_index(memories)).collect()}
    through, scan = search(patterns, memories, searcher="trigram", index=index), search(patterns, memories)
    for a, b in zip(through, scan):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def change_all(spark, store):
    """Import, update, delete and reconcile, one after another."""
    store.apply(ingest(turns(spark, range(20, 40), 2), store.read("memories"), now()))
    rows = store.read("memories").where(F.col("memory_id").isin([uid(i) for i in (1, 2, 7, 33)]))
    updates = rows.select("memory_id", F.lit("changed words " * 3 + "w11").alias("text"), F.lit(None).cast("array<string>").alias("tags"),
                          "etag", F.monotonically_increasing_id().alias("update_order"))
    store.apply(update_batch(updates, store.read("memories"), now()))
    ids = spark.createDataFrame([(uid(i),) for i in (0, 7, 14, 77)], "memory_id string")
    store.apply(delete_batch(ids, store.read("memories"), store.read("chunks")))


def test_index_follows_every_change(spark, store):
    change_all(spark, store)
    assert_equals_rebuild(spark, store, answers=True)
    again = store.read("memories").where(F.col("memory_id") == uid(0))
    assert again.isEmpty()
    store.apply(ingest(turns(spark, [0, 7], 5), store.read("memories"), now()))  # ids that went come back
    store.index().compact()
    assert len(store.index().log()) == 1
    assert_equals_rebuild(spark, store)
    kept = store.read("memories").where(F.col("memory_id") > uid(10))
    chunks = store.read("chunks").join(kept.select("memory_id"), "memory_id", "left_semi")
    store.apply(reconcile(kept, chunks, store.read("memories")))
    store.index().compact_if_due(after=1)
    assert_equals_rebuild(spark, store)


def test_recall_through_the_index(spark, store):
    queries = spark.createDataFrame(QUERIES[:4], "query_id string, query_text string")
    memories = store.read("memories")
    chunks = embed_distinct(store.read("chunks").drop("vector"), EMB)
    through = recall_hybrid(queries, memories, chunks, 5, embedder=EMB, index=store.index())
    scan = recall_hybrid(queries, memories, chunks, 5, embedder=EMB)
    assert through.count() and sorted(map(tuple, through.collect()), key=repr) == sorted(map(tuple, scan.collect()), key=repr)


def test_an_interrupted_change_is_carried_out_once(spark, store, monkeypatch):
    before = store.read("memories").count()
    gone = spark.createDataFrame([(uid(3),), (uid(4),)], "memory_id string")

    def stop(*_):
        raise RuntimeError("lost")

    for name in ("_carry_out", "_write"):  # before and while the tables follow
        monkeypatch.setattr(Store, name, stop)
        with pytest.raises(RuntimeError):
            store.apply(delete_batch(gone, store.read("memories"), store.read("chunks")))
        monkeypatch.undo()
        store.recover()
        assert store.read("memories").where(F.col("memory_id").isin(uid(3), uid(4))).isEmpty()
        assert store.read("memories").count() == before - 2
        gone, before = spark.createDataFrame([(uid(5),), (uid(6),)], "memory_id string"), before - 2
    monkeypatch.setattr(Store, "_drop", stop)  # the tables have followed, the note is still there
    with pytest.raises(RuntimeError):
        store.apply(ingest(turns(spark, range(50, 60)), store.read("memories"), now()))
    monkeypatch.undo()
    store.recover()
    store.recover()
    assert store.read("memories").count() == before + 10
    assert store.read("chunks").groupBy("memory_id", "chunk_index").count().where("count > 1").isEmpty()
    assert_equals_rebuild(spark, store)


def test_only_partitions_of_asked_terms_are_read(spark, store, monkeypatch):
    import anamnesis.stored_index as module

    monkeypatch.setattr(module, "SMALL_CHANGE_BYTES", 0)
    store.index().compact()
    index = store.index()
    asked = spark.createDataFrame([("rose",)], "term string")
    parts = index._parts_of(asked, "term")
    assert len(parts) == 1
    rows = index.live("terms", parts)
    assert 0 < len(rows.inputFiles()) and rows.where("term = 'rose'").count() == index.live("terms").where("term = 'rose'").count()
    plan = rows.where("term = 'rose'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part" in plan.split("PartitionFilters")[1][:80] and "EqualTo(term,rose)" in plan
    assert rows.select(F.input_file_name()).distinct().count() < index.live("terms").select(F.input_file_name()).distinct().count()


def test_the_rarest_lists_are_taken_until_chance_leaves_none(spark):
    counted = spark.createDataFrame([("a", "x1", 500), ("a", "x2", 10), ("a", "x3", 400), ("a", "x4", 900), ("b", "y1", 1000),
                                     ("b", "y2", None), ("c", "z1", 1), ("c", "z2", 1)], "pattern_id string, trigram string, df long")
    got = {tuple(r) for r in rarest_first(counted, 1000).collect()}
    assert got == {("a", "x2"), ("a", "x3"), ("a", "x1"), ("a", "x4"), ("c", "z1"), ("c", "z2")}
    assert {tuple(r) for r in rarest_first(counted.where("pattern_id = 'a'"), 90).collect()} >= {("a", "x2")}


def test_index_of_an_empty_store(spark, tmp_path):
    empty = Store(spark, str(tmp_path / "empty"), buckets=2)
    empty.build_index()
    assert empty.index().corpus().first().n_docs == 0
    empty.apply(ingest(turns(spark, range(5)), empty.read("memories"), now()))
    assert_equals_rebuild(spark, empty)


def test_trigram_lists_hold_places_and_not_ids(spark, tmp_path, monkeypatch):
    import anamnesis.stored_index as S
    from anamnesis.functions.text import trigrams

    monkeypatch.setattr(S, "BLOCK_ROWS", 8)
    texts = [(f"id-{i:03d}", f"the rose number {i}" if i % 3 else f"a thorn {i * 7}") for i in range(40)]
    memories = spark.createDataFrame(texts, "memory_id string, text string")
    chunks = memories.withColumn("chunk_index", F.lit(0))
    index = S.StoredIndex(spark, f"{tmp_path}/index")
    index.build(chunks, memories)
    rows = index._rows("trigrams")
    assert "memory_id" not in rows.columns and rows.select("block").distinct().count() > 1
    exact = memories.select(F.explode(trigrams("text")).alias("trigram"), "memory_id")
    assert sorted(map(tuple, index.live("trigrams").collect())) == sorted(map(tuple, exact.collect()))
    patterns = spark.createDataFrame([("p", "rose number 1"), ("q", "thorn"), ("r", "lily")], "pattern_id string, pattern string")
    wanted = {("p" if "rose number 1" in t else "q", m) for m, t in texts if "rose number 1" in t or "thorn" in t}
    assert wanted <= {tuple(r) for r in index.candidates(patterns).collect()}
    index.prepare(memories.where("memory_id < 'id-010'").select("memory_id"), chunks.limit(0), memories.limit(0),
                  chunks.where("memory_id < 'id-010'"), memories.where("memory_id < 'id-010'"))
    index.commit(2)
    index.compact()
    left = exact.where("memory_id >= 'id-010'")
    assert sorted(map(tuple, index.live("trigrams").collect())) == sorted(map(tuple, left.collect()))


def test_lists_meet_in_their_blocks_as_they_do_by_counts(spark, tmp_path, monkeypatch):
    from anamnesis import stored_index as S

    monkeypatch.setattr(S, "BLOCK_ROWS", 8)
    texts = [f"{'alpha' if i % 2 else 'beta'} gamma {'delta' if i % 3 else 'epsilon'} {i}" for i in range(60)]
    rows = spark.createDataFrame([(f"m{i:02d}", t) for i, t in enumerate(texts)] + [("m01", "beta gamma")], "memory_id string, text string")
    index = S.StoredIndex(spark, str(tmp_path / "index"))
    index.build(rows.selectExpr("memory_id", "0 AS chunk_index", "text"), rows)
    patterns = spark.createDataFrame([("a", "alpha gamma"), ("b", "beta gamma delta"), ("c", "epsilon"), ("d", "nowhere"), ("c", "epsilon"),
                                      (None, "gamma")], "pattern_id string, pattern string")
    fast = index.candidates(patterns)
    assert "explode(places" not in fast._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(S.StoredIndex, "_places_repeat", lambda self: True)
    assert {tuple(r) for r in fast.collect()} == {tuple(r) for r in index.candidates(patterns).collect()}
    got = {tuple(r) for r in fast.collect()}
    assert got >= {("a", f"m{i:02d}") for i in range(3, 60, 2)} and not any(p in ("d", None) for p, _ in got)
