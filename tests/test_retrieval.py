"""Retrieval operators on small data against brute force, and plans that differ only in size."""

from __future__ import annotations

import math
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from anamnesis.operators import bm25 as B
from anamnesis.operators import knn as K
from anamnesis.operators import sizing
from anamnesis.operators.ann import ann_join, ann_recall
from anamnesis.operators.embedding import HashedEmbedder, embed_column, embed_distinct, embedding_plan, new_cache_rows, sub_batches
from anamnesis.operators.filters import MetaFilter, cold_query_gate, meta_filter
from anamnesis.operators.fusion import best_memories, fetch_depth, leg_depth, rrf_fuse
from anamnesis.operators.knn import knn_join
from anamnesis.plans.recall import recall_hybrid, recall_semantic

CHUNKS = "memory_id string, chunk_index int, vector array<float>"
QUERIES = "query_id string, query_vector array<float>"
TEXTS = "memory_id string, chunk_index int, text string"


def nearest(queries, chunks, k):
    out = []
    for q, qv in queries:
        scored = []
        for m, c, v in chunks:
            n = math.sqrt(np.dot(v, v)) * math.sqrt(np.dot(qv, qv))
            scored.append((round(1 - float(np.dot(v, qv)) / n, 6) if n else 1.0, m, c))
        out += [(q, m, c, d, i + 1) for i, (d, m, c) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    chunks = [(f"m{i // 3:03d}", i % 3, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(300)]
    # A third of all rows are copies of one vector, and a few are zero.
    hot = chunks[0][2]
    chunks = [(m, c, hot if i % 3 == 0 else [0.0] * 8 if i % 50 == 1 else v) for i, (m, c, v) in enumerate(chunks)]
    queries = [(f"q{i}", [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(7)] + [("zero", [0.0] * 8), ("hot", hot)]
    return queries, chunks


@pytest.mark.parametrize("k", [1, 4, 500])
def test_knn_matches_brute_force(spark, rows, vectors, k):
    queries, chunks = vectors
    q, c = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(chunks, CHUNKS)
    assert rows(knn_join(q, c, k)) == sorted(nearest(queries, chunks, k), key=repr)


def test_knn_block_pairs_equal_the_broadcast_plan(spark, rows, vectors, monkeypatch):
    queries, chunks = vectors
    q, c = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(chunks, CHUNKS)
    monkeypatch.setattr(K, "CORPUS_BLOCK_BYTES", 4000)
    assert rows(knn_join(q, c, 4, query_block_bytes=300)) == sorted(nearest(queries, chunks, 4), key=repr)


def test_knn_k_zero_and_empty_sides(spark, vectors):
    queries, chunks = vectors
    q, c = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(chunks, CHUNKS)
    assert knn_join(q, c, 0).count() == 0
    assert knn_join(q.limit(0), c, 3).count() == 0
    assert knn_join(q, c.limit(0), 3).count() == 0
    assert knn_join(q, c, 3, spark.createDataFrame([], "memory_id string")).count() == 0


def test_filtered_knn_never_falls_short(spark, vectors):
    queries, chunks = vectors
    allowed = spark.createDataFrame([("m007",), ("m008",), ("nobody",)], "memory_id string")
    got = knn_join(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(chunks, CHUNKS), 100, allowed)
    assert {(r["query_id"], r["count"]) for r in got.groupBy("query_id").count().collect()} == {(q, 6) for q, _ in queries}


@pytest.mark.parametrize("method", ["ivf", "lsh"])
def test_ann_with_every_cell_is_exact(spark, vectors, method):
    queries, chunks = vectors
    q, c = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(chunks, CHUNKS)
    wide = {"ivf": {"cells": 4, "probes": 4}, "lsh": {"tables": 1, "bits": 0}}[method]
    exact = knn_join(q, c, 5)
    assert ann_recall(ann_join(q, c, 5, method=method, **wide), exact).first()["recall"] == 1.0
    narrow = {"ivf": {"cells": 8, "probes": 1}, "lsh": {"tables": 2, "bits": 4}}[method]
    assert ann_join(q, c, 5, method=method, **narrow).count() > 0


def bm25(queries, texts, k, allowed=None):
    toks = {(m, c): [t for t in re.split(r"[^\w]+", x.lower()) if len(t) >= 2] for m, c, x in texts}
    n = len(toks)
    avg = sum(map(len, toks.values())) / n
    out = []
    for q, text in queries:
        scored = {}
        for t in sorted({t for t in re.split(r"[^\w]+", text.lower()) if len(t) >= 2}):
            df = sum(t in d for d in toks.values())
            for key, d in toks.items():
                if t in d and (allowed is None or key[0] in allowed):
                    tf = d.count(t)
                    idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
                    scored[key] = scored.get(key, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
        ranked = sorted((-round(s, 6), m, c) for (m, c), s in scored.items())[:k]
        out += [(q, m, c, -s, i + 1) for i, (s, m, c) in enumerate(ranked)]
    return sorted(out, key=repr)


DOCS = [("a", 0, "the cat sat on the mat"), ("a", 1, "cat cat cat"), ("b", 0, "the dog and the cat"), ("c", 0, "!!"),
        ("d", 0, "The bird"), ("e", 0, "dog dog bird x y z")] + [(f"z{i}", 0, "the the the") for i in range(6)]
ASKED = [("q1", "the cat"), ("q2", "bird, dog: bird?"), ("q3", "nothing here"), ("q4", "x !"), ("q5", "the")]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(DOCS, TEXTS), spark.createDataFrame(ASKED, "query_id string, query_text string")


def test_bm25_scan(texts, rows):
    chunks, queries = texts
    assert rows(B.bm25_join(queries, chunks, 3)) == bm25(ASKED, DOCS, 3)


def test_bm25_filter_keeps_global_frequencies(spark, texts, rows):
    chunks, queries = texts
    allowed = spark.createDataFrame([("a",), ("e",)], "memory_id string")
    assert rows(B.bm25_join(queries, chunks, 3, allowed)) == bm25(ASKED, DOCS, 3, {"a", "e"})


def test_bm25_large_query_side_is_the_same(spark, texts, rows, monkeypatch):
    chunks, queries = texts
    monkeypatch.setattr(B, "fits_broadcast", lambda *a, **k: False)
    assert rows(B.bm25_join(queries, chunks, 3)) == bm25(ASKED, DOCS, 3)
    allowed = spark.createDataFrame([("a",), ("e",)], "memory_id string")
    assert rows(B.bm25_join(queries, chunks, 3, allowed)) == bm25(ASKED, DOCS, 3, {"a", "e"})


def test_bm25_without_texts(spark, texts):
    chunks, queries = texts
    assert B.bm25_join(queries, chunks.limit(0), 3).count() == 0
    assert B.bm25_join(queries.limit(0), chunks, 3).count() == 0


def test_attach_is_the_same_when_salted(spark, rows, monkeypatch):
    left = spark.range(200).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "x"), (0, "y"), (2, "z")], "k bigint, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        small = rows(sizing.attach(left, right, "k", how))
        assert rows(sizing.attach(left, right, "k", how, max_bytes=0)) == small
        assert rows(sizing.attach(left, right, "k", how, max_bytes=0, even=True)) == small
        assert rows(sizing.attach(left, right, "k", how, computed=True)) == small
        assert rows(sizing.salted_join(left, right, ["k"], how, heavy_rows=20)) == small


def test_only_frequent_keys_are_salted(spark):
    left = spark.range(300).select(F.when(F.col("id") < 150, 0).otherwise(F.col("id")).alias("k"), "id")
    heavy = sizing.frequent_keys(left, ["k"], 40)
    assert [tuple(r) for r in heavy.collect()] == [(0, 4)]
    right = spark.range(300).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    joined = sizing.salted_join(left, right, ["k"], heavy_rows=40)
    assert joined.count() == 300 and joined.where("k = 0").count() == 150
    copies = joined._jdf.queryExecution().optimizedPlan().toString()
    assert copies.count("Generate explode") == 1  # right rows only, and one copy where a key is not frequent


def leg(spark, data):
    return spark.createDataFrame(data, "query_id string, memory_id string, chunk_index int, distance double, rank int")


def test_fusion_and_gate(spark):
    dense = leg(spark, [("far", "a", 0, 0.9, 1), ("near", "a", 0, 0.1, 1), ("near", "b", 0, 0.2, 2), ("word", "c", 0, 0.95, 1)])
    sparse = leg(spark, [("near", "b", 0, 0.0, 1), ("word", "d", 0, 0.0, 1), ("only", "e", 1, 0.0, 1)])
    fused = rrf_fuse(3, dense, sparse)
    near = [(r["memory_id"], r["rank"], r["distance"]) for r in fused.where("query_id = 'near'").orderBy("rank").collect()]
    assert near == [("b", 1, 0.0), ("a", 2, 0.2)]
    assert {r["query_id"] for r in cold_query_gate(fused, dense, sparse).collect()} == {"near", "word", "only"}
    assert (fetch_depth(5), fetch_depth(7), leg_depth(5), leg_depth(140)) == (100, 140, 100, 140)


def test_collapse_takes_the_best_chunk(spark):
    hits = leg(spark, [("q", "a", 2, 0.1, 1), ("q", "b", 0, 0.2, 2), ("q", "a", 0, 0.3, 3), ("q", "c", 0, 0.3, 4)])
    got = [(r["memory_id"], r["chunk_index"], r["rank"]) for r in best_memories(hits, 2).orderBy("rank").collect()]
    assert got == [("a", 2, 1), ("b", 0, 2)]


def test_meta_filter_fields_stack(spark):
    data = [("1", "c", ["x"], "2024-01-01 10:00:00"), ("2", "c", ["x", "y"], "2024-01-02 23:59:59.999"),
            ("3", "d", ["y"], "2024-01-03 00:00:00"), ("4", None, [], "2024-01-02 00:00:00")]
    df = spark.createDataFrame(data, "memory_id string, conversation_id string, tags array<string>, t string").withColumn(
        "updated_at", F.to_timestamp("t"))

    def ids(**fields):
        return "".join(sorted(r["memory_id"] for r in meta_filter(df, MetaFilter(**fields)).collect()))

    assert ids() == "1234" and ids(conversation_id="c") == "12" and ids(tags=("x", "y")) == "123"
    assert ids(exclude_tags=("y",)) == "14" and ids(tags=("nope",)) == "" and ids(tags=("x",), exclude_tags=("y",)) == "1"
    assert ids(start="2024-01-02", end="2024-01-02") == "24" and ids(end="2024-01-02T00:00:00Z") == "14"


def test_embedder_contract(spark):
    df = spark.createDataFrame([("1", "apples are red"), ("2", "red apples"), ("3", "blue whale"), ("4", "the of"), ("5", "red apples")],
                               "memory_id string, text string")
    emb = HashedEmbedder()
    v = {r["memory_id"]: np.array(r["vector"]) for r in embed_distinct(df, emb).collect()}
    assert np.allclose(v["1"], v["2"]) and abs(float(v["1"] @ v["3"])) < 0.5 and not v["4"].any() and (v["2"] == v["5"]).all()
    again = {r["memory_id"]: np.array(r["vector"]) for r in embed_column(df, emb).collect()}
    assert all((again[k] == v[k]).all() for k in v)
    cache = new_cache_rows(df.where("memory_id < '3'"), emb, None)
    assert tuple(embedding_plan(df, emb, cache).first()) == (4, 2, 2)
    foreign = cache.withColumn("model", F.lit("other"))
    assert tuple(embedding_plan(df, emb, foreign).first()) == (4, 0, 4)


def test_sub_batches():
    texts = ["a" * n for n in (3, 3, 50, 1, 1, 1, 1)]
    assert [[len(t) for t in b] for b in sub_batches(texts, 3, 6)] == [[3, 3], [50], [1, 1, 1], [1]]
    assert list(sub_batches([], 3, 6)) == []
    assert [len(b) for b in sub_batches(texts, 4, None)] == [4, 3]


def test_wrong_vector_count_is_an_error(spark):
    class Short(HashedEmbedder):
        def load(self):
            return lambda texts: np.zeros((max(len(texts) - 1, 0), 64))

    with pytest.raises(Exception, match="the embedder returned"):
        embed_column(spark.createDataFrame([("x",), ("y",)], "text string").coalesce(1), Short()).collect()


def test_recall_end_to_end(spark):
    texts = [("m1", 0, "apples and pears"), ("m1", 1, "ripe plums"), ("m2", 0, "steam engines"), ("m3", 0, "plums plums")]
    emb = HashedEmbedder()
    chunks = embed_distinct(spark.createDataFrame(texts, TEXTS), emb)
    memories = spark.createDataFrame([("m1", "c1", ["fruit"], 2), ("m2", None, [], 1), ("m3", None, ["fruit"], 1)],
                                     "memory_id string, conversation_id string, tags array<string>, chunk_count int").withColumn(
        "updated_at", F.current_timestamp())
    queries = spark.createDataFrame([("q", "ripe plums"), ("cold", "zebra crossing")], "query_id string, query_text string")
    for plan in (recall_semantic, recall_hybrid):
        got = [(r["query_id"], r["memory_id"], r["chunk_index"], r["text"]) for r in
               plan(queries, memories, chunks, 2, embedder=emb).where("query_id = 'q'").orderBy("rank").collect()]
        assert got[0] == ("q", "m1", 1, "ripe plums") and got[1][1] == "m3"
        filtered = plan(queries, memories, chunks, 2, MetaFilter(tags=("fruit",), exclude_tags=()), emb)
        assert {r["memory_id"] for r in filtered.where("query_id = 'q'").collect()} == {"m1", "m3"}
    assert recall_semantic(queries, memories, chunks, 2, embedder=emb).where("query_id = 'cold'").count() == 0


def test_queries_with_the_same_known_terms_are_scored_once_and_long_texts_in_pieces(spark, monkeypatch):
    from anamnesis.operators import bm25 as B
    weights = [("b", "x", 1.0), ("a", "x", 1.0), ("c", "y", 1.0), ("d", "x", 1.0), ("d", "y", 1.0)]
    assert B.alike(weights) == {"a": ["a", "b"], "c": ["c"], "d": ["d"]}
    tokens = pa.array([["w"] * 3, ["w"] * 9, [], ["w"] * 2, ["w"] * 2])
    monkeypatch.setattr(B, "SCORE_TOKENS", 4)
    assert list(B._pieces(tokens, 100)) == [(0, 1), (1, 1), (2, 3)]
    chunks = spark.createDataFrame([("m1", 0, "red rose"), ("m2", 0, "rose"), ("m3", 0, "tulip")],
                                   "memory_id string, chunk_index int, text string")
    asked = spark.createDataFrame([("q1", "rose abc"), ("q2", "rose xyz"), ("q3", "tulip")], "query_id string, query_text string")
    hits = {}
    for r in B.bm25_join(asked, chunks, 2).collect():
        hits.setdefault(r["query_id"], []).append((r["rank"], r["memory_id"], r["score"]))
    assert sorted(hits["q1"]) == sorted(hits["q2"]) and [m for _, m, _ in sorted(hits["q1"])] == ["m2", "m1"]
    assert [m for _, m, _ in hits["q3"]] == ["m3"]


def test_indexes_are_summed_up_from_written_tables(spark):
    from anamnesis.operators.indexes import build_indexes

    chunks = spark.createDataFrame([("a", 0, "red fox red"), ("b", 0, ""), ("b", 1, "fox"), ("c", 0, None)], "memory_id string, chunk_index int, text string")
    tables = build_indexes(chunks, chunks.select("memory_id", "text"))
    assert all(table.inputFiles() for table in tables.values())
    assert {(r.term, r.df) for r in tables["term_stats"].collect()} == {("red", 1), ("fox", 2)}
    assert tables["corpus_stats"].select("n_docs").first()[0] == 4


def test_a_large_lexical_query_side_is_taken_in_blocks_of_queries(spark, texts, rows, monkeypatch):
    chunks, queries = texts
    monkeypatch.setattr(B, "BROADCAST_MAX_ROWS", 3)
    monkeypatch.setattr(B, "fits_broadcast", lambda side, asked=[]: asked.append(side) or len(asked) > 1)  # noqa: B006
    monkeypatch.setattr(B, "salted_join", None)  # no row is made per query and posting
    assert rows(B.bm25_join(queries, chunks, 3)) == bm25(ASKED, DOCS, 3)


def test_query_blocks_meet_the_corpus_in_rounds_and_leave_no_copies(spark, rows, vectors, monkeypatch):
    from anamnesis import session as S

    queries, chunks = vectors
    twice = [("q0", queries[1][1]), ("q1", queries[0][1])]  # ids that are there twice, maybe in two rounds
    q, c = spark.createDataFrame(queries + twice, QUERIES), spark.createDataFrame(chunks, CHUNKS)
    expected = rows(knn_join(q, c, 5))
    met, written = [], []
    monkeypatch.setattr(K, "QUERY_BLOCK_ROWS", 2)
    monkeypatch.setattr(K, "CORPUS_BLOCK_BYTES", 4000)
    monkeypatch.setattr(K, "rounds_of", lambda spark, left, right: [range(i, min(i + 2, left)) for i in range(0, left, 2)])
    monkeypatch.setattr(K, "write_table", lambda df, real=S.write_table: met.append(df) or real(df))
    monkeypatch.setattr(S, "write_table", lambda df, real=S.write_table: written.append(real(df)) or written[-1])
    assert rows(knn_join(q, c, 5)) == expected
    assert len(met) > 1 and len(written) == 2
    path = spark._jvm.org.apache.hadoop.fs.Path
    assert not any(path(one).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(one)) for one in written)


def test_shuffle_files_go_with_the_write_and_scratch_tables_with_their_scope(spark):
    from anamnesis.session import cut_lineage, scratch, settled

    def shuffled() -> set[str]:
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {name for name in blocks.mkString(" ").split() if name.startswith("shuffle_")}

    before = shuffled()
    kept = cut_lineage(spark.range(1000).repartition(3, "id").groupBy("id").count())
    until = time.time() + 10  # files go in the background
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before and kept.count() == 1000
    inner = []
    made = settled(spark, lambda: inner.append(cut_lineage(kept.where("id < 10"))) or inner[0].join(kept.select("id"), "id"))
    assert made.count() == 10 and made.inputFiles()
    with scratch(spark):
        path = spark._jvm.org.apache.hadoop.fs.Path(inner[0].inputFiles()[0])
        gone = settled(spark, lambda: made.select("id")).inputFiles()[0]
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    path = spark._jvm.org.apache.hadoop.fs.Path(gone)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
