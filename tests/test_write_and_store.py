"""Import, update, delete, reconcile and the tables they land in."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from anamnesis.operators.changes import snapshot_diff
from anamnesis.operators.embedding import HashedEmbedder
from anamnesis.operators.evaluation import nearest_rank_percentile, nearest_rank_percentiles, seeded_sample
from anamnesis.operators.filters import require_valid_ids
from anamnesis.operators.listing import conversation_entries, list_ranked
from anamnesis.plans import write as P
from anamnesis.plans.maintenance import VersionedTable, reembed
from anamnesis.session import cut_lineage
from anamnesis.sources.envelopes import envelope_files, integrity_audit, read_envelopes, rotate_key, write_envelopes
from anamnesis.sources.transcripts import assemble_sessions, session_jsonl_turns
from anamnesis.store import Store, copy_missing_tables, export_store, import_store
from anamnesis.streaming.jobs import ingest_turns, line_stream, stream_ingest

EMB = HashedEmbedder()
TURNS = ("source string, conversation_id string, memory_id string, parent_id string, turn_index bigint, text string, "
         "created_at timestamp, tags array<string>, fallback_at timestamp")


def uid(i):
    return f"00000000-0000-4000-8000-{i:012d}"


def turn(i, text, at=None, conv=900):
    return ("x", uid(conv), uid(i), None, i, text, at, ["source:x"], None)


def now():
    return F.to_timestamp(F.lit("2025-01-01T00:00:00Z"))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), buckets=3)


def texts(store):
    return {r["memory_id"][-2:]: r["text"] for r in store.read("memories").collect()}


def test_import_is_idempotent(spark, store):
    first = [turn(1, "one"), turn(2, "two", dt.datetime(2024, 1, 1)), turn(2, "again"), turn(3, "   "), turn(4, "x. " * 900)]
    report = ingest_turns(store, spark.createDataFrame(first, TURNS), EMB)
    assert {(r["added"], r["skipped"]) for r in report.collect()} == {(3, 2)}
    stored = {r["memory_id"][-2:]: r for r in store.read("memories").collect()}
    assert set(stored) == {"01", "02", "04"} and stored["04"]["chunk_count"] > 1
    assert stored["01"]["created_at"] == stored["01"]["updated_at"] == dt.datetime(2024, 1, 1)
    again = ingest_turns(store, spark.createDataFrame(first + [turn(5, "five")], TURNS), EMB)
    assert {(r["added"], r["skipped"]) for r in again.collect()} == {(1, 5)}
    assert len(texts(store)) == 4
    chunks = store.read("chunks")
    assert chunks.count() == chunks.select("memory_id", "chunk_index").distinct().count()
    assert chunks.where("vector IS NULL").count() == 0
    assert store.cache().count() == store.cache().select("text_sha256").distinct().count()


def test_import_refuses_bad_ids_and_the_reserved_tag(spark):
    memories = spark.createDataFrame([], "memory_id string, tags array<string>")
    rows = spark.createDataFrame([turn(1, "a")], TURNS)
    with pytest.raises(ValueError, match="invalid id"):
        P.ingest(rows.withColumn("memory_id", F.lit("../up")), memories, now())
    with pytest.raises(ValueError, match="_index"):
        P.ingest(rows, memories, now(), ["_index"])
    require_valid_ids(rows, "memory_id", optional=("parent_id",))


def test_update_delete_and_emptied_buckets(spark, store):
    ingest_turns(store, spark.createDataFrame([turn(i, f"text {i}") for i in range(1, 7)], TURNS), EMB)
    etags = {r["memory_id"]: r["etag"] for r in store.read("memories").collect()}
    updates = spark.createDataFrame([
        (uid(1), "changed", None, etags[uid(1)], 1), (uid(2), "lost", None, "old", 1), (uid(3), "clear", [], etags[uid(3)], 1),
        (uid(3), "too late", ["z"], etags[uid(3)], 2), (uid(99), "nobody", None, "x", 1), (uid(4), "  ", None, etags[uid(4)], 1)],
        "memory_id string, text string, tags array<string>, etag string, update_order bigint")
    change = P.update_batch(updates, store.read("memories"), now(), EMB)
    assert {(r["memory_id"][-2:], r["reason"]) for r in change.report.collect()} == {
        ("02", "stale"), ("03", "stale"), ("99", "missing"), ("04", "empty")}
    store.apply(change)
    after = {r["memory_id"][-2:]: r for r in store.read("memories").collect()}
    assert after["01"]["text"] == "changed" and after["01"]["tags"] == ["source:x"] and after["03"]["tags"] == []
    assert after["01"]["updated_at"] == dt.datetime(2025, 1, 1) and after["01"]["created_at"] != after["01"]["updated_at"]
    assert after["01"]["etag"] != etags[uid(1)] and after["02"]["text"] == "text 2" and len(after) == 6
    ids = spark.createDataFrame([(uid(i),) for i in (1, 2, 3, 4, 5, 77)], "memory_id string")
    gone = P.delete_batch(ids, store.read("memories"), store.read("chunks"))
    assert [r["memory_id"] for r in gone.report.collect()] == [uid(77)]
    store.apply(gone)
    assert set(texts(store)) == {"06"} and {r["memory_id"] for r in store.read("chunks").collect()} == {uid(6)}


def test_reconcile_follows_older_versions_too(spark, store):
    ingest_turns(store, spark.createDataFrame([turn(i, f"text {i}") for i in (1, 2, 3)], TURNS), EMB)
    stored = store.read("memories")
    landed = stored.where(f"memory_id <> '{uid(3)}'").withColumn(
        "text", F.when(F.col("memory_id") == uid(1), F.lit("other")).otherwise(F.col("text"))).withColumn(
        "etag", F.when(F.col("memory_id") == uid(1), F.lit("0")).otherwise(F.col("etag")))
    extra = stored.where(f"memory_id = '{uid(3)}'").withColumn("memory_id", F.lit(uid(8)))
    snapshot = cut_lineage(landed.unionByName(extra))
    pieces = snapshot.select("memory_id", F.lit(0).alias("chunk_index"), "text", F.sha2("text", 256).alias("text_sha256"),
                             F.lit(None).cast("array<float>").alias("vector"))
    change = P.reconcile(snapshot, pieces, stored)
    assert tuple(store.apply(change).select("added", "updated", "removed").first()) == (1, 1, 1)
    assert texts(store) == {"01": "other", "02": "text 2", "08": "text 3"}
    assert snapshot_diff(store.read("memories"), snapshot, version="etag").count() == 0


def test_write_batch_outcomes(spark, store):
    ingest_turns(store, spark.createDataFrame([turn(1, "apples and pears today")], TURNS), EMB)
    rows = spark.createDataFrame([
        (uid(11), "pears and apples today", None, 1), (uid(12), "steam engines", ["_index"], 2), (uid(13), "steam engines", None, 3),
        (uid(14), " ", None, 4), (uid(15), "second index", ["_index"], 5), (uid(16), "blue whales sing", ["t"], 6)],
        "memory_id string, text string, tags array<string>, input_order bigint")
    change = P.write_batch(rows, store.read("memories"), store.read("chunks"), EMB, now())
    got = {r["memory_id"][-2:]: (r["outcome"], r["similar_id"]) for r in change.report.collect()}
    assert got == {"11": ("duplicate", uid(1)), "12": ("accepted", None), "13": ("duplicate", uid(12)), "14": ("empty", None),
                   "15": ("reserved", None), "16": ("accepted", None)}
    store.apply(change)
    assert set(texts(store)) == {"01", "12", "16"}


def test_given_chunks_are_kept(spark):
    rows = spark.createDataFrame([("a", None, ["x", "  ", "y"]), ("b", "z", None)], "memory_id string, text string, chunks array<string>")
    assert {r["memory_id"]: r["pieces"] for r in P.split_pieces(rows).collect()} == {"a": ["x", "y"], "b": ["z"]}


def test_export_import_and_copy(spark, store, tmp_path):
    ingest_turns(store, spark.createDataFrame([turn(i, f"text {i}") for i in (1, 2)], TURNS), EMB)
    export_store(store, str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        export_store(store, str(tmp_path / "out"))
    other = Store(spark, str(tmp_path / "other"), buckets=2)
    import_store(spark, str(tmp_path / "out"), other)
    assert texts(other) == texts(store)
    with pytest.raises(ValueError, match="already holds"):
        import_store(spark, str(tmp_path / "out"), other)
    ingest_turns(store, spark.createDataFrame([turn(3, "text 3")], TURNS), EMB)
    assert copy_missing_tables(store, other) == {"memories": 0, "chunks": 0}
    assert texts(other) == texts(store)
    foreign = Store(spark, str(tmp_path / "foreign"), buckets=2)
    ingest_turns(foreign, spark.createDataFrame([turn(50, "else")], TURNS), EMB)
    with pytest.raises(ValueError, match="different store"):
        copy_missing_tables(store, foreign)


KEY, NEW, BAD = (bytes([i]) * 32 for i in (1, 2, 3))


def test_envelopes(spark, store, tmp_path):
    ingest_turns(store, spark.createDataFrame([turn(i, f"text {i}") for i in range(1, 6)], TURNS), EMB)
    memories, chunks = store.read("memories"), store.read("chunks")
    sealed = write_envelopes(memories, chunks, KEY)
    sealed.write.parquet(str(tmp_path / "sealed"))
    sealed = spark.read.parquet(str(tmp_path / "sealed"))
    assert sealed.select("chunks.iv").distinct().count() == 5
    back, pieces, rejects = read_envelopes(sealed, KEY)
    assert rejects.count() == 0 and back.count() == 5
    same = pieces.join(chunks, ["memory_id", "chunk_index"]).where(pieces["vector"] == chunks["vector"])
    assert same.count() == 5
    with pytest.raises(Exception, match="cannot decrypt"):
        rotate_key(sealed, BAD, NEW).collect()
    staged = rotate_key(sealed.limit(2), KEY, NEW)
    staged.write.parquet(str(tmp_path / "staged"))
    staged = spark.read.parquet(str(tmp_path / "staged"))
    rest = rotate_key(sealed, KEY, NEW, staged)
    assert rest.count() == 3
    assert {tuple(r) for r in integrity_audit(staged.unionByName(rest), NEW).collect()} == {("ok", 5)}
    assert {tuple(r) for r in integrity_audit(sealed, BAD).collect()} == {("wrong-key", 5)}


def test_envelope_files_are_checked(spark, store, tmp_path):
    ingest_turns(store, spark.createDataFrame([turn(i, f"text {i}") for i in range(1, 5)], TURNS), EMB)
    rows = write_envelopes(store.read("memories"), store.read("chunks"), KEY).select(
        "memory_id", F.to_json(F.struct(F.col("memory_id").alias("id"), "chunks", "meta")).alias("j")).collect()
    folder = tmp_path / "files"
    folder.mkdir()
    text = {r["memory_id"]: r["j"] for r in rows}
    (folder / f"{uid(1)}.mem").write_text(text[uid(1)])
    (folder / f"{uid(2)}.mem").write_text(text[uid(3)])
    (folder / f"{uid(3)}.mem").write_text(text[uid(3)].replace(uid(3), uid(9)))
    (folder / f"{uid(9)}.mem").write_text(text[uid(3)].replace(uid(3), uid(9)))
    (folder / f"{uid(4)}.mem").write_text("{oops")
    memories, _, rejects = read_envelopes(envelope_files(spark, str(folder)), KEY)
    assert [r["memory_id"] for r in memories.collect()] == [uid(1)]
    assert {r["memory_id"][-2:]: r["reason"] for r in rejects.collect()} == {
        "02": "id-mismatch", "03": "id-mismatch", "09": "chunks-authentication", "04": "not-json"}


def test_versions_publish_only_when_complete(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.current() == 0 and table.staged() is None
    table.stage(spark.range(3))
    with pytest.raises(ValueError, match="expected 5"):
        table.publish(5)
    table.stage(spark.range(3, 5))
    assert table.publish(5) == 1 and table.read().count() == 5
    table.stage(spark.range(1))
    assert table.read().count() == 5
    assert table.publish(1) == 2 and table.read().count() == 1


def test_reembed_resumes(spark):
    chunks = spark.createDataFrame([("a", 0, "x y"), ("b", 0, "z")], "memory_id string, chunk_index int, text string")
    staged = reembed(chunks.limit(1), EMB)
    assert reembed(chunks, EMB, staged).count() == 1


def test_stream_of_growing_transcripts(spark, store, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    conversation = uid(900)

    def line(i):
        return ('{"type":"user","uuid":"%s","timestamp":"2024-01-01T00:00:%02dZ","message":{"content":"turn %d"}}' % (uid(i), i, i))

    def run():
        query = stream_ingest(line_stream(spark, str(landing)), session_jsonl_turns, store, str(tmp_path / "offsets"), EMB)
        query.awaitTermination()

    (landing / "1").mkdir()
    (landing / "1" / f"{conversation}.jsonl").write_text("\n".join(line(i) for i in (1, 2)))
    run()
    assert len(texts(store)) == 2
    (landing / "2").mkdir()
    (landing / "2" / f"{conversation}.jsonl").write_text("\n".join(line(i) for i in (1, 2, 3)))
    run()
    assert texts(store) == {"01": "USER: turn 1", "02": "USER: turn 2", "03": "USER: turn 3"}


def test_forks_and_listing(spark):
    schema = "memory_id string, conversation_id string, parent_id string, created_at timestamp, text string"
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", "c", None, at, "1"), ("b", "c", "a", at, "2"), ("d", "c", "a", at, "3"), ("e", "c", "d", at, "4"),
                                ("f", "x", "a", at, "5"), ("g", None, None, at, "6")], schema)
    got = [(r["memory_id"], r["fork_from"]) for r in conversation_entries(df).collect()]
    assert got == [("a", None), ("b", "a"), ("d", "a"), ("e", None), ("f", None)]


def test_query_listing_reorders_and_never_filters(spark):
    memories = spark.createDataFrame([(f"m{i}", i) for i in range(6)], "memory_id string, s int").select(
        "memory_id", F.timestamp_seconds("s").alias("updated_at"), F.array(F.lit("t")).alias("tags"))
    queries = spark.createDataFrame([("q",), ("cold",)], "query_id string")
    ranked = spark.createDataFrame([("q", "m1", 1), ("q", "m5", 2)], "query_id string, memory_id string, rank int")
    got = list_ranked(queries, ranked, memories, 4).orderBy("query_id", "rank").collect()
    assert [r["memory_id"] for r in got] == ["m5", "m4", "m3", "m2", "m1", "m5", "m4", "m3"]


def test_percentiles_and_sample(spark):
    data = [("a", float(i)) for i in range(1, 11)] + [("b", 7.0)] * 5 + [("b", 1.0)] + [("c", None), ("c", 3.5)]
    df = spark.createDataFrame(data, "g string, v double")
    for p, want in ((50, {"a": 5.0, "b": 7.0, "c": 3.5}), (95, {"a": 10.0, "b": 7.0, "c": 3.5}), (10, {"a": 1.0, "b": 1.0, "c": 3.5})):
        assert {r["g"]: r["percentile"] for r in nearest_rank_percentile(df, ["g"], "v", p).collect()} == want
    both = nearest_rank_percentiles(df.withColumn("v", F.col("v") - 5), ["g"], "v", [10, 50]).collect()
    assert {(r.g, r.p, r.percentile) for r in both} == {("a", 10, -4.0), ("a", 50, 0.0), ("b", 10, -4.0), ("b", 50, 2.0),
                                                        ("c", 10, -1.5), ("c", 50, -1.5)}
    whole = nearest_rank_percentiles(spark.range(-50, 51), [], "id", [1, 50, 100]).collect()
    assert {(r.p, r.percentile) for r in whole} == {(1, -49), (50, 0), (100, 50)}
    ids = spark.range(50)
    one, two = ({r["id"] for r in seeded_sample(ids, "id", 10, s).collect()} for s in (1, 1))
    assert one == two and len(one) == 10 and seeded_sample(ids, "id", 99, 1).count() == 50
    assert {r["id"] for r in seeded_sample(ids, "id", 10, 2).collect()} != one


def test_sessions_are_assembled_once(spark):
    rows = assemble_sessions(spark.createDataFrame([turn(1, "a"), turn(2, "b", dt.datetime(2024, 5, 5))], TURNS))
    assert {r["session_at"] for r in rows.collect()} == {dt.datetime(2024, 5, 5)}


def test_a_later_current_update_applies_and_one_memory_claims_the_tag(spark, store):
    ingest_turns(store, spark.createDataFrame([turn(1, "one"), turn(2, "two")], TURNS), EMB)
    memories = store.read("memories")
    first, second = (r for r in memories.orderBy("memory_id").limit(2).collect())
    schema = "memory_id string, text string, tags array<string>, etag string, update_order bigint"
    updates = spark.createDataFrame([
        (first.memory_id, "old etag", None, "stale", 1), (first.memory_id, "applies", None, first.etag, 2),
        (second.memory_id, " ", ["_index"], second.etag, 3), (second.memory_id, "claims", ["_index"], second.etag, 4),
        (first.memory_id, "claims too", ["_index"], first.etag, 5)], schema)
    change = P.update_batch(updates, memories, now(), EMB)
    assert {(r.memory_id, r.text) for r in change.memories.collect()} == {(first.memory_id, "applies"), (second.memory_id, "claims")}
    assert {(r.update_order, r.reason) for r in change.report.collect()} == {(1, "stale"), (3, "empty"), (5, "reserved")}


def test_the_tag_goes_to_the_first_claimant_that_is_written(spark, store):
    memories = store.read("memories").limit(0)
    schema = "memory_id string, chunks array<string>, text string, tags array<string>, input_order bigint"
    rows = spark.createDataFrame([
        ("a", ["steam engines roar", "green apples fall"], None, None, 1), ("b", None, "green apples fall", None, 2),
        ("c", None, "  ", ["_index"], 3), ("d", None, "steam engines roar", ["_index"], 4),
        ("e", None, "purple oceans sleep", ["_index"], 5), ("f", None, "quiet mountains glow", ["_index"], 6),
        ("g", None, "purple oceans sleep", None, 7)], schema)
    report = P.write_batch(rows, memories, store.read("chunks").limit(0), EMB, now()).report.collect()
    assert {r.memory_id: (r.outcome, r.similar_id) for r in report} == {
        "a": ("accepted", None), "b": ("duplicate", "a"), "c": ("empty", None), "d": ("duplicate", "a"),
        "e": ("accepted", None), "f": ("reserved", None), "g": ("duplicate", "e")}


def updates_one_by_one(updates, tags, etags):
    """The rule as a loop: {order: reason or 'applied'}."""
    carriers, current, out = {m for m, t in tags.items() if "_index" in t}, dict(etags), {}
    for memory_id, text, new_tags, etag, order in sorted(updates, key=lambda u: (u[4], u[0])):
        holder = min(carriers, default=None)
        if "_index" in (new_tags or []) and holder not in (None, memory_id):
            out[order] = "reserved"
        elif memory_id not in current:
            out[order] = "missing"
        elif not text.strip():
            out[order] = "empty"
        elif current[memory_id] != etag:
            out[order] = "stale"
        else:
            out[order], current[memory_id] = "applied", None
            if new_tags is not None:
                carriers = carriers | {memory_id} if "_index" in new_tags else carriers - {memory_id}
    return out


@pytest.mark.parametrize("carriers", [0, 1, 3])
def test_updates_follow_a_plain_loop(spark, carriers):
    rng = random.Random(carriers)
    tags = {uid(i): ["_index"] if i < carriers else ["a"] for i in range(8)}
    etags = {m: f"e{m[-2:]}" for m in tags}
    memories = spark.createDataFrame(
        [(m, None, None, None, t, "old", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), 1, etags[m]) for m, t in tags.items()],
        "memory_id string, conversation_id string, parent_id string, turn_index bigint, tags array<string>, text string, "
        "created_at timestamp, updated_at timestamp, chunk_count int, etag string")
    schema = "memory_id string, text string, tags array<string>, etag string, update_order bigint"
    batches = [[(uid(rng.choice((0, 0, 1, 2, 3, 4, 5, 9))), rng.choice(("new", "new", "new", " ")),
                 rng.choice((None, [], ["b"], ["_index"], ["_index", "c"])), None, order) for order in range(30)] for _ in range(2)]
    # A release, then a claim; a claim with an old etag before one that applies.
    batches.append([(uid(0), "x", [], None, 1), (uid(5), "x", ["_index"], None, 2), (uid(6), "x", ["_index"], None, 3)])
    for batch in batches:
        updates = [(m, text, t, etags.get(m, "e") if rng.random() < 0.8 else "old", order) for m, text, t, _, order in batch]
        change = P.update_batch(spark.createDataFrame(updates, schema), memories, now())
        got = {r.update_order: r.reason for r in change.report.collect()}
        want = updates_one_by_one(updates, tags, etags)
        assert got == {order: reason for order, reason in want.items() if reason != "applied"}
        by_order = {u[4]: u[0] for u in updates}
        assert sorted(r.memory_id for r in change.gone.collect()) == sorted(by_order[o] for o, r in want.items() if r == "applied")


def test_an_accepted_claimant_blocks_rows_behind_it(spark, store):
    """Claimants that are duplicates come first; the one that is accepted rejects a later row."""
    schema = "memory_id string, text string, tags array<string>, input_order bigint"
    rows = [("a", "steam engines roar", None, 1), ("z", "green apples fall", None, 9), ("y", "green apples fall", None, 8)]
    rows += [(f"c{i}", "steam engines roar", ["_index"], 2 + i) for i in range(4)] + [("w", "green apples fall", ["_index"], 7)]
    rows += [("v", "green apples fall", ["_index"], 10)]
    report = P.write_batch(spark.createDataFrame(rows, schema), store.read("memories").limit(0), store.read("chunks").limit(0),
                           EMB, now()).report.collect()
    assert {r.memory_id: (r.outcome, r.similar_id, r.similarity) for r in report} == {
        "a": ("accepted", None, None), "w": ("accepted", None, None), "v": ("reserved", None, None),
        "y": ("duplicate", "w", 1.0), "z": ("duplicate", "w", 1.0), **{f"c{i}": ("duplicate", "a", 1.0) for i in range(4)}}


def test_texts_of_a_change_are_split_once(spark, store):
    turns = spark.createDataFrame([turn(1, "one. Two " * 400), turn(2, "two"), turn(3, " ")], TURNS)
    change = P.ingest(turns, store.read("memories"), now())
    updated = P.update_batch(spark.createDataFrame([(uid(1), "new. Text " * 400, None, "x", 1)],
                                                   "memory_id string, text string, tags array<string>, etag string, update_order bigint"),
                             store.read("memories"), now())
    for rows in (change.memories, change.chunks, change.report, updated.memories, updated.chunks):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "split(" not in plan and "aggregate(" not in plan
    assert {(r["added"], r["skipped"]) for r in change.report.collect()} == {(2, 1)}
    assert change.chunks.count() > 2 and change.memories.count() == 2


def test_a_batch_keeps_its_texts_once(spark, store, monkeypatch):
    made = []
    monkeypatch.setattr(P, "cut_lineage", lambda df: made.append(cut_lineage(df)) or made[-1])
    rows = spark.createDataFrame([(uid(11), "pears. Apples " * 300, None, 1), (uid(12), "steam engines", None, 2)],
                                 "memory_id string, text string, tags array<string>, input_order bigint")
    change = P.write_batch(rows, store.read("memories"), store.read("chunks"), EMB, now())
    assert sum("text" in df.columns or "pieces" in df.columns for df in made) == 1
    stored = {(r["memory_id"], r["chunk_index"]): r for r in change.chunks.collect()}
    assert len(stored) > 2 and all(r["vector"] and r["text_sha256"] for r in stored.values())
    assert change.chunks.columns == ["memory_id", "chunk_index", "text", "text_sha256", "vector"]


def test_what_a_shared_store_is_made_of_goes(spark):
    from workload.stored import shared_store

    made = []
    kept = shared_store(spark, "nowhere", uid(1), lambda store: made.append(cut_lineage(spark.range(3))))
    path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.org.apache.hadoop.fs.Path(made[0]._jdf.inputFiles()[0]).getParent().toString()) \
        if made[0].inputFiles() else None
    assert kept.root and path is not None and not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
