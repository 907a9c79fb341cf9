"""Readers against files written here in the layouts they accept."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

import pytest

from pyspark.sql import functions as F

from anamnesis.sources import routing
from anamnesis.sources import transcripts as T
from anamnesis.sources.evaluation import read_checkpoint, read_questions
from anamnesis.sources.lines import read_lines

A, B, C = ("11111111-1111-4111-8111-111111111111", "22222222-2222-4222-8222-222222222222",
           "33333333-3333-4333-8333-333333333333")


def uuid5_like(seed: str) -> str:
    h = hashlib.sha256(seed.encode()).hexdigest()
    v = "89ab"[int(h[16], 16) & 3]
    return f"{h[:8]}-{h[8:12]}-5{h[13:16]}-{v}{h[17:20]}-{h[20:32]}"


def turns(df):
    picked = df.orderBy("conversation_id", "turn_index").collect()
    return [(r["memory_id"], r["parent_id"], r["text"], r["created_at"]) for r in picked]


def at(*parts):
    return dt.datetime(*parts)


def test_chat_tree(spark, tmp_path):
    def node(i, parent, message):
        return {"id": i, "parent": parent, "children": [], "message": message}

    def message(role, time, parts, **more):
        return {"author": {"role": role}, "create_time": time, "content": {"content_type": "text", "parts": parts},
                "metadata": more}

    mapping = {
        "root": node("root", None, None),
        "late": node("late", "first", message("assistant", 20.5, ["  second\nreply "])),
        "hidden": node("hidden", "root", message("user", 5, ["secret"], is_visually_hidden_from_conversation=True)),
        "sys": node("sys", "root", message("system", 1, ["setup"])),
        "first": node("first", "root", message("User", 10, [{"asset": 1}, "hello", "there"])),
        "timeless": node("timeless", "first", message("assistant", None, ["no time"])),
        "empty": node("empty", "first", message("user", 30, ["   "])),
        "code": node("code", "first", {"author": {"role": "assistant"}, "create_time": 40, "content": {"text": " run "}}),
    }
    (tmp_path / "conversations.json").write_text(json.dumps(
        [{"conversation_id": "c-1", "create_time": 3.25, "mapping": mapping}, {"id": "c-2", "mapping": {}}]))
    (tmp_path / "broken.json").write_text('[{"mapping": ')
    df = T.read_chat_tree(spark, str(tmp_path))
    assert turns(df) == [
        (uuid5_like("timeless"), uuid5_like("first"), "ASSISTANT: no time", None),
        (uuid5_like("first"), uuid5_like("root"), "USER: hello\nthere", at(1970, 1, 1, 0, 0, 10)),
        (uuid5_like("late"), uuid5_like("first"), "ASSISTANT: second\nreply", at(1970, 1, 1, 0, 0, 20, 500000)),
        (uuid5_like("code"), uuid5_like("first"), "ASSISTANT: run", at(1970, 1, 1, 0, 0, 40)),
    ]
    assert {(r["conversation_id"], r["fallback_at"], tuple(r["tags"])) for r in df.collect()} == {
        (uuid5_like("c-1"), at(1970, 1, 1, 0, 0, 3, 250000), ("source:chatgpt",))}
    raw = T.read_json(spark, str(tmp_path), "mapping map<string,variant>")
    assert [r["path"].rsplit("/", 1)[1] for r in T.json_rejects(raw).collect()] == ["broken.json"]


def test_session_jsonl(spark, tmp_path):
    lines = [
        {"type": "user", "uuid": A, "timestamp": "2024-05-01T10:00:00.000Z", "message": {"role": "user", "content": " hi "}},
        "not json",
        {"type": "assistant", "uuid": B, "parentUuid": A, "timestamp": "2024-05-01T10:00:05Z",
         "message": {"content": [{"type": "text", "text": "one"}, {"type": "tool_use", "text": "x"}, {"type": "text", "text": "two"}]}},
        {"type": "user", "uuid": C, "isSidechain": True, "message": {"content": "side"}},
        {"type": "user", "uuid": "not-an-id", "message": {"content": "bad id"}},
        {"type": "summary", "uuid": C, "message": {"content": "summary"}},
        {"type": "user", "uuid": C, "parentUuid": "nope", "message": {"content": [{"type": "tool_result", "content": "r"}]}},
    ]
    text = "\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines)
    (tmp_path / f"{A}.jsonl").write_text(text + "\n")
    (tmp_path / "copy.jsonl").write_text(text)
    df = T.read_session_jsonl(spark, str(tmp_path))
    assert turns(df) == [(A, None, "USER: hi", at(2024, 5, 1, 10)), (B, A, "ASSISTANT: one\ntwo", at(2024, 5, 1, 10, 0, 5))]
    assert {r["conversation_id"] for r in df.collect()} == {A}
    rejects = T.line_rejects(read_lines(spark, str(tmp_path / f"{A}.jsonl"))).collect()
    assert [(r["line_no"], r["content"]) for r in rejects] == [(2, "not json")]


def test_agent_jsonl_names_records_by_place(spark, tmp_path):
    folder = tmp_path / "agents" / "main" / "sessions"
    folder.mkdir(parents=True)
    lines = [
        json.dumps({"type": "session", "id": "s", "message": {"role": "user", "text": "x"}}),
        "{torn",
        json.dumps({"id": "m1", "timestamp": "2024-01-02T03:04:05Z", "message": {"role": "USER", "text": " ask "}}),
        json.dumps({"parentId": "m1", "timestamp": 1704164646000,
                    "message": {"role": "assistant", "content": [{"type": "text", "text": "answer"}]}}),
        json.dumps({"type": "compaction", "message": {"role": "user", "text": "x"}}),
        json.dumps({"id": "m3", "message": {"role": "tool", "text": "x"}}),
        json.dumps({"id": "m4", "message": {"role": "user", "text": "", "content": "ignored"}}),
    ]
    (folder / "run7.jsonl").write_text("\n".join(lines))
    (folder / "run7.trajectory.jsonl").write_text(lines[2])
    conversation = uuid5_like("run7")
    # The torn line does not count: the record without an id is the third that parsed.
    assert turns(T.read_agent_jsonl(spark, str(tmp_path))) == [
        (uuid5_like("m1"), None, "USER: ask", at(2024, 1, 2, 3, 4, 5)),
        (uuid5_like(f"{conversation}:2"), uuid5_like("m1"), "ASSISTANT: answer", at(2024, 1, 2, 3, 4, 6)),
    ]


def test_line_numbers_cross_splits(spark, tmp_path):
    count = 5000
    (tmp_path / "long.jsonl").write_text("\n".join(
        json.dumps({"message": {"role": "user", "text": f"line {i} " + "x" * 50}}) for i in range(count)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = read_lines(spark, str(tmp_path))
        assert lines.select("block").distinct().count() > 3
        got = T.agent_jsonl_turns(lines).select("turn_index", "text", "memory_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    conversation = uuid5_like("long")
    assert sorted((r["turn_index"], r["text"].split()[2], r["memory_id"]) for r in got) == sorted(
        (i, str(i), uuid5_like(f"{conversation}:{i}")) for i in range(count))


def test_channel_export(spark, tmp_path):
    general = tmp_path / "general talk"
    general.mkdir()
    day1 = [
        {"type": "message", "user": "U1", "text": "see <https://x.org/a|the page> and <https://y.org>", "ts": "1705312800.000100",
         "user_profile": {"display_name": " ", "real_name": "Ann Lee", "name": "ann"}},
        {"type": "message", "subtype": "channel_join", "user": "U2", "text": "joined", "ts": "1705312801.0"},
        {"type": "message", "subtype": "bot_message", "text": "beep", "ts": "1705312802.0"},
        {"type": "message", "user": "U2", "text": "reply", "ts": "1705312900.000200", "thread_ts": "1705312800.000100"},
        {"type": "message", "user": "U3", "text": "   ", "ts": "1705312901.0"},
    ]
    day2 = [{"type": "message", "user": "U1", "text": "next day", "ts": "1705399200.5", "thread_ts": "1705399200.5"}]
    (general / "2024-01-15.json").write_text(json.dumps(day1))
    (general / "2024-01-16.json").write_text(json.dumps(day2))
    def mid(ts):
        return uuid5_like(f"general talk:{ts}")

    df = T.read_channel_export(spark, str(tmp_path))
    assert turns(df) == [
        (mid("1705312800.000100"), None, "Ann Lee: see the page and https://y.org", at(2024, 1, 15, 10)),
        (mid("1705312900.000200"), mid("1705312800.000100"), "U2: reply", at(2024, 1, 15, 10, 1, 40)),
        (mid("1705399200.5"), None, "U1: next day", at(2024, 1, 16, 10, 0, 0, 500000)),
    ]
    assert {r["conversation_id"] for r in df.collect()} == {uuid5_like("slack:general talk")}


@pytest.mark.parametrize("whole", [True, False])
def test_messenger_export(spark, tmp_path, whole):
    chat = {"id": 77, "name": "Pals", "messages": [
        {"id": 1, "type": "service", "text": "created"},
        {"id": 2, "type": "message", "from": "Bo", "date_unixtime": "1700000000",
         "text": ["see ", {"type": "link", "text": "https://a.b"}, "!"]},
        {"id": 3, "type": "message", "from": "Cy", "date_unixtime": "1700000060", "text": "yes", "reply_to_message_id": 2},
        {"id": 4, "type": "message", "from": "Cy", "photo": "p.jpg", "text": ""},
        {"id": 5, "type": "message", "from": None, "date_unixtime": "x", "text": {"text": " solo "}},
    ]}
    (tmp_path / "result.json").write_text(json.dumps({"chats": {"list": [chat]}} if whole else chat))
    def mid(i):
        return uuid5_like(f"telegram:77:{i}")

    df = T.read_messenger_export(spark, str(tmp_path))
    assert turns(df) == [
        (mid(2), None, "Bo: see https://a.b!", at(2023, 11, 14, 22, 13, 20)),
        (mid(3), mid(2), "Cy: yes", at(2023, 11, 14, 22, 14, 20)),
        (mid(5), None, "unknown: solo", None),
    ]


def test_chat_text_both_layouts(spark, tmp_path):
    lrm = chr(0x200E)
    bracketed = (f"preamble\r\n{lrm}[1/31/24, 9:05:07{chr(0x202F)}PM] Ann: {lrm}Messages and calls are end-to-end encrypted. x\r\n"
                 "[1/31/24, 9:06:00 PM] Ann: first: line\r\nsecond line\r\n\r\nthird\r\n"
                 f"[2/1/24, 12:00:00 AM] Bo: {lrm}image omitted\r\n[2/1/24, 12:01:00 AM] Bo added you\r\n"
                 "[2/1/24, 12:02:00 AM] Bo: bye\r\n")
    dashed = "31/12/2023, 23:59 - Messages are secret\n31/12/2023, 23:59 - Cy: old year\n01/01/2024, 00:00 - Cy: <Media omitted>\n"
    (tmp_path / "a.txt").write_text(bracketed, newline="")
    (tmp_path / "b.txt").write_text(dashed)
    df = T.read_chat_text(spark, str(tmp_path))
    first = f"whatsapp:[1/31/24, 9:05:07{chr(0x202F)}PM] Ann: Messages and calls are end-to-end encrypted. x"
    second = "whatsapp:31/12/2023, 23:59 - Messages are secret"
    expected = {
        (uuid5_like(first), uuid5_like(f"{first}:1"), "Ann: first: line\nsecond line\nthird", at(2024, 1, 31, 21, 6)),
        (uuid5_like(first), uuid5_like(f"{first}:4"), "Bo: bye", at(2024, 1, 2, 0, 2)),
        (uuid5_like(second), uuid5_like(f"{second}:1"), "Cy: old year", at(2023, 12, 31, 23, 59)),
    }
    assert {(r["conversation_id"], r["memory_id"], r["text"], r["created_at"]) for r in df.collect()} == expected


def test_kv_sessions(spark):
    data = [
        ("composerData:s1", {"composerId": "s1", "createdAt": 1700000000000,
                             "fullConversationHeadersOnly": [{"bubbleId": "b1", "type": 1}, {"bubbleId": "b2", "type": 2},
                                                             {"bubbleId": "gone"}, {"bubbleId": "b3", "type": 2}]}),
        ("composerData:s2", {"composerId": "s2", "fullConversationHeadersOnly": [{"bubbleId": "b1"}]}),
        ("bubbleId:s1:b1", {"text": " hi ", "type": 1}),
        ("bubbleId:s1:b2", {"text": "yo"}),
        ("bubbleId:s1:b3", {"text": "  ", "type": 2}),
        ("bubbleId:s2:b1", {"text": "other", "type": 2}),
        ("bubbleId:s9:b1", {"text": "orphan", "type": 2}),
    ]
    kv = spark.createDataFrame([(k, json.dumps(v)) for k, v in data] + [("composerData:bad", "{")], "key string, value string")
    df = T.kv_sessions_turns(kv)
    assert sorted((r["conversation_id"], r["memory_id"], r["turn_index"], r["text"], r["fallback_at"]) for r in df.collect()
                  if r["fallback_at"]) == sorted([
        (uuid5_like("cursor:s1"), uuid5_like("cursor:s1:b1"), 0, "USER: hi", at(2023, 11, 14, 22, 13, 20)),
        (uuid5_like("cursor:s1"), uuid5_like("cursor:s1:b2"), 1, "ASSISTANT: yo", at(2023, 11, 14, 22, 13, 20))])
    assert [r["text"] for r in df.collect() if r["fallback_at"] is None] == ["ASSISTANT: other"]


def test_parts_sessions(spark):
    session = spark.createDataFrame([("s1", "t", 1), ("s2", "t", 2)], "id string, title string, time_created bigint")
    message = spark.createDataFrame([
        ("m2", "s1", 2000, '{"role":"assistant"}'), ("m1", "s1", 1000, '{"role":"user"}'), ("m3", "s1", 3000, '{"role":"tool"}'),
        ("m4", "s2", 4000, '{"role":"user"}'), ("m5", "sX", 5000, '{"role":"user"}'), ("m6", "s2", 6000, "{")],
        "id string, session_id string, time_created bigint, data string")
    part = spark.createDataFrame([
        ("p2", "m1", "s1", 20, '{"type":"text","text":" second "}'), ("p1", "m1", "s1", 10, '{"type":"text","text":"first"}'),
        ("p3", "m2", "s1", 30, '{"type":"tool","text":"call"}'), ("p4", "m2", "s1", 40, '{"type":"text","text":"done"}'),
        ("p5", "m4", "s2", 50, '{"type":"text","text":"   "}'), ("p6", "m5", "sX", 60, '{"type":"text","text":"lost"}')],
        "id string, message_id string, session_id string, time_created bigint, data string")
    df = T.parts_sessions_turns(session, message, part)
    assert turns(df) == [
        (uuid5_like("opencode:m1"), None, "USER: first\nsecond", at(1970, 1, 1, 0, 0, 1)),
        (uuid5_like("opencode:m2"), None, "ASSISTANT: done", at(1970, 1, 1, 0, 0, 2))]


def test_session_time_falls_back(spark):
    schema = ("conversation_id string, memory_id string, turn_index bigint, created_at timestamp, fallback_at timestamp")
    df = spark.createDataFrame([("a", "1", 0, None, at(2020, 1, 1)), ("a", "2", 1, at(2021, 1, 1), at(2020, 1, 1)),
                                ("a", "3", 2, at(2019, 1, 1), None), ("b", "4", 0, None, at(2018, 1, 1))], schema)
    got = {r["memory_id"]: r["session_at"] for r in T.assemble_sessions(df).collect()}
    assert got == {"1": at(2021, 1, 1), "2": at(2021, 1, 1), "3": at(2021, 1, 1), "4": at(2018, 1, 1)}


def test_routing_and_listing(spark, tmp_path):
    names = {
        "conversations.json": "chatgpt", "result.json": "telegram", "chan/2024-01-15.json": "slack", "users.json": None,
        "state.vscdb": "cursor", "opencode.db": "opencode", "chat.txt": "whatsapp", "notes.txt": None, ".hidden.json": None,
        "a/b/conversations.json": None, ".git/x.json": None,
    }
    for name in names:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x\n[1/2/24, 3:04 PM] Ann: hi\n" if name == "chat.txt" else "plain\n")
    got = {r["path"].split(tmp_path.name + "/", 1)[1]: r["source"] for r in routing.route_tree(spark, str(tmp_path)).collect()}
    shallow = {n: s for n, s in names.items() if n.count("/") < 2 and not any(p.startswith(".") for p in n.split("/"))}
    assert got == shallow
    paths = spark.createDataFrame([
        ("/home/u/.claude/projects/p/x.jsonl",), ("/tmp/x.jsonl",), ("/s/agents/a/sessions/x.jsonl",),
        ("/s/agents/a/sessions/x.trajectory.jsonl",)], "path string")
    assert [r["source"] for r in routing.route_files(paths).collect()] == ["claude-code", None, "openclaw", None]


def test_questions_and_checkpoint(spark, tmp_path):
    question = {"question_id": "q1", "question_type": "multi-session", "question": "what?", "answer": "that",
                "question_date": "2023/05/01", "haystack_session_ids": ["s1", "s2"], "haystack_dates": ["d1", "d2"],
                "haystack_sessions": [[{"role": "user", "content": "a", "has_answer": True}], [{"role": "assistant", "content": "b"}]],
                "answer_session_ids": ["s2"]}
    (tmp_path / "q.json").write_text(json.dumps([question]))
    questions, haystack, truth = read_questions(spark, str(tmp_path / "q.json"))
    assert questions.first()["answer"] == "that"
    assert [(r["session_id"], r["date"], r["turns"][0]["content"]) for r in haystack.orderBy("place").collect()] == [
        ("s1", "d1", "a"), ("s2", "d2", "b")]
    assert [tuple(r) for r in truth.collect()] == [("q1", "s2")]
    lines = [{"question_id": "q1", "judge_label": False}, {"question_id": "q2", "judge_label": True},
             {"question_id": "q1", "judge_label": True, "hypothesis": "h"}, {"question_id": ""}]
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(x) for x in lines) + '\n{"question_id": "q3", "jud')
    got = {r["question_id"]: (r["judge_label"], r["hypothesis"]) for r in read_checkpoint(spark, str(tmp_path / "c.jsonl")).collect()}
    assert got == {"q1": (True, "h"), "q2": (True, None)}


def test_a_tree_is_imported_in_one_call(spark, tmp_path):
    from anamnesis.plans.tree import import_tree

    root = tmp_path / "tree"
    (root / "talk").mkdir(parents=True)
    (root / "chat.txt").write_text("[01/02/24, 10:00:00] Ann: hello there\n[01/02/24, 10:01:00] Bob: hi")
    (root / "_chat.txt").write_text("[01/02/24, 10:00:00] Ann: unseen")
    (root / "notes.md").write_text("nothing")
    (root / "talk" / "2024-01-15.json").write_text(json.dumps([{"type": "message", "user": "U1", "text": "one", "ts": "1705312800.1"}]))
    stored = spark.createDataFrame([], "memory_id string")
    done = import_tree(spark, str(root), stored, F.to_timestamp(F.lit("2025-01-01")), ["mine"])
    assert {(r.path.rsplit("/", 1)[1], r.status) for r in done.files.collect()} == {
        ("chat.txt", "imported"), ("_chat.txt", "hidden"), ("notes.md", "unclaimed"), ("2024-01-15.json", "imported")}
    assert sorted(r.text for r in done.change.memories.collect()) == ["Ann: hello there", "Bob: hi", "U1: one"]
    assert done.rejects.count() == 0
    dry = import_tree(spark, str(root), stored, F.current_timestamp(), dry_run=True)
    assert dry.change is None and sum(r.turns for r in dry.preview.collect()) == 3
