"""Chat transcripts of eight export layouts, each read into the same `turns` rows.

turns: source, conversation_id, memory_id, parent_id, turn_index, text, created_at, tags,
fallback_at (the conversation's own time, used where no turn has one).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.functions.blocks import join_text_blocks, join_text_runs, variant_list, variant_string
from anamnesis.functions.core import is_blank, is_row, numbered_rows_of, rows_of, trim_space
from anamnesis.functions.ids import is_valid_id, to_uuid
from anamnesis.functions.text import accept_role, clean_markup, role_line, speaker_name, strip_marks, turn_line
from anamnesis.functions.times import (
    from_epoch_ms,
    from_epoch_seconds,
    from_iso,
    parse_chat_timestamp,
)
from anamnesis.operators.sizing import attach
from anamnesis.sources.lines import base_name, parent_name, read_lines, running_count

TURN_COLUMNS = ["source", "conversation_id", "memory_id", "parent_id", "turn_index", "text", "created_at",
                "tags", "fallback_at"]

# The name each layout writes into its `source:` tag.
CHAT_TREE = "chatgpt"
SESSION_JSONL = "claude-code"
AGENT_JSONL = "openclaw"
CHANNEL_EXPORT = "slack"
MESSENGER_EXPORT = "telegram"
CHAT_TEXT = "whatsapp"
KV_SESSIONS = "cursor"
PARTS_SESSIONS = "opencode"

# Lines of a plain-text chat export.
LINE_DATE = r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}"
LINE_TIME = r"\d{1,2}:\d{2}(?::\d{2})?(?:[\s\u202f]?[APap][Mm])?"
BRACKETED_LINE = rf"(?s)^\[({LINE_DATE}),\s*({LINE_TIME})\]\s*(.*)$"
DASHED_LINE = rf"(?s)^({LINE_DATE}),\s*({LINE_TIME})\s-\s(.*)$"
ENCRYPTION_BANNER = r"(?i)^messages and calls are end-to-end encrypted"
MEDIA_PLACEHOLDER = r"(?i)^(<media omitted>|(image|video|audio|gif|sticker|document|contact card) omitted)$"


def as_turns(rows: DataFrame, source: str) -> DataFrame:
    """Complete a reader's rows to the common schema."""
    fixed = {"source": F.lit(source), "tags": F.array(F.lit(f"source:{source}"))}
    missing = {"parent_id": "string", "created_at": "timestamp", "fallback_at": "timestamp"}
    columns = []
    for name in TURN_COLUMNS:
        if name in fixed:
            column = fixed[name]
        elif name in rows.columns:
            column = F.col(name)
        else:
            column = F.lit(None).cast(missing[name])
        columns.append((column.cast("bigint") if name == "turn_index" else column).alias(name))
    return rows.select(*columns)


def read_json(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """One row per top-level array element (or per object file); a bad file gives a reject row."""
    paths = [path] if isinstance(path, str) else list(path)
    return (spark.read.option("multiLine", True).option("recursiveFileLookup", True)
            .schema(f"{schema}, _corrupt_record string").json(paths)
            .withColumn("path", F.col("_metadata.file_path")))


def json_rejects(rows: DataFrame) -> DataFrame:
    """(path, content) of files that are not JSON; none of their fields could be read."""
    unread = F.col("_corrupt_record").isNotNull() & F.col(rows.columns[0]).isNull()
    return rows.where(unread).select("path", F.col("_corrupt_record").alias("content"))


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines as VARIANT; a line that does not parse has a null record."""
    return lines.where(~is_blank("line")).withColumn("record", F.try_parse_json("line"))


def line_rejects(lines: DataFrame) -> DataFrame:
    """(path, line_no, content) of lines that are not JSON."""
    numbered = running_count(lines, F.lit(True), "line_no")
    return (parsed_lines(numbered).where(F.col("record").isNull())
            .select("path", "line_no", F.col("line").alias("content")))


def variant_number(value: Column, path: str) -> Column:
    """The number at `path`; strings and other types give null."""
    at = F.try_variant_get(value, path, "variant")
    kind = F.schema_of_variant(at)
    numeric = kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE") | kind.startswith("FLOAT")
    return F.when(numeric, F.try_variant_get(value, path, "double"))


def variant_text(value: Column, path: str) -> Column:
    """The scalar at `path` as text, null when absent."""
    return F.try_variant_get(value, path, "string")


def nonempty(value: Column) -> Column:
    return F.when(value != "", value)


# --- chat tree --------------------------------------------------------------------------------

def read_chat_tree(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Conversations whose messages form a node tree. Each conversation is one row of JSON, so
    its nodes are ordered inside that row and nothing is shuffled."""
    rows = read_json(spark, path, "conversation_id variant, id variant, create_time double, "
                                  "mapping map<string,variant>")
    rows = rows.where(F.col("mapping").isNotNull())

    def node(entry: Column, position: Column) -> Column:
        value = entry["value"]
        time = variant_number(value, "$.message.create_time")
        parts = variant_list(value, "$.message.content.parts")
        joined = trim_space(F.array_join(F.filter(F.transform(parts, lambda p: variant_string(p)), lambda s: s.isNotNull()), "\n"))
        whole = trim_space(variant_string(value, "$.message.content.parts"))
        plain = trim_space(variant_string(value, "$.message.content.text"))
        has_message = F.coalesce(
            F.schema_of_variant(F.try_variant_get(value, "$.message", "variant")) != "VOID", F.lit(False))
        return F.struct(
            F.coalesce(time, F.lit(0.0)).alias("sort_time"), position.alias("position"),
            variant_text(value, "$.id").alias("id"), nonempty(variant_string(value, "$.parent")).alias("parent"),
            accept_role(variant_string(value, "$.message.author.role")).alias("role"),
            F.coalesce(whole, nonempty(joined), plain, F.lit("")).alias("text"),
            time.alias("time"), has_message.alias("has_message"),
            F.coalesce(F.try_variant_get(value, "$.message.metadata.is_visually_hidden_from_conversation", "boolean"),
                       F.lit(False)).alias("hidden"))

    nodes = F.array_sort(F.transform(F.map_entries("mapping"), node))
    kept = F.filter(nodes, lambda n: n["has_message"] & n["role"].isNotNull() & ~n["hidden"] & (n["text"] != ""))
    seed = F.coalesce(nonempty(F.coalesce(variant_string(F.col("conversation_id")),
                                          F.when(F.col("conversation_id").isNull(), variant_string(F.col("id"))))),
                      F.to_json("mapping"))
    turns = rows.select(to_uuid(seed).alias("conversation_id"),
                        from_epoch_seconds("create_time").alias("fallback_at"),
                        numbered_rows_of(kept, "turn_index", "n")).where(is_row("n"))
    return as_turns(turns.select(
        "conversation_id", "turn_index", "fallback_at",
        to_uuid("n.id").alias("memory_id"), to_uuid("n.parent").alias("parent_id"),
        role_line("n.role", "n.text").alias("text"), from_epoch_seconds("n.time").alias("created_at")), CHAT_TREE)


# --- line-delimited sessions ------------------------------------------------------------------

def read_session_jsonl(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return session_jsonl_turns(read_lines(spark, path))


def session_jsonl_turns(lines: DataFrame) -> DataFrame:
    """One file per conversation, named by its id; ids are native."""
    named = lines.withColumn("conversation_id", base_name("path", r"\.jsonl$")).where(is_valid_id("conversation_id"))
    indexed = running_count(named, F.lit(True), "turn_index")
    r = F.col("record")
    fields = parsed_lines(indexed).select(
        "conversation_id", "turn_index",
        variant_string(r, "$.type").alias("role"), variant_string(r, "$.uuid").alias("memory_id"),
        variant_string(r, "$.parentUuid").alias("parent"), variant_string(r, "$.timestamp").alias("time"),
        F.coalesce(F.try_variant_get(r, "$.isSidechain", "boolean"), F.lit(False)).alias("side"),
        join_text_blocks(F.try_variant_get(r, "$.message.content", "variant")).alias("body"))
    kept = fields.where(~F.col("side") & F.col("role").isin("user", "assistant")
                        & is_valid_id("memory_id") & (F.col("body") != ""))
    return as_turns(kept.select(
        "conversation_id", "memory_id", "turn_index", F.when(is_valid_id("parent"), F.col("parent")).alias("parent_id"),
        role_line("role", "body").alias("text"), from_iso("time").alias("created_at")), SESSION_JSONL)


def read_agent_jsonl(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return agent_jsonl_turns(read_lines(spark, path))


def agent_jsonl_turns(lines: DataFrame) -> DataFrame:
    """Agent transcripts: ids are hashed, and a record without one is named by its place among
    the records that parsed."""
    chat = lines.where(~F.lower(base_name("path")).endswith(".trajectory.jsonl"))
    chat = chat.withColumn("conversation_id", to_uuid(base_name("path", r"\.jsonl$")))
    indexed = running_count(parsed_lines(chat).where(F.col("record").isNotNull()), F.lit(True), "ordinal")
    r = F.col("record")
    direct = variant_string(r, "$.message.text")
    fields = indexed.select(
        "conversation_id", (F.col("ordinal") - 1).alias("turn_index"),
        F.coalesce(variant_string(r, "$.type"), F.lit("")).alias("kind"),
        accept_role(variant_string(r, "$.message.role")).alias("role"),
        F.coalesce(trim_space(direct), join_text_blocks(F.try_variant_get(r, "$.message.content", "variant")))
        .alias("body"),
        nonempty(variant_string(r, "$.id")).alias("id"), nonempty(variant_string(r, "$.parentId")).alias("parent"),
        F.coalesce(from_iso(variant_string(r, "$.timestamp")), from_epoch_ms(variant_number(r, "$.timestamp")))
        .alias("created_at"))
    kept = fields.where(~F.col("kind").isin("session", "compaction") & F.col("role").isNotNull() & (F.col("body") != ""))
    own = F.concat_ws(":", "conversation_id", F.col("turn_index").cast("string"))
    return as_turns(kept.select(
        "conversation_id", "turn_index", to_uuid(F.coalesce("id", own)).alias("memory_id"),
        to_uuid("parent").alias("parent_id"), role_line("role", "body").alias("text"), "created_at"), AGENT_JSONL)


# --- exports with one document per channel or account -------------------------------------------

def read_channel_export(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Day files under one directory per channel; replies point at their thread's first message.

    A turn is placed by its own timestamp, which is unique in a channel and orders it across
    day files, so no file or channel has to be numbered.
    """
    rows = read_json(spark, path, "type variant, subtype variant, user variant, text variant, ts variant, "
                                  "thread_ts variant, user_profile variant")
    def text_of(name: str) -> Column:
        return variant_string(F.col(name))

    profile = F.col("user_profile")
    fields = rows.select(
        parent_name("path").alias("channel"), text_of("type").alias("type"),
        F.coalesce(text_of("subtype"), F.lit("")).alias("subtype"), text_of("user").alias("user"),
        text_of("text").alias("body"), text_of("ts").alias("ts"), text_of("thread_ts").alias("thread"),
        *[variant_string(profile, f"$.{f}").alias(f) for f in ("display_name", "real_name", "name")])
    kept = fields.where((F.col("type") == "message") & (F.col("subtype") == "") & (F.col("user") != "")
                        & ~is_blank("body") & (F.col("ts") != ""))

    def message_id(ts: str) -> Column:
        return to_uuid(F.concat_ws(":", "channel", ts))

    seconds = F.regexp_extract("ts", r"^\s*(\d+(?:\.\d+)?)", 1)
    return as_turns(kept.select(
        to_uuid(F.concat(F.lit("slack:"), "channel")).alias("conversation_id"),
        message_id("ts").alias("memory_id"),
        F.when(F.col("thread").isNotNull() & (F.col("thread") != "") & (F.col("thread") != F.col("ts")),
               message_id("thread")).alias("parent_id"),
        F.floor(seconds.try_cast("decimal(20,6)") * 1_000_000).cast("bigint").alias("turn_index"),
        turn_line(speaker_name(F.col("display_name"), F.col("real_name"), F.col("name"), F.col("user")),
                  clean_markup("body")).alias("text"),
        from_epoch_seconds(seconds).alias("created_at")), CHANNEL_EXPORT)


def read_messenger_export(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A full-account export nests chats; a single-chat export is the chat itself."""
    rows = read_json(spark, path, "chats struct<list: array<variant>>, id variant, name variant, "
                                  "messages array<variant>")
    whole = F.struct(
        F.coalesce(F.col("id").try_cast("string"), F.col("name").try_cast("string")).alias("key"),
        F.col("messages").alias("messages"))
    nested = F.transform("chats.list", lambda c: F.struct(
        F.coalesce(variant_text(c, "$.id"), variant_text(c, "$.name")).alias("key"),
        variant_list(c, "$.messages").alias("messages")))
    chats = rows.select(rows_of(F.coalesce(nested, F.array(whole)), "c")).where(is_row("c"))
    messages = chats.select(
        F.concat(F.lit("telegram:"), F.coalesce("c.key", F.lit("chat"))).alias("chat"),
        F.posexplode("c.messages").alias("turn_index", "m"))
    m = F.col("m")
    fields = messages.select(
        "chat", "turn_index", variant_string(m, "$.type").alias("type"),
        F.coalesce(variant_text(m, "$.id"), F.lit("undefined")).alias("id"),
        join_text_runs(F.try_variant_get(m, "$.text", "variant")).alias("body"),
        variant_text(m, "$.date_unixtime").alias("time"), nonempty(variant_string(m, "$.from")).alias("sender"),
        variant_text(m, "$.reply_to_message_id").alias("reply"))
    kept = fields.where((F.col("type") == "message") & (F.col("body") != ""))
    return as_turns(kept.select(
        to_uuid("chat").alias("conversation_id"), to_uuid(F.concat_ws(":", "chat", "id")).alias("memory_id"),
        F.when(F.col("reply").isNotNull(), to_uuid(F.concat_ws(":", "chat", "reply"))).alias("parent_id"),
        "turn_index", turn_line(F.coalesce("sender", F.lit("unknown")), "body").alias("text"),
        from_epoch_seconds("time").alias("created_at")), MESSENGER_EXPORT)


# --- plain-text chats ---------------------------------------------------------------------------

def read_chat_text(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return chat_text_turns(read_lines(spark, path))


def _chat_line(line: Column) -> Column:
    """(date, time, rest) of a line that starts a message, else null."""
    def parts(pattern: str) -> Column:
        return F.when(line.rlike(pattern), F.struct(*[
            F.regexp_extract(line, pattern, g).alias(n) for g, n in ((1, "date"), (2, "time"), (3, "rest"))]))

    return F.coalesce(parts(BRACKETED_LINE), parts(DASHED_LINE))


def chat_text_turns(lines: DataFrame) -> DataFrame:
    """Messages start with a date; other lines continue the message above.

    The place of a message counts every message start of its file, including those dropped
    later. The conversation is named by its first message line.
    """
    clean = lines.withColumn("line", strip_marks("line")).where(F.col("line") != "")
    marked = clean.withColumn("start", _chat_line(F.col("line")))
    numbered = running_count(marked, F.col("start").isNotNull(), "message").where("message > 0")
    seeds = (numbered.where((F.col("message") == 1) & F.col("start").isNotNull())
             .select("path", F.concat(F.lit("whatsapp:"), "line").alias("seed")))
    # A message is a start line and its few continuation lines: a small group by construction.
    folded = numbered.groupBy("path", "message").agg(
        F.max("start").alias("start"),
        F.array_sort(F.collect_list(F.when(F.col("start").isNull(), F.struct("block", "pos", "line")))).alias("more"))
    rest = F.col("start.rest")
    colon = F.locate(": ", rest)
    body = F.array_join(F.concat(F.array(F.substring(rest, colon + 2, F.char_length(rest))), F.col("more.line")), "\n")
    fields = attach(folded, seeds, "path", computed=True).where(colon > 0).select(
        "seed", (F.col("message") - 1).alias("turn_index"),
        trim_space(F.substring(rest, F.lit(1), colon - 1)).alias("sender"), trim_space(body).alias("body"),
        parse_chat_timestamp(F.col("start.date"), F.col("start.time")).alias("created_at"))
    kept = fields.where((F.col("sender") != "") & (F.col("body") != "")
                        & ~F.col("body").rlike(ENCRYPTION_BANNER) & ~F.col("body").rlike(MEDIA_PLACEHOLDER))
    return as_turns(kept.select(
        to_uuid("seed").alias("conversation_id"),
        to_uuid(F.concat_ws(":", "seed", F.col("turn_index").cast("string"))).alias("memory_id"),
        "turn_index", turn_line("sender", "body").alias("text"), "created_at"), CHAT_TEXT)


# --- exported application tables ----------------------------------------------------------------

def kv_sessions_turns(kv: DataFrame) -> DataFrame:
    """Key/value rows: a session header lists message keys in order; each is looked up.

    The lookup key holds session and message id, so the join keys are unique and even.
    """
    value = F.try_parse_json("value")
    headers = kv.where(F.col("key").startswith("composerData:")).select(value.alias("v")).select(
        nonempty(variant_string(F.col("v"), "$.composerId")).alias("session"),
        variant_number(F.col("v"), "$.createdAt").alias("created"),
        numbered_rows_of(variant_list(F.col("v"), "$.fullConversationHeadersOnly"), "turn_index", "h")).where(is_row("h"))
    asked = headers.select(
        "session", "created", "turn_index", variant_string(F.col("h"), "$.bubbleId").alias("bubble"),
        variant_number(F.col("h"), "$.type").alias("header_type")).where("session IS NOT NULL AND bubble IS NOT NULL")
    asked = asked.withColumn("key", F.concat(F.lit("bubbleId:"), "session", F.lit(":"), "bubble"))
    bubbles = kv.where(F.col("key").startswith("bubbleId:")).select("key", value.alias("b")).select(
        "key", trim_space(variant_string(F.col("b"), "$.text")).alias("body"),
        variant_number(F.col("b"), "$.type").alias("type"))
    found = asked.join(bubbles, "key").where(F.col("body") != "")
    role = F.when(F.coalesce("type", "header_type") == 2, "assistant").otherwise("user")
    name = F.concat(F.lit("cursor:"), "session")
    return as_turns(found.select(
        to_uuid(name).alias("conversation_id"), to_uuid(F.concat_ws(":", name, "bubble")).alias("memory_id"),
        "turn_index", role_line(role, "body").alias("text"), from_epoch_ms("created").alias("fallback_at")), KV_SESSIONS)


def parts_sessions_turns(session: DataFrame, message: DataFrame, part: DataFrame) -> DataFrame:
    """Sessions, messages and message parts as three tables. A turn is placed by its time and id."""
    piece = F.try_parse_json("data")
    texts = part.select("message_id", F.struct("time_created", "id").alias("at"), piece.alias("p")).select(
        "message_id", "at", trim_space(F.when(variant_string(F.col("p"), "$.type") == "text",
                                              variant_string(F.col("p"), "$.text"))).alias("t")).where(F.col("t") != "")
    bodies = texts.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("at", "t"))).alias("ps")).select(
        "message_id", F.array_join("ps.t", "\n").alias("body"))
    rows = (attach(message.select(F.col("id").alias("message_id"), "session_id", "time_created",
                                  accept_role(variant_string(piece, "$.role")).alias("role")).where("role IS NOT NULL"),
                   session.select(F.col("id").alias("session_id")), "session_id", "left_semi")
            .join(bodies, "message_id"))
    return as_turns(rows.select(
        to_uuid(F.concat(F.lit("opencode:"), "session_id")).alias("conversation_id"),
        to_uuid(F.concat(F.lit("opencode:"), "message_id")).alias("memory_id"),
        F.col("time_created").cast("bigint").alias("turn_index"),
        role_line("role", "body").alias("text"), from_epoch_ms("time_created").alias("created_at")), PARTS_SESSIONS)


# --- sessions and registry ----------------------------------------------------------------------

def assemble_sessions(turns: DataFrame) -> DataFrame:
    """Add `session_at`: the first turn time in order, else the conversation's own time."""
    sessions = turns.groupBy("conversation_id").agg(
        F.coalesce(F.min_by(F.col("created_at"), F.when(F.col("created_at").isNotNull(),
                                                        F.struct("turn_index", "memory_id"))),
                   F.max("fallback_at")).alias("session_at"))
    return attach(turns, sessions, "conversation_id", computed=True)


FILE_READERS: dict[str, Callable[..., DataFrame]] = {
    CHAT_TREE: read_chat_tree,
    SESSION_JSONL: read_session_jsonl,
    AGENT_JSONL: read_agent_jsonl,
    CHANNEL_EXPORT: read_channel_export,
    MESSENGER_EXPORT: read_messenger_export,
    CHAT_TEXT: read_chat_text,
}

TABLE_READERS: dict[str, Callable[..., DataFrame]] = {
    KV_SESSIONS: kv_sessions_turns,
    PARTS_SESSIONS: parts_sessions_turns,
}

