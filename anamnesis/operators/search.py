"""Exhaustive literal and regex search of a table of patterns, a block of them in one scan of the texts."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.constants import (
    MIN_LITERAL_LENGTH,
    SNIPPET_CONTEXT,
    SNIPPETS_PER_MEMORY,
    SNIPPETS_PER_PATTERN,
)
from anamnesis.functions import linear_regex, many_literals
from anamnesis.functions import matching as M
from anamnesis.functions.core import is_row, rows_of
from anamnesis.functions.grams import listed
from anamnesis.functions.text import ascii_lower, trigrams
from anamnesis.operators.kernels import PatternCounts
from anamnesis.operators.ranking import top_k
from anamnesis.operators.sizing import attach, fits_broadcast, measure, salt_of, salted_join


#: A block of patterns that are tried in one scan of the texts.
BLOCK_PATTERNS = 10_000
BLOCK_BYTES = 16 * 1024 * 1024


@dataclass(frozen=True)
class Pattern:
    pattern_id: str
    pattern: str
    regex: bool = False
    ignore_case: bool = True
    context_chars: int = SNIPPET_CONTEXT


def pattern_blocks(patterns: DataFrame, rows: int = BLOCK_PATTERNS, most_bytes: int = BLOCK_BYTES) -> Iterator[list[Pattern]]:
    """The search requests in blocks of bounded size, each of which becomes one value of a plan."""
    columns = [c for c in ("pattern_id", "pattern", "regex", "ignore_case", "context_chars") if c in patterns.columns]
    asked = patterns.select(*columns)
    count, size = measure(asked)
    blocks = max(1, math.ceil(count / rows), math.ceil(size / most_bytes))
    for block in range(blocks):
        part = asked.where(salt_of(["pattern_id"], blocks) == block)
        yield sorted((Pattern(**r.asDict()) for r in part.toLocalIterator()), key=lambda p: p.pattern_id)


def regex_problem(pattern: Pattern) -> str | None:
    """Why a regular expression is refused, or None: whatever the linear-time engine cannot run."""
    return linear_regex.problem(pattern.pattern)


def classify(patterns: Sequence[Pattern]) -> dict[str, str | None]:
    """Status of each pattern that can be told before any text is read; None means searchable."""
    status: dict[str, str | None] = {}
    for p in patterns:
        if p.pattern == "":
            status[p.pattern_id] = "empty-query"
        elif not p.regex and len(p.pattern) < MIN_LITERAL_LENGTH:
            status[p.pattern_id] = "short-query"
        elif p.regex and regex_problem(p):
            status[p.pattern_id] = "bad-regex"
        else:
            status[p.pattern_id] = None
    return status


REQUEST = "pattern_id: string, fold: boolean, needle: string, java: string, context: int, regex: boolean"


def request_rows(patterns: Sequence[Pattern]) -> list[dict]:
    """Searchable patterns: what to look for, and for literals the Java expression that frames it."""
    rows = []
    for p in patterns:
        needle = p.pattern if p.regex or not p.ignore_case else M.fold(p.pattern)
        rows.append({"pattern_id": p.pattern_id, "fold": p.ignore_case, "needle": needle,
                     "java": None if p.regex else M.quote_literal(needle), "context": p.context_chars, "regex": p.regex})
    return rows


def find_hits(memories: DataFrame, patterns: Sequence[Pattern], candidates: DataFrame | None = None) -> DataFrame:
    """(pattern_id, memory_id, updated_at, matches), one row per pattern and matching memory.

    The patterns are one value of the plan. Every text is walked once, in Arrow batches, for all
    literals, and once for all expressions; only matching pairs leave the task. `candidates`
    (memory_id, pattern_ids) limits which patterns are tried on which memory; both sides of that
    join hold a memory_id once, so it is even.
    """
    rows = memories.select("memory_id", "updated_at", "text")
    if candidates is not None:
        rows = rows.join(candidates, "memory_id").select("memory_id", "updated_at", "text", "pattern_ids")
    schema = f"pattern_id string, memory_id string, updated_at {rows.schema['updated_at'].dataType.simpleString()}, matches bigint"
    parts = []
    for module, asked in ((many_literals, [p for p in patterns if not p.regex]), (linear_regex, [p for p in patterns if p.regex])):
        if asked:
            given = [(p.pattern_id, p.pattern, p.ignore_case) for p in asked]
            parts.append(rows.mapInArrow(module.hits_of(given, candidates is not None), schema))
    if not parts:
        return memories.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def trigram_index(memories: DataFrame) -> DataFrame:
    """(trigram, memory_id), distinct by construction. Texts are cut in Arrow batches, piece by piece."""
    kind = memories.schema["memory_id"].dataType.simpleString()
    grams = memories.select("memory_id", F.col("text").cast("string").alias("text")).mapInArrow(
        listed, f"memory_id {kind}, grams array<string>")
    return grams.select(rows_of(F.col("grams"), "trigram"), "memory_id").where(is_row("trigram"))


def trigram_join(patterns: DataFrame, index: DataFrame) -> DataFrame:
    """(pattern_id, memory_id) of memories that hold every trigram of a literal pattern.

    A trigram that occurs nowhere leaves the pattern without candidates. The pattern side, once measured small,
    goes to every task: trigrams become numbers, what a memory holds of them meets in one task as lists of numbers, and
    its patterns are counted there, so no row is made per pattern, trigram and memory. A larger side is joined
    on salted trigrams; the count is keyed by (pattern, memory), which is even.
    """
    wanted = patterns.select("pattern_id", F.explode(trigrams("pattern")).alias("trigram"))
    if fits_broadcast(wanted):
        return _count_in_tasks(wanted, index)
    needed = wanted.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("needed"))
    counted = salted_join(index, wanted, ["trigram"]).groupBy("pattern_id", "memory_id").agg(F.count(F.lit(1)).alias("held"))
    return (attach(counted, needed, "pattern_id").where(F.col("held") == F.col("needed"))
            .select("pattern_id", "memory_id"))


def _count_in_tasks(wanted: DataFrame, index: DataFrame) -> DataFrame:
    spark = index.sparkSession
    asked = wanted.where("pattern_id IS NOT NULL").toArrow()
    ids, names = (asked[c].combine_chunks().dictionary_encode() for c in ("pattern_id", "trigram"))
    numbers = spark.createDataFrame(pa.table({"trigram": names.dictionary.cast(pa.string()),
                                              "number": pa.array(np.arange(len(names.dictionary)), pa.int32())}))
    shared = spark.sparkContext.broadcast((ids.dictionary, *(
        c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in (ids, names))))
    kinds = {"pattern_id": wanted.schema["pattern_id"].dataType.simpleString(), "memory_id": index.schema["memory_id"].dataType.simpleString()}

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern_ids, pattern_rows, number_rows = shared.value
        counts = PatternCounts(pattern_rows, number_rows)
        for part in whole_groups(batches):
            starts = run_starts(part.column(0))
            firsts, ends = np.append(starts, part.num_rows), pc.list_value_length(part.column(1)).to_numpy().astype(np.int64)
            memory = np.repeat(np.repeat(np.arange(len(starts)), np.diff(firsts)), ends)
            for found, pattern in counts.complete(memory, part.column(1).flatten().to_numpy().astype(np.int64), len(starts)):
                yield pa.RecordBatch.from_arrays(
                    [pattern_ids.take(pa.array(pattern)), part.column(0).take(pa.array(starts[found]))], ["pattern_id", "memory_id"])

    held = index.join(F.broadcast(numbers), "trigram").select("memory_id", "number").mapInArrow(
        runs, f"memory_id {kinds['memory_id']}, numbers array<int>")
    return held.repartition("memory_id").sortWithinPartitions("memory_id").mapInArrow(
        complete, f"pattern_id {kinds['pattern_id']}, memory_id {kinds['memory_id']}")


def run_starts(ids: pa.Array) -> np.ndarray:
    """Where each run of equal ids begins; nulls are equal."""
    if not len(ids):
        return np.zeros(0, np.int64)
    codes = pc.fill_null(ids.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(memory_id, number) to (memory_id, numbers): a list for each run of one id in a batch."""
    for batch in batches:
        starts = run_starts(batch.column(0))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, batch.num_rows), pa.int32()), batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts)), lists], ["memory_id", "numbers"])


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first column, in batches that part no id from its rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(run_starts(batch.column(0))[-1])  # the last id may go on in the next batch
        if held and (last or held[-1].column(0)[-1] != batch.column(0)[0]):
            yield from _one(held + [batch.slice(0, last)])
            held = []
        elif last:
            yield batch.slice(0, last)
        held.append(batch.slice(last))
    yield from _one(held)


def _one(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if parts:
        table = pa.Table.from_batches(parts).combine_chunks()
        yield from table.to_batches()


def search_totals(hits: DataFrame) -> DataFrame:
    """Exhaustive counts per pattern; snippets are capped elsewhere."""
    return hits.groupBy("pattern_id").agg(F.sum("matches").alias("total_matches"),
                                          F.count(F.lit(1)).alias("total_memories"))


def search_snippets(hits: DataFrame, memories: DataFrame, patterns: Sequence[Pattern],
                    per_memory: int = SNIPPETS_PER_MEMORY, per_pattern: int = SNIPPETS_PER_PATTERN) -> DataFrame:
    """At most `per_memory` snippets per memory and `per_pattern` per pattern, newest memory first,
    then by position.

    A pattern's snippets come from its `per_pattern` newest matching memories at most, so positions
    are worked out for those texts only.
    """
    newest = [F.desc("updated_at"), F.asc("memory_id")]
    near = top_k(hits.select("pattern_id", "memory_id", "updated_at"), ["pattern_id"], newest,
                 per_pattern, "_place").drop("_place")
    asked = hits.sparkSession.createDataFrame(request_rows(patterns), REQUEST.replace(":", ""))
    rows = attach(memories.select("memory_id", "text"), near, "memory_id", computed=True).join(
        F.broadcast(asked), "pattern_id")
    haystack = F.when(F.col("fold"), ascii_lower("text")).otherwise(F.col("text"))
    placed = rows.where(~F.col("regex")).withColumn("ranges", M.match_ranges(haystack, F.col("java"), per_memory))
    if any(p.regex for p in patterns):
        placed = placed.unionByName(linear_regex.regex_ranges(rows.where("regex"), "text", "needle", "fold", per_memory))
    placed = placed.select("pattern_id", "memory_id", "updated_at", "text", "context", rows_of(F.col("ranges"), "r")).where(is_row("r"))
    shown = placed.select("pattern_id", "memory_id", "updated_at", "r.start",
                          M.snippet(F.col("text"), F.col("r.start"), F.col("r.length"), F.col("context")).alias("s"))
    ranked = top_k(shown, ["pattern_id"], [*newest, F.asc("start")], per_pattern, "position")
    return ranked.select("pattern_id", "memory_id", "start", "position", "s.*")
