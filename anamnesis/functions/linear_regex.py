"""Regular expressions in time linear in the text, on Arrow batches.

The engine is the RE2 of `pyarrow.compute`: no backtracking, so no expression can exhaust the
stack or take exponential time. `.` stops at line feeds, `$` is the very end of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Two noncharacters frame each match while positions are counted.
OPEN, CLOSE = chr(0xFDD0), chr(0xFDD1)
#: What may see the text before a match, or a part of a character.
LOOKS_BACK = re.compile(r"\^|\\[bBAC]")
#: If more than this share of a batch matches, all of it is counted, for a copy of the matching texts costs more.
MOST = 0.9


def problem(pattern: str) -> str | None:
    """Why the engine refuses an expression, or None."""
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid as error:
        return str(error).splitlines()[0]
    return None


def hits_of(patterns: Sequence[tuple[str, str, bool]], restricted: bool):
    """A task function: (memory_id, updated_at, text[, pattern_ids]) to the pairs that match, with counts.

    `patterns` holds (pattern_id, expression, ignore case). Patterns with one expression are matched once.
    """
    alike: dict[tuple[str, bool], list[str]] = {}
    for pattern_id, expression, fold in patterns:
        alike.setdefault((expression, fold), []).append(pattern_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, text = (batch.column(i) for i in range(3))
            wanted = [set(w or ()) for w in batch.column(3).to_pylist()] if restricted else None
            clean = without_marks(text)
            for (expression, fold), pattern_ids in alike.items():
                held = pc.match_substring_regex(text, expression, ignore_case=fold)
                if wanted is not None:
                    held = pc.and_(held, pa.array([not w.isdisjoint(pattern_ids) for w in wanted], pa.bool_()))
                if not pc.any(held).as_py():
                    continue
                if held.true_count > len(held) * MOST:
                    counts = _counted(clean, expression, fold).filter(held)
                else:
                    counts = _counted(clean.filter(held), expression, fold)
                own_ids, own_at = ids.filter(held), at.filter(held)
                asked = None if wanted is None else [w for w, h in zip(wanted, held.to_pylist()) if h]
                for pattern_id in pattern_ids:
                    columns = [pa.array([pattern_id] * len(counts), pa.string()), own_ids, own_at, counts]
                    rows = pa.RecordBatch.from_arrays(columns, ["pattern_id", "memory_id", "updated_at", "matches"])
                    yield rows if asked is None else rows.filter(pa.array([pattern_id in w for w in asked], pa.bool_()))

    return run


def without_marks(texts: pa.Array) -> pa.Array:
    return pc.replace_substring(texts, OPEN, "�")


def match_counts(texts: pa.Array, expression: str, fold: bool) -> pa.Array:
    """How many matches each text has: as many as `ranges` gives places."""
    return _counted(without_marks(texts), expression, fold)


def _counted(clean: pa.Array, expression: str, fold: bool) -> pa.Array:
    """The counting call starts anew behind each match. An expression that could see what stands before a
    match (`^`, `\\b`), or could match nothing, has each match replaced by a mark instead, in one walk from
    match to match, and the marks are counted."""
    if not LOOKS_BACK.search(expression) and not pc.match_substring_regex(pa.array([""]), expression, ignore_case=fold)[0].as_py():
        return pc.count_substring_regex(clean, expression, ignore_case=fold).cast(pa.int64())
    return _marks(pc.replace_substring_regex(clean, f"{'(?i)' if fold else ''}({expression})", OPEN))


def _marks(marked: pa.Array) -> pa.Array:
    """How many marks each text has, from the places of the mark's bytes in all of them."""
    marked = marked.cast(pa.large_string())
    ends = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset:marked.offset + len(marked) + 1]
    data = marked.buffers()[2]
    text = np.frombuffer(data, np.uint8)[:ends[-1]] if data is not None and len(ends) else np.zeros(0, np.uint8)
    first, *others = OPEN.encode()
    at = np.flatnonzero(text[:max(len(text) - len(others), 0)] == first)
    for step, byte in enumerate(others, 1):
        at = at[text[at + step] == byte]
    counts = np.diff(np.searchsorted(at, ends)) if len(marked) else np.zeros(0, np.int64)
    return pa.array(counts, pa.int64(), mask=marked.is_null().to_numpy(zero_copy_only=False))


def ranges(text: str | None, expression: str, fold: bool, limit: int | None = None) -> list[dict[str, int]] | None:
    """start and length, in characters, of the first `limit` matches, or of all."""
    if text is None:
        return None
    clean = text.replace(OPEN, "�").replace(CLOSE, "�")
    flags = "(?i)" if fold else ""
    marked = pc.replace_substring_regex(pa.array([clean]), f"{flags}({expression})", OPEN + r"\1" + CLOSE,
                                        max_replacements=limit if limit is not None else -1)[0].as_py()
    found, at = [], 0
    for piece in re.split(f"({OPEN}[^{CLOSE}]*{CLOSE})", marked):
        if piece.startswith(OPEN):
            found.append({"start": at, "length": len(piece) - 2})
            at += len(piece) - 2
        else:
            at += len(piece)
    return found


def regex_ranges(rows: DataFrame, text: str, expression: str, ignore_case: str | None = None,
                 limit: int | None = None) -> DataFrame:
    """Add `ranges`: (start, length) of the matches of each row's own expression, zero-based, in order."""
    given = rows if ignore_case else rows.withColumn("_fold", F.lit(False))
    at = (given.columns.index(c) for c in (text, expression, ignore_case or "_fold"))
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())]))
    made = given.mapInArrow(_ranges_of(limit, *at), T.StructType([*given.schema.fields, T.StructField("ranges", kind)]))
    return made if ignore_case else made.drop("_fold")


def _ranges_of(limit: int | None, text_at: int, expression_at: int, fold_at: int):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in (text_at, expression_at, fold_at))
            made = [ranges(text, expression, fold, limit) for text, expression, fold in zip(*columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], names=[*batch.schema.names, "ranges"])

    return run
