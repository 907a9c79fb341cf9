"""Where a literal or a regular expression occurs in a text, and what stands around it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anamnesis.functions.linear_regex import CLOSE, OPEN


def quote_literal(needle: str) -> str:
    """A Java pattern that matches exactly the needle."""
    return "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in needle)


def fold(text: str) -> str:
    """ASCII-only lower case, as `ascii_lower` does for columns."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def literal_count(haystack: Column, needle: Column) -> Column:
    """Non-overlapping occurrences, left to right."""
    removed = F.char_length(haystack) - F.char_length(F.replace(haystack, needle))
    return (removed / F.char_length(needle)).cast("int")


def match_ranges(haystack: Column, pattern: Column, limit: int | None = None) -> Column:
    """(start, length) of each match in order, zero-based, at most `limit` of them."""
    clean = F.translate(haystack, OPEN + CLOSE, chr(0xFFFD) * 2)
    marked = F.split(F.regexp_replace(clean, pattern, F.lit(f"{OPEN}$0{CLOSE}")), OPEN)
    count = F.size(marked) - 1
    bounded = count if limit is None else F.least(count, F.lit(limit))
    # Each piece after the first is "match CLOSE rest": one marker too long for its text.
    pieces = F.slice(marked, F.lit(1), bounded + 1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out"))

    def step(state: Column, piece: Column) -> Column:
        length = F.locate(CLOSE, piece) - 1
        first = length < 0
        return F.struct(
            (state["at"] + F.char_length(piece) - F.when(first, 0).otherwise(1)).alias("at"),
            F.when(first, state["out"]).otherwise(F.array_append(state["out"], F.struct(
                state["at"].alias("start"), length.alias("length")))).alias("out"))

    return F.aggregate(pieces, start, step, lambda s: s["out"])


def snippet(text: Column, start: Column, length: Column, context: Column) -> Column:
    """The match with `context` characters on each side, clipped to the text."""
    left = F.greatest(start - context, F.lit(0))
    return F.struct(
        F.substring(text, left + 1, start - left).alias("before"),
        F.substring(text, start + 1, length).alias("match"),
        F.substring(text, start + length + 1, context).alias("after"))
