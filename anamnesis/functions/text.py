"""Tokens, trigrams, folding, rendering and mark-up rules on text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anamnesis.constants import MIN_TOKEN_LENGTH, PREVIEW_LENGTH, TRIGRAM_SIZE
from anamnesis.functions.core import SPACE_CLASS, as_column, bind, is_blank, trim_space


def tokenize(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits, at least two characters long."""
    parts = F.split(F.lower(as_column(text)), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: F.char_length(t) >= MIN_TOKEN_LENGTH)


def term_counts(tokens: Column) -> Column:
    """(term, tf) pairs of one token array, counted inside the row.

    Sorting groups equal tokens, so the run starts give every distinct term and the distance
    to the next start gives its frequency. No shuffle is needed to build postings.
    """

    def runs(ordered: Column) -> Column:
        positions = F.transform(
            ordered,
            lambda t, i: F.when((i == 0) | (F.get(ordered, i - 1) != t), i),
        )
        starts = F.filter(positions, lambda p: p.isNotNull())
        return bind(starts, lambda s: F.transform(
            s,
            lambda p, j: F.struct(
                F.get(ordered, p).alias("term"),
                (F.coalesce(F.get(s, j + 1), F.size(ordered)) - p).alias("tf"),
            ),
        ))

    return bind(F.array_sort(tokens), runs)


def ascii_lower(text: Column | str) -> Column:
    """Fold A-Z only; never changes a length, so match offsets stay valid."""
    return F.translate(as_column(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def trigrams(text: Column | str) -> Column:
    """Distinct three-character windows of the folded text."""

    def windows(chars: Column) -> Column:
        # The text becomes an array of characters once, so each window is a constant-time lookup.
        starts = F.slice(chars, F.lit(1), F.greatest(F.size(chars) - (TRIGRAM_SIZE - 1), F.lit(0)))
        return F.array_distinct(F.transform(
            starts, lambda c, i: F.concat(c, *[F.get(chars, i + j) for j in range(1, TRIGRAM_SIZE)])))

    return bind(F.split(ascii_lower(text), ""), windows)


# Direction marks that chat exports sprinkle into lines, and mark-up forms.
DIRECTION_MARKS = r"[\u200e\u200f\u202a-\u202e]"
LABELLED_LINK = r"<([^>|]+)\|([^>]+)>"
BARE_LINK = r"<(https?:[^>|]+)>"


def strip_marks(text: Column | str) -> Column:
    return F.regexp_replace(as_column(text), DIRECTION_MARKS, "")


def clean_markup(text: Column | str) -> Column:
    labelled = F.regexp_replace(as_column(text), LABELLED_LINK, "$2")
    return trim_space(F.regexp_replace(labelled, BARE_LINK, "$1"))


def turn_line(speaker: Column | str, body: Column | str) -> Column:
    return F.concat(as_column(speaker), F.lit(": "), as_column(body))


def role_line(role: Column | str, body: Column | str) -> Column:
    return turn_line(F.upper(as_column(role)), body)


def accept_role(role: Column | str) -> Column:
    """`user` or `assistant` in lower case, else null."""
    folded = F.lower(as_column(role))
    return F.when(folded.isin("user", "assistant"), folded)


def speaker_name(display: Column, real: Column, plain: Column, user: Column) -> Column:
    """First non-blank of the profile names (trimmed), else the user id."""
    named = [F.when(~is_blank(c), trim_space(c)) for c in (display, real, plain)]
    return F.coalesce(*named, F.when(user != "", user), F.lit("unknown"))


def preview(text: Column | str, limit: int = PREVIEW_LENGTH) -> Column:
    """(shown, truncated): the text cut to `limit` characters plus an ellipsis."""
    value = as_column(text)
    long = F.char_length(value) > limit
    return F.struct(
        F.when(long, F.concat(F.substring(value, 1, limit), F.lit("…"))).otherwise(value).alias("shown"),
        long.alias("truncated"),
    )


def collapse_whitespace(text: Column | str) -> Column:
    return F.regexp_replace(as_column(text), f"{SPACE_CLASS}+", " ")
