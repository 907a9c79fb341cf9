"""Text held in loosely typed JSON: a string, an object, or a list of either."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anamnesis.functions.core import as_column, trim_space


def variant_string(value: Column, path: str = "$") -> Column:
    """The string at `path`, null when it is absent or of another JSON type."""
    at = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(value, path, "string"))


def variant_list(value: Column, path: str = "$") -> Column:
    """The list at `path` as an array of variants, null for any other JSON type."""
    return F.try_variant_get(value, path, "array<variant>")


def join_text_blocks(content: Column | str) -> Column:
    """A string, or the `text` blocks of a list joined by newlines; trimmed, never null."""
    value = as_column(content)
    texts = F.transform(
        F.filter(variant_list(value), lambda b: F.coalesce(variant_string(b, "$.type") == "text", F.lit(False))),
        lambda b: variant_string(b, "$.text"))
    joined = F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n")
    return trim_space(F.coalesce(variant_string(value), joined, F.lit("")))


def join_text_runs(content: Column | str) -> Column:
    """A string, an object's `text`, or a list of both joined without a separator."""
    value = as_column(content)

    def run(part: Column) -> Column:
        return F.coalesce(variant_string(part), variant_string(part, "$.text"), F.lit(""))

    joined = F.array_join(F.transform(variant_list(value), run), "")
    return trim_space(F.coalesce(joined, run(value)))
