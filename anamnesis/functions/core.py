"""Small building blocks shared by the other expression modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that the reference's trimming and `\s` cover. Java's `\s` is
# ASCII only, so patterns that face user text spell the class out.
SPACE_CLASS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times inside one row expression.

    Catalyst may copy a projected expression into each place that refers to it; a lambda
    variable is evaluated once whatever the optimizer does.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def rows_of(array: Column, name: str) -> Column:
    """Explode a computed array; pair it with `is_row`.

    A plain explode makes Spark add a non-empty filter that repeats the array expression. The
    outer form keeps one evaluation, and `is_row` then drops the row of an empty array.
    """
    return F.explode_outer(array).alias(name)


def numbered_rows_of(array: Column, position: str, name: str) -> Column:
    return F.posexplode_outer(array).alias(position, name)


def is_row(name: str) -> Column:
    return F.col(name).isNotNull()


def trim_space(value: Column | str) -> Column:
    text = as_column(value)
    return F.regexp_replace(text, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def is_blank(value: Column | str) -> Column:
    text = as_column(value)
    return text.isNull() | ~text.rlike(f"[^{SPACE_CLASS[1:]}")


def iso_millis(timestamp: Column | str) -> Column:
    """ISO-8601 text with milliseconds, the only form in which times leave the store."""
    return F.date_format(as_column(timestamp), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
