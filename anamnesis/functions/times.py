"""Times as the sources write them, read into UTC instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anamnesis.functions.core import as_column

# Date and time layouts of plain-text chat exports.
DATE_PATTERN = r"(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})"
TIME_PATTERN = r"(\d{1,2}):(\d{2})(?::(\d{2}))?[\s\u202f]?([APap][Mm])?"
DATE_ONLY = r"^\d{4}-\d{2}-\d{2}$"


def from_epoch_seconds(value: Column | str) -> Column:
    """Instant at millisecond precision; null unless finite and positive."""
    return from_epoch_ms(as_column(value).try_cast("double") * 1000)


def from_epoch_ms(value: Column | str) -> Column:
    number = as_column(value).try_cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (number > 0) & (number < 8.64e15)
    return F.when(usable, F.timestamp_millis(F.floor(number).cast("bigint")))


def from_iso(value: Column | str) -> Column:
    text = as_column(value)
    return F.when(F.trim(text) != "", F.try_to_timestamp(F.trim(text)))


def parse_chat_timestamp(date: Column, time: Column) -> Column:
    """A chat line's date and time, read as UTC.

    A part above 12 decides which of the first two numbers is the day; otherwise the day comes
    first. Parts out of range roll over, so the instant is built by adding to a base date.
    """

    def number(source: Column, pattern: str, group: int) -> Column:
        return F.regexp_extract(source, pattern, group).try_cast("int")

    a, b, raw_year = (number(date, DATE_PATTERN, g) for g in (1, 2, 3))
    day_first = (a > 12) | ~(b > 12)
    day, month = F.when(day_first, a).otherwise(b), F.when(day_first, b).otherwise(a)
    year = F.when(raw_year < 100, raw_year + 2000).otherwise(raw_year)

    whole = f"^{TIME_PATTERN}$"
    hour, minute = number(time, whole, 1), number(time, whole, 2)
    second = F.coalesce(number(time, whole, 3), F.lit(0))
    half = F.lower(F.regexp_extract(time, whole, 4))
    hour = (F.when((half == "pm") & (hour < 12), hour + 12)
            .when((half == "am") & (hour == 12), F.lit(0))
            .otherwise(hour))

    first_of_year = F.make_date(year, F.lit(1), F.lit(1))
    first_of_month = F.add_months(first_of_year, month - 1)
    date_part = F.date_add(first_of_month, day - 1)
    seconds = hour * 3600 + minute * 60 + second
    instant = F.timestamp_seconds(F.unix_date(date_part).cast("bigint") * 86400 + seconds)
    return F.when(hour.isNotNull() & day.isNotNull(), instant)


def range_end(end: str) -> Column:
    """Inclusive upper bound: a bare date names its whole day, to the last millisecond."""
    literal = F.lit(end)
    extended = F.when(literal.rlike(DATE_ONLY), F.concat(literal, F.lit("T23:59:59.999Z"))).otherwise(literal)
    return F.to_timestamp(extended)


def end_of_day(end: Column | str) -> Column:
    """Text form of the same rule, for a column of bounds."""
    text = as_column(end)
    return F.when(text.rlike(DATE_ONLY), F.concat(text, F.lit("T23:59:59.999Z"))).otherwise(text)
