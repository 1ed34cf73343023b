"""Turning form text into numbers, dates and text again without failing a job.

Form answers arrive as text.  A bad answer becomes NULL; it never raises, also under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A decimal number or an infinity; Spark's own cast would also take "12d" and "12f".
_NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)\s*$"
_ZONE = r":\d{1,2}(\.\d+)?\s*(Z|UTC|[+-]\d{2}(:?\d{2})?)\s*$"
_DAY_DASH = r"^\s*(\d{4}-\d{1,2}-\d{1,2})"
_DAY_DASH_OR_SLASH = r"^\s*(\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2})"


def to_double(text: Column) -> Column:
    """Text to double; anything that is not a decimal number is NULL."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def to_integer(text: Column) -> Column:
    """Text to int, fractions cut off; not a number or out of range is NULL."""
    return to_double(text).try_cast("int")


def rounded(value: Column) -> Column:
    """Double to int, halves to even; out of range is NULL."""
    return F.rint(value).try_cast("int")


def present(value: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(value), value)


def to_date(text: Column, slashes: bool = True) -> Column:
    """Leading ``yyyy-m-d`` (or ``yyyy/m/d``) of a text to a date; what follows it is ignored."""
    day = F.regexp_extract(text, _DAY_DASH_OR_SLASH if slashes else _DAY_DASH, 1)
    return F.translate(day, "/", "-").try_cast("date")


def to_moment_text(text: Column) -> Column:
    """A day as ``yyyy-MM-dd``, a day with a time as ``yyyy-MM-dd HH:mm:ss``, else NULL.

    A time with a zone offset is given in UTC, one without as it is.
    """
    only_day = F.when(text.rlike(r"^\s*\d{4}[-/]\d{1,2}[-/]\d{1,2}\s*$"), to_date(text))
    timed = text.rlike(r"\d{1,2}:\d{1,2}")
    zoned = text.rlike(_ZONE)
    plain = F.when(timed & ~zoned, text.try_cast("timestamp_ntz"))
    return F.coalesce(only_day.cast("string"), moment_text(plain), moment_text(F.when(timed & zoned, utc(text))))


def utc(text: Column) -> Column:
    """A time with a zone offset as the time it is in UTC then, whatever the session's zone."""
    spelled = F.regexp_replace(text, r"([+-]\d{2})(\d{2})\s*$", "$1:$2")
    local = spelled.try_cast("timestamp").cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)


def moment_text(moment: Column) -> Column:
    """A time stamp without a zone as ``yyyy-MM-dd HH:mm:ss``, whatever the session's zone."""
    return F.substring(moment.cast("string"), 1, 19)


def measure_of(df: DataFrame, name: str) -> Column:
    """A measure column as double: text is parsed, numbers only lose their NaN."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return to_double(F.col(name))
    return present(F.col(name).cast("double"))


def date_of(df: DataFrame, name: str, slashes: bool = True) -> Column:
    """A date column: text is parsed; dates and time stamps are kept, so scans can skip by them."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return to_date(F.col(name), slashes)
    return F.col(name)
