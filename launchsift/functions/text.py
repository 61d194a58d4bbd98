"""Text and number expressions, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from launchsift.functions.constants import BLANKS


def strip(text: Column) -> Column:
    """Remove white space (line breaks included) from both ends."""
    return F.btrim(text, F.lit(BLANKS))


def head(text: Column, width: int) -> Column:
    """The first ``width`` characters."""
    return F.substring(text, 1, width)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def round_even(value: Column, digits: int) -> Column:
    """Ties go to the even digit."""
    return F.bround(value, digits)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; timestamps without zone are read as session time."""
    return F.unix_micros(ts.cast("timestamp"))


def fence_body(text: Column) -> Column:
    """Text inside a code fence; text without a fence is returned stripped.

    The opening line is dropped only when a line break follows it, and the closing
    fence only when an opening one was seen.
    """
    whole = strip(text)
    opened = whole.startswith("```")
    inner = F.when(opened, F.regexp_replace(whole, r"(?s)\A```[^\n]*\n", "")).otherwise(whole)
    closed = F.when(opened, F.regexp_replace(inner, r"(?s)```\z", "")).otherwise(inner)
    return strip(closed)


def is_fenced(text: Column) -> Column:
    return strip(text).startswith("```")


def model_tag(provider: Column, model: Column) -> Column:
    """``provider/model`` with any own prefix of the model name removed."""
    return F.concat(provider, F.lit("/"), F.regexp_replace(model, r"\A[^/]*/", ""))


def chosen(*options: tuple[Column, Column]) -> Column:
    """Array of the values whose condition is true, in the given order.

    Built from one-element arrays because that, unlike filtering an array, is compiled.
    """
    none = F.array()
    return F.concat(*[F.when(when, F.array(value)).otherwise(none) for when, value in options])


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds ``value`` as a column that later filters cannot pull apart.

    The optimizer moves filters below a projection by copying the expressions they use,
    which would parse a document once per use.  A one-element generator stops that.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
