"""Number parsing rules for noisy readings.

A tri-state number is struct(value double, uncertain boolean): null/false = absent,
null/true = unreadable, value/false = read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholarch.functions.text import trim_ws

def _dotted(col: Column) -> Column:
    return F.replace(trim_ws(col), F.lit(","), F.lit("."))


def coerce_number(col: Column) -> Column:
    """Leading numeric prefix after comma to dot; null when there is none."""
    return F.regexp_extract(_dotted(col), "^[-+]?[0-9]*\\.?[0-9]+", 0).try_cast("double")


def coerce_rank(col: Column) -> Column:
    """A whole number truncated from a comma/dot number; null unless the entire text is one."""
    return _finite(_dotted(col)).try_cast("bigint")


def _finite(text: Column) -> Column:
    """Strict decimal text to double: nan/infinity spellings and type suffixes give null."""
    strict = "^[-+]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][-+]?[0-9]+)?$"
    value = F.regexp_extract(text, strict, 0).try_cast("double")
    # as the element of an array the value is worked out once and tested after
    return F.get(F.filter(F.array(value), lambda v: F.abs(v) < float("inf")), F.lit(0))


def finite_or_null(col: Column) -> Column:
    """Number of a text; '' gives null, white space alone gives 0, anything else unreadable null.

    A plain number needs no trimming, which costs more than the pattern.
    """
    text = trim_ws(col)
    padded = F.when(text == "", F.lit(0.0)).otherwise(_finite(text))
    return F.when(col == "", F.lit(None).cast("double")).otherwise(F.coalesce(_finite(col), padded))


def decimal_comma_or_null(col: Column) -> Column:
    """As finite_or_null with the first comma read as the decimal point."""
    return finite_or_null(F.regexp_replace(col, "^([^,]*),", "$1."))


def tri(value: Column, uncertain: Column) -> Column:
    return F.struct(value.cast("double").alias("value"), uncertain.alias("uncertain"))


def _read(col: Column, value: Column) -> Column:
    """Tri-state of a text and the value read from it: marker words and misreads are uncertain."""
    # as the element of an array the value is worked out once and named twice
    read = F.transform(F.array(value), lambda v: tri(v, F.coalesce(v.isNull() & (trim_ws(col) != ""), F.lit(False))))
    return F.get(read, F.lit(0))


def _written(col: Column, pattern: str, group: int = 0) -> Column:
    """The number of a text that is one by the pattern, white space around it aside."""

    def of(text: Column) -> Column:
        return F.regexp_extract(F.replace(text, F.lit(","), F.lit(".")), pattern, group).try_cast("double")

    return F.coalesce(of(col), of(trim_ws(col)))


def number_or_uncertain(col: Column) -> Column:
    return _read(col, _written(col, "^[-+]?[0-9]+(?:\\.[0-9]+)?$"))


def natural_or_uncertain(col: Column) -> Column:
    """number_or_uncertain cut to its whole part; negatives (whole part below zero) are uncertain."""
    return _read(col, _written(col, "^(?:\\+?|-(?=0+(?:\\.|$)))([0-9]+)(?:\\.[0-9]+)?$", 1))


def decimal_avg_or_uncertain(col: Column) -> Column:
    """Only readings written with a decimal separator count; whole numbers are uncertain."""
    return _read(col, _written(col, "^[-+]?[0-9]+\\.[0-9]+$"))


def format_academic(value: Column) -> Column:
    """Two-decimal text, '' for null."""
    return F.when(value.isNull(), "").otherwise(F.format_string("%.2f", F.round(value, 2)))
