"""Number grammar and rounding rules that differ from Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An optional sign, digits with an optional point, an optional exponent, blanks around.
NUMBER = r"\A\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*\z"


def blank_trim(text: Column) -> Column:
    """Strip white space of every kind at both ends (``trim`` strips spaces only)."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def is_number(text: Column) -> Column:
    """Whether the text is a number; null for null."""
    return text.rlike(NUMBER)


def to_number(text: Column) -> Column:
    """Double of a number text, null for anything else (``1d``, ``NaN``, ``Infinity``)."""
    return F.when(is_number(text), blank_trim(text).try_cast("double"))


def round_half_up(value: Column, places: int = 0) -> Column:
    """Round halves toward plus infinity: -0.25 to one place is -0.2."""
    scale = float(10**places)
    return F.floor(value * scale + 0.5) / scale


def percent(part: Column, whole: Column) -> Column:
    """Percentage to one place, 0 where the whole is 0."""
    exact = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return F.coalesce(F.floor(exact * 1000 + 0.5) / 10, F.lit(0.0))


def let(value: Column, body) -> Column:
    """``body`` of ``value`` evaluated once: inside lambdas Spark repeats a shared expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
