"""Naive local dates kept as text: ``YYYY-MM-DD`` with or without ``HH:MM``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_SHAPE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}(?: [0-9]{2}:[0-9]{2})?\z"
STAMP_SHAPE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}\z"
CLOCK = r"(?:[01][0-9]|2[0-3]):[0-5][0-9]"


def real_day(text: Column) -> Column:
    """Date of the leading ten characters; null for an impossible day or the year 0000."""
    day = F.substring(text, 1, 10)
    return F.when(day.rlike(r"\A(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), day.try_cast("date"))


def is_real_date(text: Column) -> Column:
    """``YYYY-MM-DD`` or ``YYYY-MM-DD HH:MM`` naming an existing day and minute."""
    return text.rlike(rf"\A[0-9-]{{10}}(?: {CLOCK})?\z") & real_day(text).isNotNull()


def is_real_instant(text: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS`` naming an existing second."""
    return text.rlike(rf"\A[0-9-]{{10}}T{CLOCK}:[0-5][0-9]\z") & real_day(text).isNotNull()


def day_number(text: Column) -> Column:
    """Days since 1970-01-01 of a naive text, null where it is no real day."""
    return F.unix_date(real_day(F.trim(text)))


def minute_number(text: Column) -> Column:
    """Minutes since 1970-01-01 00:00 of a naive text; a missing clock is midnight."""
    tail = F.substring(F.trim(text), 11, 100)
    hour = F.regexp_extract(tail, r"([0-9]{1,2}):([0-9]{2})", 1).try_cast("bigint")
    minute = F.regexp_extract(tail, r"([0-9]{1,2}):([0-9]{2})", 2).try_cast("bigint")
    return day_number(text).cast("bigint") * 1440 + F.coalesce(hour * 60 + minute, F.lit(0))


def serial_date(serial: Column) -> Column:
    """Date of a spreadsheet day serial, day 0 being 1899-12-30."""
    return F.date_add(F.lit("1899-12-30").cast("date"), serial.cast("int"))


def month_index(day: Column) -> Column:
    """Months since year 0: year * 12 + month - 1."""
    return F.year(day) * 12 + F.month(day) - 1
