"""Display expressions: counts, sizes, shares, durations, ages, positions on a scale."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Votes that fill the vote bar; activities of one slot and slots of the activity track.
VOTE_FULL, SLOT_SIZE, SLOTS = 400, 1000, 10


def format_count(n: Column) -> Column:
    """A whole number with its thousands grouped."""
    return F.format_number(n, 0)


def format_bytes(n: Column) -> Column:
    """Bytes below 1 kB, then kB, then MB with one place."""
    return (
        F.when(n < 1000, F.format_string("%d B", n))
        .when(n < 1_000_000, F.format_string("%d kB", F.floor(n / 1000 + 0.5)))
        .otherwise(F.format_string("%.1f MB", F.floor(n / 100_000 + 0.5) / 10))
    )


def hours_as_days(hours: Column, per_day: Column | float = 8.0) -> Column:
    """Hours as days of a length, halves up to one place."""
    return F.floor(hours / per_day * 10 + 0.5) / 10


def age_bucket(then: Column, now: Column) -> Column:
    """new within the hour, h below 48 hours, d below 60 days, mo below 24 months of 30 days, else y."""
    hours = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(then.cast("timestamp"))) / 3600
    return F.when(hours < 1, "new").when(hours < 48, "h").when(hours < 24 * 60, "d").when(hours < 24 * 720, "mo").when(hours.isNotNull(), "y")


def elapsed_share(start: Column, finish: Column, data: Column) -> Column:
    """How far the data date stands between two dates, held within 0 and 1; null without a span."""
    span = F.datediff(finish, start)
    return F.when(span > 0, F.least(F.greatest(F.datediff(data, start) / span, F.lit(0.0)), F.lit(1.0)))


def vote_magnitude(votes: Column) -> Column:
    """Square-root scale of votes, 1 from ``VOTE_FULL``."""
    return F.least(F.sqrt(F.greatest(votes, F.lit(0))) / math.sqrt(VOTE_FULL), F.lit(1.0))


def activity_track(n: Column) -> Column:
    """Slots that an activity count fills."""
    return F.least(F.ceil(n / SLOT_SIZE), F.lit(SLOTS))


def month_label(month: Column) -> Column:
    """YYYY-MM of a month index (year * 12 + month - 1)."""
    return F.format_string("%04d-%02d", F.floor(month / 12).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"))


def nice_step(top: Column, ticks: int = 5) -> Column:
    """The step 1, 2 or 5 times a power of ten that covers ``top`` in at most ``ticks`` steps; 1 for nothing."""
    raw = top / ticks
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    unit = raw / power
    return F.when(top > 0, F.when(unit <= 1, 1).when(unit <= 2, 2).when(unit <= 5, 5).otherwise(10) * power).otherwise(1.0)


def percent_text(share: Column) -> Column:
    """A percentage with one place where it has one."""
    whole = share == F.floor(share)
    return F.when(whole, F.concat(share.cast("bigint").cast("string"), F.lit("%"))).when(share.isNotNull(), F.format_string("%.1f%%", F.floor(share * 10 + 0.5) / 10))


def plural(n: Column, one: str, many: str) -> Column:
    """A count with its noun."""
    return F.concat_ws(" ", format_count(n), F.when(n == 1, one).otherwise(many))


def clamp_pct(share: Column) -> Column:
    """A percentage held within 0 and 100."""
    return F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0))


def interpolate(value: Column, low: float, high: float, start: float, end: float) -> Column:
    """Where a value lies between two marks, as a place between two others; held at the ends."""
    share = F.least(F.greatest((value - low) / F.lit(float(high - low)), F.lit(0.0)), F.lit(1.0))
    return F.lit(float(start)) + F.lit(float(end - start)) * share
