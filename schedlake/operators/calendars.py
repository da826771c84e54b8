"""Packed calendars decoded to weeks and exceptions, and working-day arithmetic on them.

Decoding is a nested grammar and runs as an Arrow-batched function; everything after it is
arithmetic on arrays in the JVM: working days of a span are counted from whole weeks and the
exceptions inside it, without listing its days.
"""

from __future__ import annotations

import datetime as dt
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SHIFT = "struct<label:string,start:double,finish:double,hours:double>"
_DAY = f"struct<day:int,works:boolean,shifts:array<{_SHIFT}>,hours:double>"
_EXCEPTION = f"struct<serial:int,works:boolean,shifts:array<{_SHIFT}>,hours:double>"
DECODED = (
    f"state string, reason string, week array<{_DAY}>, exceptions array<{_EXCEPTION}>, hours_per_working_day double, "
    "working_days_per_week int, hours_per_week double, meaning string"
)
_LAYOUT = str.maketrans("", "", "\x7f\t\r\n")
_CLOCK = re.compile(r"(\d{1,2}):(\d{2})(?:\s*([AaPp])\.?[Mm]\.?)?")
_EPOCH = dt.date(1899, 12, 30).toordinal()


#: Fixed value: hours of a day where no calendar says.
FALLBACK_HOURS = 8.0


class CalendarError(ValueError):
    """The packed text does not follow the grammar."""


def parse_nodes(text: str) -> list[tuple[str, dict[str, str], list]]:
    """Nodes ``(head, attributes, children)`` of ``( head ( attrs ) ( children ) )`` lists, iteratively."""
    text = text.translate(_LAYOUT)
    top: list = []
    # Each open list is (nodes, state of its open node): a node is [head, attrs text, children].
    stack: list[list] = [[top, None]]
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c == " ":
            i += 1
        elif stack[-1][1] is None:
            if c == "(":
                end = min((j for j in (text.find("(", i + 1), text.find(")", i + 1)) if j >= 0), default=-1)
                if end < 0:
                    raise CalendarError("a node is not closed")
                node = [text[i + 1 : end].strip(), {}, []]
                stack[-1][0].append(node)
                stack[-1][1] = [node, 0]
                i = end
            elif c == ")" and len(stack) > 1:
                stack.pop()
                i += 1
            else:
                raise CalendarError("text outside a node")
        else:
            node, part = stack[-1][1]
            if c == ")":
                stack[-1][1] = None
                i += 1
            elif c == "(" and part == 0:
                end = text.find(")", i)
                if end < 0:
                    raise CalendarError("attributes are not closed")
                bits = [b.strip() for b in text[i + 1 : end].split("|")]
                node[1] = dict(zip(bits[::2], bits[1::2], strict=False))
                stack[-1][1][1] = 1
                i = end + 1
            elif c == "(" and part == 1:
                stack[-1][1][1] = 2
                stack.append([node[2], None])
                i += 1
            else:
                raise CalendarError("text inside a node")
    if len(stack) > 1 or stack[0][1] is not None:
        raise CalendarError("a node is not closed")
    return [tuple(x) for x in top]


def _name(head: str) -> str:
    return re.sub(r"^0\|\|", "", head)


def clock_hours(text: str) -> float:
    """Hours since midnight of a 24-hour clock, or of a 12-hour one with AM or PM."""
    m = _CLOCK.fullmatch(text.strip())
    if not m:
        raise CalendarError("a clock time cannot be read")
    hour, minute = int(m[1]), int(m[2])
    if m[3]:
        if not 1 <= hour <= 12:
            raise CalendarError("a clock time cannot be read")
        hour = hour % 12 + (12 if m[3] in "Pp" else 0)
    if hour > 23 or minute > 59:
        raise CalendarError("a clock time cannot be read")
    return hour + minute / 60


def _shifts(nodes: list) -> list[dict]:
    out = []
    for _, attrs, _ in nodes:
        if not attrs.get("s") and not attrs.get("f"):
            continue  # an empty slot
        start, finish = clock_hours(attrs.get("s", "")), clock_hours(attrs.get("f", ""))
        finish = 24.0 if finish == 0 else finish
        if finish <= start:
            raise CalendarError("a shift ends before it starts")
        label = "-".join(f"{int(h):02d}:{round(h % 1 * 60):02d}" for h in (start, finish))
        out.append({"label": label, "start": start, "finish": finish, "hours": finish - start})
    return out


def _scope(nodes: list) -> list | None:
    """The sibling list that holds the week, searched depth first in order."""
    stack = [nodes]
    while stack:
        level = stack.pop()
        if any(_name(h) == "DaysOfWeek" for h, _, _ in level):
            return level
        stack += [children for _, _, children in reversed(level)]
    return None


def decode(text: str | None) -> dict:
    """One calendar as a dict of ``DECODED``'s fields; state is ok or error, never an exception."""
    empty = {"week": None, "exceptions": None, "hours_per_working_day": None, "working_days_per_week": None, "hours_per_week": None, "meaning": None}
    try:
        scope = _scope(parse_nodes(text or ""))
        if scope is None:
            raise CalendarError("no week")
        named = {_name(h): children for h, _, children in reversed(scope)}
        week = []
        for head, _, children in named["DaysOfWeek"]:
            if not _name(head).isdecimal() or not 1 <= int(_name(head)) <= 7:
                raise CalendarError("a day of the week cannot be read")
            shifts = _shifts(children)
            week.append({"day": int(_name(head)), "works": bool(shifts), "shifts": shifts, "hours": sum(s["hours"] for s in shifts)})
        week.sort(key=lambda d: d["day"])
        if [d["day"] for d in week] != [1, 2, 3, 4, 5, 6, 7]:
            raise CalendarError("the week does not have seven days")
        exceptions = []
        for _, attrs, children in named.get("Exceptions", []):
            if not attrs.get("d", "").isdecimal():
                raise CalendarError("an exception has no day")
            shifts = _shifts(children)
            exceptions.append({"serial": int(attrs["d"]), "works": bool(shifts), "shifts": shifts, "hours": sum(s["hours"] for s in shifts)})
    except CalendarError as e:
        return {"state": "error", "reason": str(e)} | empty
    hours = {d["hours"] for d in week if d["works"]}
    label = lambda d: ",".join(s["label"] for s in d["shifts"])
    meaning = ";".join(label(d) for d in week) + "|" + ";".join(f"{d['serial']}:{label(d)}" for d in sorted(exceptions, key=lambda d: d["serial"]))
    return {
        "state": "ok", "reason": None, "week": week, "exceptions": exceptions,
        "hours_per_working_day": hours.pop() if len(hours) == 1 else None,
        "working_days_per_week": sum(d["works"] for d in week), "hours_per_week": float(sum(d["hours"] for d in week)), "meaning": meaning,
    }


def _decode_batch(packed: pd.Series) -> pd.DataFrame:
    columns = ["state", "reason", "week", "exceptions", "hours_per_working_day", "working_days_per_week", "hours_per_week", "meaning"]
    rows = [decode(t) for t in packed]
    return pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in columns})


def decode_calendar(packed: Column) -> Column:
    """Arrow-batched ``decode``."""
    return F.pandas_udf(_decode_batch, DECODED)(packed)


def decoded(calendars: DataFrame) -> DataFrame:
    """``(clndr_id, state, reason, ...)`` of the latest row of each calendar."""
    return calendars.withColumn("d", decode_calendar(F.col("clndr_data"))).select("clndr_id", "d.*")


def programme_calendars(tasks: DataFrame, projects: DataFrame, decoded_calendars: DataFrame, key: str = "proj_id") -> DataFrame:
    """The calendar of each project with tasks, found through its own row, or why there is none.

    Columns: key, clndr_id, state (ok, unavailable, error), reason, week, exceptions,
    hours_per_day, hours_source, working_days_per_week. A calendar that is absent is
    unavailable, one that cannot be decoded an error, and no other is put in its place. The
    day's length is the calendar's where it is ok and all its working days are alike, else the
    fallback's. ``decoded_calendars`` has clndr_id and what ``decode`` gives; ``projects`` (key,
    clndr_id) has a project once.
    """
    own = tasks.where(F.col(key).isNotNull()).select(key).distinct()
    named = projects.select(F.col(key).alias("p_key"), F.nullif(F.trim(F.col("clndr_id").cast("string")), F.lit("")).alias("named"))
    cal = decoded_calendars.select(
        F.col("clndr_id").cast("string").alias("c_id"), F.col("state").alias("c_state"), F.col("reason").alias("c_reason"), "week", "exceptions", "hours_per_working_day", "working_days_per_week"
    )
    both = own.join(named, F.col(key) == F.col("p_key"), "left").join(cal, F.col("named") == F.col("c_id"), "left")
    ok = F.col("c_state") == "ok"
    reason = (
        F.when(F.col("p_key").isNull(), "the project has no row").when(F.col("named").isNull(), "the project names no calendar")
        .when(F.col("c_id").isNull(), "the named calendar is not there").when(~ok, F.col("c_reason"))
    )
    hours = F.when(ok & (F.col("hours_per_working_day") > 0), F.col("hours_per_working_day"))
    return both.select(
        key, F.col("named").alias("clndr_id"), F.when(ok, "ok").when(F.col("c_id").isNotNull(), "error").otherwise("unavailable").alias("state"), reason.alias("reason"),
        F.when(ok, F.col("week")).alias("week"), F.when(ok, F.col("exceptions")).alias("exceptions"), F.coalesce(hours, F.lit(FALLBACK_HOURS)).alias("hours_per_day"),
        F.when(hours.isNotNull(), "programme_calendar").otherwise("fallback").alias("hours_source"), F.when(ok, F.col("working_days_per_week")).alias("working_days_per_week"),
    )


def working_days(week: Column, exceptions: Column, first: Column, last: Column) -> Column:
    """Working days from ``first`` to ``last``, both ends in; null if a date is null or they are reversed.

    Whole weeks are multiplied; an exception inside the span replaces its weekday, the last one
    of a repeated day counts.
    """
    a, b = F.unix_date(first), F.unix_date(last)
    # Day 0 (1970-01-01) was a Thursday: weekday 5 counted from Sunday as 1.
    fall = lambda d: F.aggregate(F.filter(week, lambda w: w["works"]), F.lit(0).cast("bigint"), lambda n, w: n + F.floor((d + 5 - w["day"]) / 7))
    plain = fall(b) - fall(a - F.lit(1))
    offset = F.lit(dt.date(1970, 1, 1).toordinal() - _EPOCH)
    inside = F.filter(exceptions, lambda e: (e["serial"] - offset >= a) & (e["serial"] - offset <= b))
    lasts = F.filter(
        F.transform(inside, lambda e, i: F.struct(e["serial"].alias("serial"), e["works"].alias("works"), i.alias("i"))),
        lambda e: ~F.exists(F.slice(inside, e["i"] + 2, F.size(inside) + 1), lambda x: x["serial"] == e["serial"]),
    )
    usual = lambda serial: F.exists(week, lambda w: w["works"] & (w["day"] == F.pmod(serial - offset + 4, F.lit(7)) + 1))
    swap = F.aggregate(lasts, F.lit(0).cast("bigint"), lambda n, e: n + e["works"].cast("int") - usual(e["serial"]).cast("int"))
    return F.when((a.isNotNull()) & (b >= a), plain + swap)


def instant_at(calendar: dict, start: dt.date, hours: float, finish: bool, limit: int = 20_000) -> dt.datetime | None:
    """The instant at which ``hours`` working hours from a day's start are reached.

    A start instant begins the next hour, a finish instant ends the last one; a finish at 0
    hours and a walk beyond ``limit`` days give None.
    """
    if finish and hours <= 0:
        return None
    by_serial = {e["serial"]: e for e in calendar["exceptions"]}
    week = {d["day"]: d for d in calendar["week"]}
    left = hours
    for k in range(limit):
        day = start + dt.timedelta(days=k)
        plan = by_serial.get(day.toordinal() - _EPOCH, week[day.isoweekday() % 7 + 1])
        for s in plan["shifts"]:
            if left < s["hours"] or (finish and left <= s["hours"]):
                return dt.datetime.combine(day, dt.time()) + dt.timedelta(hours=s["start"] + left)
            left -= s["hours"]
    return None
