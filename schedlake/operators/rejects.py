"""Strict load with an anti-join: sound rows loaded, the rest apart with their first reason.

Record offsets are kept from the start; only conforming rows are loaded; the loaded offsets
are subtracted from all offsets; only that remainder is diagnosed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schedlake.functions.dates import is_real_date, is_real_instant
from schedlake.functions.numbers import blank_trim, is_number
from schedlake.session import store
from schedlake.sources.lines import carried_lines, continuations, continued_rows, openers, tail_text

#: The key field of each table whose key must be a number.
KEY_FIELDS = {"TASK": "task_id", "PROJWBS": "wbs_id", "TASKPRED": "task_pred_id"}

#: The columns of a scan line, in order, and what each must be.
SCAN_COLUMNS = (
    "file_id", "scanned_at", "bytes", "content_hash", "p6_version", "starts_with_ermhdr", "reaches_end_marker",
    "nul_byte_count", "trailing_nul_run", "complete_bytes", "tokenizer_ok", "tokenizer_detail", "activity_count",
)
SCAN_COUNTS = ("bytes", "nul_byte_count", "trailing_nul_run", "complete_bytes", "activity_count")
SCAN_WITHIN_BYTES = ("nul_byte_count", "trailing_nul_run", "complete_bytes")
SCAN_FLAGS = ("starts_with_ermhdr", "reaches_end_marker", "tokenizer_ok")


def split_rejects(offsets: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """The rows of ``offsets`` that the strict load did not take."""
    return offsets.join(loaded.select(key), key, "left_anti")


# ---------------------------------------------------------------- export lines


def _field_facts() -> dict[str, Column]:
    """What a field list's text says about its rows: number of fields, places of the fields that must hold numbers or dates, places of key fields."""
    names = F.split(F.lower("text"), "\t", -1)
    ends = lambda tail: F.filter(F.transform(names, lambda n, i: F.when(n.endswith(tail), i)), lambda i: i.isNotNull())
    keys = [F.when(F.array_contains(names, k), F.array_position(names, k).cast("int") - 1).alias(k) for k in KEY_FIELDS.values()]
    return {"n_fields": F.size(names), "counts_at": ends("_cnt"), "dates_at": ends("_date"), "keys_at": F.struct(*keys)}


def _bad_key(cells: Column) -> Column:
    """A key field that is declared and is no number."""
    bad = F.lit(False)
    for name, field in KEY_FIELDS.items():
        place = F.col(f"keys_at.{field}")
        bad = bad | ((F.col("table_name") == name) & place.isNotNull() & ~is_number(F.coalesce(F.get(cells, place), F.lit(""))))
    return F.coalesce(bad, F.lit(False))


def _bad_value(cells: Column) -> Column:
    """Some non-blank _cnt cell is no number, or some non-blank _date cell no real date."""
    full = lambda cell: blank_trim(cell) != ""
    counts = F.exists("counts_at", lambda i: full(F.get(cells, i)) & ~is_number(F.get(cells, i)))
    return counts | F.exists("dates_at", lambda i: full(F.get(cells, i)) & ~is_real_date(F.get(cells, i)))


_FACTS = ["n_fields", "counts_at", "dates_at", "keys_at"]


def records(lines: DataFrame) -> DataFrame:
    """All row records with their offsets; ``cells`` only for rows of right arity without NUL.

    Lines are carried once and stored. Continuation text is fetched for rows that may be
    loaded alone, so a broken row that swallows much of a file is counted but never
    concatenated.
    """
    carried = store(carried_lines(lines, _field_facts()))
    tails = continuations(carried)
    rec = openers(carried, _FACTS).join(continued_rows(tails), F.col("line_id") == F.col("row_id"), "left")
    tabs = F.length("line") - F.length(F.translate("line", "\t", "")) + F.coalesce("extra_tabs", F.lit(0))
    rec = rec.withColumns({"has_nul": F.contains("line", F.lit("\0")) | F.coalesce("extra_nul", F.lit(False)), "arity_ok": F.col("n_fields") == tabs + 1})
    fit = F.col("fields").isNotNull() & ~F.col("has_nul") & F.coalesce("arity_ok", F.lit(False))
    rec = rec.withColumn("row_id", F.when(fit & F.col("extra_lines").isNotNull(), F.col("line_id")))
    bare = rec.where("row_id IS NULL").withColumn("body", F.when(fit, F.col("line")))
    joined = rec.where("row_id IS NOT NULL").join(tail_text(tails), "row_id").withColumn("body", F.concat("line", "tail"))
    keep = ["line_id", "file_id", "line_no", "table_name", "fields", "has_nul", "arity_ok", F.split("body", "\t", -1).alias("cells"), "counts_at", "dates_at", "keys_at"]
    return bare.select(keep).unionByName(joined.select(keep))


def strict_load(recs: DataFrame) -> DataFrame:
    """``(line_id, file_id, line_no, table_name, fields, cells)`` of the sound records."""
    sound = ~_bad_key(F.col("cells")) & ~_bad_value(F.col("cells"))
    return recs.where("cells IS NOT NULL").where(sound).select("line_id", "file_id", "line_no", "table_name", F.split("fields", "\t", -1).alias("fields"), "cells")


def load_rows(lines: DataFrame) -> DataFrame:
    """The strict load of raw export lines."""
    return strict_load(records(lines))


def rejected_rows(lines: DataFrame, recs: DataFrame | None = None) -> DataFrame:
    """``(line_id, reason)`` of the rows the strict load refused.

    First reason that holds: no_fields, nul, column_count, bad_key, bad_value. An undeclared
    key field is no reason. Empty input gives an empty result; columns other than line_id,
    file_id, line_no, line are ignored. The records (``recs``, where the caller has them) are
    stored once, because the load, the anti-join and the diagnosis all read them.
    """
    offsets = store(records(lines)) if recs is None else recs
    rest = split_rejects(offsets, strict_load(offsets), "line_id")
    reason = (
        F.when(F.col("fields").isNull(), "no_fields")
        .when(F.col("has_nul"), "nul")
        .when(~F.col("arity_ok"), "column_count")
        .when(_bad_key(F.col("cells")), "bad_key")
        .otherwise("bad_value")
    )
    return rest.select("line_id", reason.alias("reason"))


# ---------------------------------------------------------------- scan lines

# Possessive quantifiers keep the match iterative, so quote-heavy texts cannot exhaust the stack.
_COLUMN = r'(?:"[^"]*+(?:""[^"]*+)*+"|(?!")[^,]*+)'
_LINE = rf"\A{_COLUMN}(?:,{_COLUMN})*+\z"
#: A column with the comma before it; a line is read with one more comma in front, else an empty first column is no match of its own.
_EACH = rf",({_COLUMN})(?=,|\z)"


def parse_scans(log: DataFrame) -> DataFrame:
    """``(log_id, logged_at, quotes_ok, columns)``: scan lines split at their commas.

    A column that begins with a quote ends at its closing quote, a doubled quote inside is one
    quote. Header lines are no scans and are left out; a null line is an empty line.
    """
    raw = F.regexp_replace(F.coalesce(F.col("raw"), F.lit("")), r"\r\z", "")
    lines = log.select("log_id", "logged_at", raw.alias("raw")).where(F.col("raw") != ",".join(SCAN_COLUMNS))
    parts = F.regexp_extract_all(F.concat(F.lit(","), F.col("raw")), F.lit(_EACH), F.lit(1))
    plain = F.transform(
        parts,
        lambda p: F.when(p.startswith('"'), F.replace(F.substring(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))).otherwise(p),
    )
    # A line without a quote is split at its commas; only others take the patterns.
    quoted = F.contains("raw", F.lit('"'))
    ok = F.when(quoted, F.col("raw").rlike(_LINE)).otherwise(F.lit(True))
    columns = F.when(~quoted, F.split("raw", ",", -1)).when(F.col("quotes_ok"), plain)
    return lines.withColumn("quotes_ok", ok).select("log_id", "logged_at", "quotes_ok", columns.alias("columns"))


def _over(count: Column, limit: Column) -> Column:
    """Whether a digit text is a larger whole number than another, at any length."""
    a, b = (F.regexp_replace(x, r"\A0+(?=[0-9])", "") for x in (count, limit))
    return (F.length(a) > F.length(b)) | ((F.length(a) == F.length(b)) & (a > b))


def _scan_reason(columns: Column, quotes_ok: Column) -> Column:
    cell = {name: F.get(columns, F.lit(i)) for i, name in enumerate(SCAN_COLUMNS)}
    digits = F.lit(True)
    for name in SCAN_COUNTS:
        digits = digits & cell[name].rlike(r"\A[0-9]+\z")
    within = F.lit(True)
    for name in SCAN_WITHIN_BYTES:
        within = within & ~_over(cell[name], cell["bytes"])
    flags = F.lit(True)
    for name in SCAN_FLAGS:
        flags = flags & cell[name].isin("true", "false")
    good = is_real_instant(cell["scanned_at"]) & digits & within & cell["content_hash"].rlike(r"\A[0-9a-fA-F]{64}\z") & flags
    return (
        F.when(~quotes_ok, "broken_quote")
        .when(F.size(columns) != len(SCAN_COLUMNS), "column_count")
        .when(~cell["file_id"].rlike(r"\A0*[1-9][0-9]*\z"), "bad_key")
        .when(~good, "bad_value")
    )


def sound_scans(parsed: DataFrame) -> DataFrame:
    """The rows of ``parse_scans`` without a fault."""
    return parsed.where(_scan_reason(F.col("columns"), F.col("quotes_ok")).isNull())


def load_scans(log: DataFrame) -> DataFrame:
    """The strict load of scan lines, every column in its type."""
    cell = {name: F.get("columns", F.lit(i)) for i, name in enumerate(SCAN_COLUMNS)}
    types = {"file_id": "bigint", "scanned_at": "timestamp_ntz"} | dict.fromkeys(SCAN_COUNTS, "decimal(38,0)") | dict.fromkeys(SCAN_FLAGS, "boolean")
    return sound_scans(parse_scans(log)).select("log_id", "logged_at", *[cell[n].try_cast(types.get(n, "string")).alias(n) for n in SCAN_COLUMNS])


def rejected_scans(log: DataFrame) -> DataFrame:
    """``(log_id, reason)`` of refused scans: broken_quote, column_count, bad_key, bad_value. Lines are parsed once and stored."""
    offsets = store(parse_scans(log))
    rest = split_rejects(offsets, sound_scans(offsets), "log_id")
    return rest.select("log_id", _scan_reason(F.col("columns"), F.col("quotes_ok")).alias("reason"))


def found(lines: DataFrame, log: DataFrame) -> DataFrame:
    """Every refused record of both sources with its reason."""
    rows = rejected_rows(lines).select(F.lit("xer_line").alias("record_source"), F.col("line_id").cast("bigint").alias("record_id"), "reason")
    scans = rejected_scans(log).select(F.lit("scan_log").alias("record_source"), F.col("log_id").cast("bigint").alias("record_id"), "reason")
    return rows.unionByName(scans)
