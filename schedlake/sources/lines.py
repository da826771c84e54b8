"""Raw export lines to row records: markers, carried table and field list, joined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schedlake.operators.carry import carry_forward
from schedlake.session import store

#: The record markers of the export format.
MARKERS = ("ERMHDR", "%T", "%F", "%R", "%E")


def marker_of(line: Column) -> Column:
    """The marker a line starts with (whole line, or followed by TAB), else null."""
    head = F.substring_index(line, "\t", 1)
    return F.when(head.isin(*MARKERS), head)


def after_marker(line: Column) -> Column:
    """What follows the marker's TAB, the empty string where nothing does."""
    at = F.instr(line, "\t")
    return F.when(at > 0, F.substring(line, at + F.lit(1), F.length(line))).otherwise(F.lit(""))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``(line_id, file_id, line_no, line, marker)`` with one trailing CR dropped.

    A line without text counts as empty; a line without file or number belongs to no file
    and is left out.
    """
    text = F.regexp_replace(F.coalesce(F.col("line"), F.lit("")), r"\r\z", "")
    return (
        lines.where("file_id IS NOT NULL AND line_no IS NOT NULL")
        .select("line_id", "file_id", "line_no", text.alias("line"))
        .withColumn("marker", marker_of(F.col("line")))
    )


def carried_lines(lines: DataFrame, at_fields: dict[str, Column] | None = None) -> DataFrame:
    """``numbered_lines`` with what governs each line, in one carry over the file.

    Added: t_at and f_at (place and text of the last %T and %F), open (line_id and marker of the
    last marker line). ``at_fields`` adds to f_at what is worked out from a field list's
    ``text`` once, instead of once a row. Orders within a file are carried in chunks, so one
    file may hold most lines.
    """
    src = numbered_lines(lines).withColumn("text", after_marker(F.col("line")))
    more = [c.alias(n) for n, c in (at_fields or {}).items()]
    return carry_forward(
        src,
        ["file_id"],
        "line_no",
        ["line_no", "line_id"],
        {
            "t_at": F.when(F.col("marker") == "%T", F.struct("line_no", "line_id", "text")),
            "f_at": F.when(F.col("marker") == "%F", F.struct("line_no", "line_id", "text", *more)),
            "open": F.when(F.col("marker").isNotNull(), F.struct("line_id", "marker")),
        },
    ).drop("text")


def openers(carried: DataFrame, extras: list[str] | None = None) -> DataFrame:
    """The %R lines of ``carried_lines`` with their table, field list and text after the marker.

    Columns: line_id, file_id, line_no, table_name, fields (raw list text, null where no %F came
    since the last %T), line, and the ``extras`` of the field list. A second %F replaces the first.
    """
    governs = F.col("f_at").isNotNull() & (
        F.col("t_at").isNull() | (F.struct("f_at.line_no", "f_at.line_id") > F.struct("t_at.line_no", "t_at.line_id"))
    )
    return carried.where("marker = '%R'").select(
        "line_id", "file_id", "line_no", F.col("t_at.text").alias("table_name"), F.when(governs, F.col("f_at.text")).alias("fields"),
        after_marker(F.col("line")).alias("line"), *[F.when(governs, F.col(f"f_at.{n}")).alias(n) for n in extras or []],
    )


def continuations(carried: DataFrame) -> DataFrame:
    """The lines of ``carried_lines`` that continue a %R row: row_id, line_no, line_id, line. After any other marker a line belongs to nothing."""
    return carried.where("marker IS NULL AND open.marker = '%R'").select(F.col("open.line_id").alias("row_id"), "line_no", "line_id", "line")


def continued_rows(tails: DataFrame) -> DataFrame:
    """``(row_id, extra_tabs, extra_nul, extra_lines)`` of the rows that ``continuations`` go on."""
    return tails.groupBy("row_id").agg(
        F.sum(F.length("line") - F.length(F.translate("line", "\t", ""))).alias("extra_tabs"),
        F.max(F.contains("line", F.lit("\0"))).alias("extra_nul"),
        F.count("*").alias("extra_lines"),
    )


def row_records(lines: DataFrame) -> DataFrame:
    """One record per %R line: ``openers`` with extra_tabs, extra_nul and extra_lines of their continuation lines."""
    carried = store(carried_lines(lines))
    more = continued_rows(continuations(carried))
    return openers(carried).join(more, F.col("line_id") == F.col("row_id"), "left").drop("row_id")


def tail_text(tails: DataFrame) -> DataFrame:
    """``(row_id, tail)``: the continuation lines of each row joined by newlines, in order."""
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line_id", "line")))
    return tails.groupBy("row_id").agg(F.concat(F.lit("\n"), F.array_join(F.transform(parts, lambda p: p["line"]), "\n")).alias("tail"))
