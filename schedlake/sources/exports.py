"""Whole export files: binary read, capped gunzip, decoding to lines, typed tables, byte facts."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.functions.numbers import blank_trim, to_number
from schedlake.functions.text import decode_cp1252, decode_report

#: Bytes an export may have, and bytes above which it is not even read.
BYTE_CAP, READ_CAP = 62_914_560, 125_829_120

#: Columns of the typed tables; num is a double, id a whole number, text is kept as written.
TYPED = {
    "TASK": {
        "task_id": "id", "task_code": "text", "task_name": "text", "wbs_id": "id", "clndr_id": "text", "proj_id": "text", "task_type": "text",
        "status_code": "text", "target_drtn_hr_cnt": "num", "remain_drtn_hr_cnt": "num", "total_float_hr_cnt": "num", "early_start_date": "text",
        "early_end_date": "text", "act_start_date": "text", "act_end_date": "text", "target_start_date": "text", "target_end_date": "text",
        "cstr_type": "text", "driving_path_flag": "text",
    },
    "TASKPRED": {"task_id": "id", "pred_task_id": "id", "proj_id": "text", "pred_proj_id": "text", "pred_type": "text", "lag_hr_cnt": "num"},
    "PROJWBS": {"wbs_id": "id", "parent_wbs_id": "id", "wbs_short_name": "text", "wbs_name": "text", "proj_node_flag": "text", "proj_id": "text"},
    "PROJECT": {
        "proj_id": "text", "proj_short_name": "text", "clndr_id": "text", "last_recalc_date": "text", "critical_drtn_hr_cnt": "num",
        "plan_start_date": "text", "plan_end_date": "text", "add_by_name": "text",
    },
    "CALENDAR": {"clndr_id": "id", "clndr_name": "text", "clndr_type": "text", "default_flag": "text", "day_hr_cnt": "num", "week_hr_cnt": "num", "clndr_data": "text"},
    "RSRC": {"rsrc_name": "text", "rsrc_type": "text", "email_addr": "text", "office_phone": "text", "other_phone": "text", "employee_code": "text", "rsrc_notes": "text"},
    "TASKRSRC": {"task_id": "id"},
    "ACTVTYPE": {"actv_code_type_id": "text", "actv_code_type": "text"},
    "ACTVCODE": {"actv_code_type_id": "text"},
    "TASKACTV": {"task_id": "id", "actv_code_type_id": "text", "actv_code_id": "text"},
}
#: The fields of the header record, by position after the marker.
HEADER = {"version": 1, "exported_on": 2, "export_type": 3, "login": 4, "user_name": 5, "database": 6, "currency": 8}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file_id, content, length, refused)`` of export files, unpacked where they are gzip.

    A file that is not read has null content and the reason in ``refused``: oversize above the
    read cap, byte_cap where it unpacks beyond the byte cap, broken_gzip where it cannot be
    unpacked to its end. Spark's file reader passes over files of no bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # The size filter reaches the reader, so the content of a file above the cap is never loaded.
    small = unpacked(files.where(F.col("length") <= READ_CAP).select(F.col("path").alias("file_id"), "content"))
    big = files.select("path", "length").where(F.col("length") > READ_CAP)
    return small.unionByName(big.select(F.col("path").alias("file_id"), F.lit(None).cast("binary").alias("content"), "length", F.lit("oversize").alias("refused")))


def _gunzip(data: bytes | None, cap: int) -> tuple[bytes | None, str | None]:
    """The unpacked bytes of all members, or why there are none; what follows the last member must be padding."""
    if data is None or data[:2] != b"\x1f\x8b":
        return data, None
    parts, size = [], 0
    while data[:2] == b"\x1f\x8b":
        unpack = zlib.decompressobj(wbits=31)
        try:
            parts.append(unpack.decompress(data, cap + 1 - size))
        except zlib.error:
            return None, "broken_gzip"
        size += len(parts[-1])
        if size > cap:
            return None, "byte_cap"
        if not unpack.eof:
            return None, "broken_gzip"
        data = unpack.unused_data
    return (None, "broken_gzip") if data.strip(b"\0") else (b"".join(parts), None)


def unpacked(files: DataFrame, cap: int = BYTE_CAP) -> DataFrame:
    """``(file_id, content, length, refused)`` of ``files(file_id, content)``: gzip unpacked up to the cap, other content as it is."""

    def run(content: pd.Series) -> pd.DataFrame:
        got = [_gunzip(None if b is None else bytes(b), cap) for b in content]
        return pd.DataFrame({"content": pd.Series([c for c, _ in got], dtype=object), "refused": pd.Series([r for _, r in got], dtype=object)})

    out = files.withColumn("u", F.pandas_udf(run, "content binary, refused string")("content"))
    return out.select("file_id", F.col("u.content").alias("content"), F.octet_length(F.coalesce("u.content", "content")).cast("bigint").alias("length"), F.col("u.refused").alias("refused"))


def file_lines(files: DataFrame) -> DataFrame:
    """``(line_id, file_id, line_no, line)`` of decoded files, numbered from 1; lines end at LF alone.

    One file is one row, bounded by the byte cap, so its lines come from one task.
    """
    text = decode_cp1252(F.col("content"))
    lines = files.where("content IS NOT NULL").select("file_id", F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    # What follows the last LF is a line only if it holds something.
    lines = lines.withColumn("line_no", F.col("pos") + 1)
    return lines.where((F.col("line") != "") | (F.col("pos") == 0)).select(
        F.concat_ws(":", "file_id", F.format_string("%010d", "line_no")).alias("line_id"), "file_id", "line_no", "line"
    )


def cell(name: str, fields: str = "fields", cells: str = "cells") -> Column:
    """A row's cell by field name: the first of a repeated name; null where the field is absent."""
    return F.get(cells, F.array_position(F.transform(fields, lambda f: F.lower(f)), name).cast("int") - 1)


def typed_table(rows: DataFrame, name: str) -> DataFrame:
    """A table of loaded rows (line_id, file_id, line_no, table_name, fields, cells) with typed columns.

    Only that table's cells are read. A row whose leading id is no number is dropped where the
    table has one. Text is trimmed; empty is null; absent fields are null.
    """

    def typed(col: str, kind: str) -> Column:
        if kind == "text":
            return F.nullif(blank_trim(cell(col)), F.lit("")).alias(col)
        number = to_number(cell(col))
        return (number.cast("bigint") if kind == "id" else number).alias(col)

    spec = TYPED[name]
    out = rows.where(F.col("table_name") == name).select("file_id", "line_no", *[typed(c, k) for c, k in spec.items()])
    first, kind = next(iter(spec.items()))
    return out.where(F.col(first).isNotNull()) if kind == "id" else out


def headers(lines: DataFrame) -> DataFrame:
    """The positional header record of each file, its first; empty parts are null."""
    parts = F.split(F.regexp_replace("line", r"\r\z", ""), "\t", -1)
    first = lines.where(F.col("line").rlike(r"\AERMHDR(\t|\r?\z)")).groupBy("file_id").agg(F.min_by(parts, F.struct("line_no", "line_id")).alias("h"))
    return first.select("file_id", *[F.nullif(F.get("h", F.lit(i)), F.lit("")).alias(n) for n, i in HEADER.items()])


def readability(text: Column) -> dict[str, Column]:
    """Facts of a file's bytes as Latin-1 text: its ends, NULs, and bytes before a trailing NUL run."""
    n = F.length(text)
    kept = F.length(F.rtrim(text, F.lit("\0")))
    return {
        "starts_with_ermhdr": text.startswith("ERMHDR"),
        "reaches_end_marker": text.rlike(r"(?:\A|\n)%E[\r\n]*\z"),
        "nul_byte_count": n - F.length(F.translate(text, "\0", "")),
        "trailing_nul_run": n - kept,
        "complete_bytes": kept,
    }


def scan(files: DataFrame) -> DataFrame:
    """One row a file: size, hash, decode report, readability. No file is parsed."""
    latin = F.decode("content", "iso-8859-1")
    facts = decode_report(latin) | readability(latin)
    return files.select("file_id", F.col("length").alias("bytes"), F.sha2("content", 256).alias("content_hash"), *[c.alias(n) for n, c in facts.items()])


def verdict(facts: DataFrame, cap: int = 20_000) -> DataFrame:
    """The first guard that refuses each file, or accept.

    Needs bytes, reaches_end_marker, nul_byte_count, starts_with_ermhdr, tokenizer_ok,
    activity_count, project_count.
    """
    guard = (
        F.when(F.col("bytes") > READ_CAP, "oversize")
        .when(~F.col("reaches_end_marker") | (F.col("nul_byte_count") > 0), "unreadable")
        .when(~F.col("starts_with_ermhdr"), "not_xer")
        .when(~F.col("tokenizer_ok"), "tokenizer")
        .when(F.col("activity_count") == 0, "no_activities")
        .when(F.col("project_count") > 1, "multi_project")
        .when(F.col("activity_count") > cap, "activity_cap")
        .when(F.col("bytes") > BYTE_CAP, "byte_cap")
        .otherwise("accept")
    )
    return facts.withColumn("verdict", guard)
