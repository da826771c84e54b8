"""Queries of the text problems over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.functions.text import byte_text, decode_report
from schedlake.llm import leakage, mojibake, packing, splitting
from schedlake.session import store
from schedlake.sources.tables import table


def names(spark: SparkSession, folder: str) -> DataFrame:
    """All task and WBS names as (record_source, record_id, text)."""
    task = table(spark, folder, "task").select(F.lit("task").alias("record_source"), F.col("task_id").alias("record_id"), F.col("task_name").alias("text"))
    wbs = table(spark, folder, "projwbs").select(F.lit("projwbs").alias("record_source"), F.col("wbs_id").alias("record_id"), F.col("wbs_name").alias("text"))
    return task.unionByName(wbs).where("record_id IS NOT NULL")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose name was read in the wrong encoding, restorable or not."""
    return mojibake.restore_names(names(spark, folder)).select("record_source", "record_id").distinct()


def p3_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The garbled names with what they said, null where that is lost."""
    return mojibake.restore_names(names(spark, folder)).distinct()


def p3_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per file its stored UTF-8 run count beside the garbled names found in it: what the byte facts show, and whether both say the same.

    Names are those of the file's tasks and of its projects' WBS nodes. ``n_utf8`` counts the
    found names that are UTF-8 read as single bytes, the kind the byte facts can show; they
    know no other kind, and no names that a single-byte file cannot hold.
    """
    found = store(mojibake.restore_names(names(spark, folder)).distinct())
    task = table(spark, folder, "task").where("file_id IS NOT NULL").select(F.lit("task").alias("record_source"), F.col("task_id").alias("record_id"), "file_id", F.col("task_name").alias("text"))
    files = table(spark, folder, "project").where("file_id IS NOT NULL").select("proj_id", "file_id").distinct()
    wbs = table(spark, folder, "projwbs").join(files, "proj_id").select(F.lit("projwbs").alias("record_source"), F.col("wbs_id").alias("record_id"), "file_id", F.col("wbs_name").alias("text"))
    kind = decode_report(byte_text(F.col("text")))["utf8_sequence_count"] > 0
    held = task.unionByName(wbs).distinct().join(found, ["record_source", "record_id", "text"], "left_semi")
    counts = held.groupBy("file_id").agg(F.count("*").alias("n_garbled"), F.count_if(kind).alias("n_utf8"))
    stored = table(spark, folder, "decode_report").select("file_id", "utf8_sequence_count")
    out = stored.join(counts, "file_id", "full").na.fill(0, ["n_garbled", "n_utf8"])
    agrees = F.when(F.col("utf8_sequence_count").isNotNull(), (F.col("utf8_sequence_count") > 0) == (F.col("n_utf8") > 0))
    return out.select("file_id", "utf8_sequence_count", "n_garbled", "n_utf8", agrees.alias("agrees"))


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's tokens placed into containers of 2,048."""
    return packing.pack_documents(table(spark, folder, "documents"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used and tokens they leave unused, packed as the documents arrive and largest first."""
    items = store(packing.token_items(table(spark, folder, "documents")))
    rows = [packing.pack(items, largest_first=x).select(F.lit(n).alias("arrival"), "container", "n_tokens") for n, x in (("in order", False), ("largest first", True))]
    used = rows[0].unionByName(rows[1]).groupBy("arrival").agg(F.count_distinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return used.withColumn("n_unused", F.col("n_containers") * packing.CAPACITY - F.col("n_tokens"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a held-out passage, and whose it is."""
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item")).select("doc_id", "item_id").distinct()


def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus without leaked passages: spans cut, documents that are mostly leak dropped."""
    docs = table(spark, folder, "documents")
    return leakage.remove_leaks(docs, store(leakage.leaks(docs, table(spark, folder, "eval_item"))))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that had to be cut."""
    return splitting.split_documents(table(spark, folder, "documents")).select("doc_id").distinct()


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every oversized text."""
    return splitting.split_documents(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_restored, p3_files, p6_packed, p6_fill, p7_found, p7_clean, p8_found, p8_pieces)}

ORACLES: dict[str, str] = {}
