"""Structured Streaming jobs: exports ingested as they arrive, events windowed with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from schedlake.operators import rejects
from schedlake.session import store
from schedlake.sources import exports


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def export_stream(spark: SparkSession, path: str, files_per_trigger: int = 200) -> DataFrame:
    """A stream of raw export files."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def ingest_batch(target: str) -> Callable[[DataFrame, int], None]:
    """A batch writer: scan facts, sound rows, and what was refused, of new files under ``target``, one folder a batch.

    ``refused`` has a row for each file that was not read (with its reason) and each row that
    was not loaded. A replayed batch overwrites its own folder, which makes the sink
    exactly-once.
    """

    def write(batch: DataFrame, number: int) -> None:
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")
        small = exports.unpacked(batch.where(F.col("length") <= exports.READ_CAP).select(F.col("path").alias("file_id"), "content"))
        big = batch.where(F.col("length") > exports.READ_CAP).select(F.col("path").alias("file_id"), F.lit("oversize").alias("reason"))
        put(exports.scan(small.where("refused IS NULL")), "scan")
        records = store(rejects.records(exports.file_lines(small)))
        put(rejects.strict_load(records), "rows")
        none = F.lit(None).cast("string")
        files = small.where("refused IS NOT NULL").select("file_id", F.col("refused").alias("reason")).unionByName(big).withColumn("line_id", none)
        put(files.unionByName(rejects.rejected_rows(records, records).join(records.select("line_id", "file_id"), "line_id")), "refused")

    return write


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Ingest all files now in ``source`` and stop; run again for what came since."""
    return (
        export_stream(spark, source).writeStream.foreachBatch(ingest_batch(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and value sums per event type and window; rows later than ``late`` behind are dropped by the watermark."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = stamped.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "value")
