"""Streaming forms of a few operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from cueweave.operators.intervals import coalesce_ranges, merge_small_gaps
from cueweave.operators.jobs import latest_state
from cueweave.sources.subtitles import TRANSCRIPT_SUFFIXES, parse_subtitles, with_suffix
from cueweave.streaming.state import BUCKETS, BucketedTable

MERGED = "rec_id long, start double, end double"


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def upsert_jobs(events: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> DataStreamWriter:
    """Keep the latest state of every job (job_id, seq, ts, ...) under ``path``.

    A batch rewrites only the buckets of the jobs that it has news of; see ``streaming.state``.
    """
    table = BucketedTable(path, _ddl(events), "job_id", buckets)
    return events.writeStream.foreachBatch(lambda batch, epoch: table.fold(batch, epoch, latest_state)).option("checkpointLocation", checkpoint)


def read_jobs(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The newest whole version that ``upsert_jobs`` wrote; ``columns`` is the schema of the events."""
    return BucketedTable(path, columns, "job_id").read(spark)


def upsert_ranges(ranges: DataFrame, path: str, checkpoint: str, min_gap: float = 0.0, buckets: int = BUCKETS) -> DataStreamWriter:
    """Keep the merged ranges of every recording (rec_id, start, end) under ``path``.

    Rows may come in any order and as late as they like: one that touches ranges which are
    there extends or joins them.  Once all have come, the table equals the batch operator's.
    """
    table = BucketedTable(path, MERGED, "rec_id", buckets)
    merge = (lambda rows: merge_small_gaps(rows, min_gap)) if min_gap else coalesce_ranges
    fold = lambda batch, epoch: table.fold(batch.select("rec_id", "start", "end").filter("start is not null and end is not null"), epoch, merge)
    return ranges.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version that ``upsert_ranges`` wrote."""
    return BucketedTable(path, MERGED, "rec_id").read(spark)


def subtitle_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """(rec_id, text) of caption files as they arrive, by the rules of ``read_subtitles``: rec_id
    is a hash of the path, other suffixes are passed over, bad bytes are replaced."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    files, _ = with_suffix(spark.readStream.format("binaryFile").schema(kind).load(folder), TRANSCRIPT_SUFFIXES)
    return files.select(F.xxhash64("path").alias("rec_id"), F.expr("make_valid_utf8(cast(content as string))").alias("text"))


def write_cues(files: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Parse each batch of caption files and append its cues."""
    return files.writeStream.foreachBatch(lambda batch, epoch: parse_subtitles(batch).write.mode("overwrite").parquet(f"{path}/batch={epoch}")).option("checkpointLocation", checkpoint)


def coalesce_stream(ranges: DataFrame, min_gap: float = 0.0, delay: str = "1 hour") -> DataFrame:
    """Merge kept ranges (rec_id, ts, seconds) that touch, or lie less than ``min_gap`` apart.

    Each merged range comes once, when the watermark has passed it, and rows behind the
    watermark are dropped; ``upsert_ranges`` loses none."""
    longer = max(0, round(min_gap * 1e6) - 1) if min_gap else 0
    length = F.concat(F.format_string("%.0f", F.round(F.col("seconds") * 1e6) + longer), F.lit(" microseconds"))
    marked = ranges.withWatermark("ts", delay)
    out = marked.groupBy("rec_id", F.session_window("ts", length).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    end = F.timestamp_micros(F.unix_micros("w.end") - longer)
    return out.select("rec_id", F.col("w.start").alias("start"), end.alias("end"), "n")
