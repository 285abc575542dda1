"""Media probe documents and the gate on stream drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave import schemas
from cueweave.functions.text import trim_ws

MAX_DRIFT = 1.0


def tag_duration(tag: Column) -> Column:
    """Seconds of an H:M:S tag; null for anything else."""
    parts = F.split(trim_ws(tag), ":")
    value = [F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2, 3)]
    return F.when(F.size(parts) == 3, value[0] * 3600 + value[1] * 60 + value[2])


def stream_duration(stream: Column, container: Column) -> Column:
    """The first usable of duration, duration_ts x time_base, the duration tag, the container."""
    base = F.split(stream["time_base"], "/")
    ticks = F.try_divide(stream["duration_ts"].try_cast("double") * F.get(base, F.lit(0)).try_cast("double"), F.get(base, F.lit(1)).try_cast("double"))
    tag = F.coalesce(F.nullif(stream["tags"]["DURATION"], F.lit("")), stream["tags"]["duration"])
    return F.coalesce(stream["duration"].try_cast("double"), ticks, tag_duration(tag), container, F.lit(0.0))


def media_gate(probes: DataFrame, max_drift: float = MAX_DRIFT) -> DataFrame:
    """(rec_id, status, reason, duration, video_duration, audio_duration) of (rec_id, json) probes."""
    doc = probes.withColumn("p", F.from_json("json", schemas.PROBE))
    of = lambda kind: F.get(F.filter("p.streams", lambda s: s["codec_type"] == kind), F.lit(0))
    container = F.col("p.format.duration").try_cast("double")
    doc = doc.select("rec_id", of("video").alias("v"), of("audio").alias("a"), container.alias("container"))
    doc = doc.withColumn("video_duration", F.when(F.col("v").isNotNull(), stream_duration(F.col("v"), F.col("container"))))
    doc = doc.withColumn("audio_duration", F.when(F.col("a").isNotNull(), stream_duration(F.col("a"), F.col("container"))))
    drift = F.abs(F.col("video_duration") - F.col("audio_duration"))
    reason = F.when(F.col("v").isNull(), "no video stream").when(F.col("a").isNull(), "no audio stream").when(drift > max_drift, "streams drift")
    doc = doc.withColumn("reason", reason)
    duration = F.coalesce("container", F.greatest("video_duration", "audio_duration"))
    return doc.select("rec_id", F.when(F.col("reason").isNull(), "ok").otherwise("skipped_desync").alias("status"), "reason", F.when(F.col("reason").isNull(), duration).alias("duration"), "video_duration", "audio_duration")
