"""What was kept and removed, and how to cut it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueweave.functions import scan as S
from cueweave.functions.text import three_decimals
from cueweave.operators.interval_join import overlapping

TOLERANCE = 2.0


def keyframe_method(ranges: DataFrame, keyframes: DataFrame, tolerance: float = TOLERANCE, bucket_seconds: float | None = None) -> DataFrame:
    """Ranges with the distance to the nearest keyframe and the cut method."""
    extra = F.struct("range_ord", "end").alias("r")
    both = ranges.select("rec_id", F.col("start").alias("t"), F.lit(1).alias("side"), extra).unionByName(keyframes.select("rec_id", "t", F.lit(0).alias("side")), allowMissingColumns=True)
    mark = F.when(F.col("side") == 0, F.col("t"))
    both = S.scan(both, ["rec_id"], ["t", "side"], S.by_time("t", bucket_seconds), before=S.LastSeen(mark), after=S.NextSeen(mark))
    near = both.withColumn("distance", F.coalesce(F.least(F.col("t") - F.col("before"), F.col("after") - F.col("t")), F.lit(float("inf")))).filter("side = 1")
    method = F.when(F.col("distance") <= tolerance, "copy").otherwise("reencode")
    return near.select("rec_id", "r.range_ord", F.col("t").alias("start"), "r.end", "distance", method.alias("method"))


def render_plan(ranges: DataFrame, keyframes: DataFrame, suffix: str = ".mp4") -> DataFrame:
    """A row for each clip: file name, method, start and duration (as numbers and as the text of
    a command line), and how clips are joined."""
    cut = keyframe_method(ranges, keyframes)
    clip = F.concat(F.format_string("clip_%04d", "range_ord"), F.lit(suffix))
    counts = ranges.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n"))
    return cut.join(counts, "rec_id").select("rec_id", "range_ord", clip.alias("clip"), "method", "start", F.greatest(F.col("end") - F.col("start"), F.lit(0.0)).alias("duration"), F.when(F.col("n") == 1, "copyfile").otherwise("concat").alias("join_by")).withColumns({"start_text": three_decimals(F.col("start")), "duration_text": three_decimals(F.col("duration"))})


def concat_list(plan: DataFrame) -> DataFrame:
    """The list file of each recording."""
    listed = plan.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("range_ord", "clip"))).alias("l"))
    return listed.select("rec_id", F.array_join(F.transform("l", lambda x: F.concat(F.lit("file '"), x["clip"], F.lit("'"))), "\n").alias("list"))


def edl_summary(ranges: DataFrame, recordings: DataFrame) -> DataFrame:
    kept = ranges.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_ranges"), F.sum(F.col("end") - F.col("start")).alias("kept"), F.max(F.col("end") - F.col("start")).alias("longest"))
    out = recordings.join(kept, "rec_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0.0)))
    return out.select("rec_id", F.coalesce("n_ranges", F.lit(0)).alias("n_ranges"), F.round("kept", 6).alias("kept_s"), F.round(F.col("duration") - F.col("kept"), 6).alias("removed_s"), F.round("longest", 6).alias("longest_s"))


def mode_summary(summary: DataFrame, jobs: DataFrame) -> DataFrame:
    """What was kept and removed over all recordings of a mode."""
    out = summary.join(jobs.select("rec_id", "mode"), "rec_id").groupBy("mode")
    out = out.agg(F.count(F.lit(1)).alias("n_recordings"), F.sum("n_ranges").alias("n_ranges"), F.sum("kept_s").alias("kept_s"), F.sum("removed_s").alias("removed_s"), F.max("longest_s").alias("longest_s"))
    return out.withColumn("removed_share", F.col("removed_s") / F.nullif(F.col("kept_s") + F.col("removed_s"), F.lit(0.0)))


def span_removed(spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """The share of each labelled span (rec_id, label, start, end) that no kept range covers.
    Ranges must not overlap each other; spans may."""
    key = ["rec_id", "label", "start", "end"]
    met = overlapping(spans.select(*key), ranges.select("rec_id", "start", "end"))
    inside = met.select("rec_id", "l.label", "l.start", "l.end", "shared").groupBy(*key).agg(F.sum("shared").alias("inside"))
    out = spans.select(*key).distinct().join(inside, key, "left")
    return out.select("rec_id", "label", F.round(1 - F.coalesce("inside", F.lit(0.0)) / (F.col("end") - F.col("start")), 6).alias("removed_share"))
