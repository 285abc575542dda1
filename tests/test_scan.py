"""Running values in two levels against plain windows, and how rows of one key are spread."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from cueweave import schemas
from cueweave.functions import scan as S
from cueweave.operators import intervals, reports, transcript


def test_running_values_equal_plain_windows(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(50) / 2, i, rng.choice([None, 1.0, 2.5, -3.0])) for k in (1, 2, 3) for i in range(80)]
    df = spark.createDataFrame(rows, "k long, t double, i long, v double")
    own = Window.partitionBy("k").orderBy("t", "i")
    upto, rest = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)
    want = df.select(
        "k", "i", F.sum("v").over(upto).alias("total"), F.max("v").over(own.rowsBetween(Window.unboundedPreceding, -1)).alias("top"), F.last("v", True).over(upto).alias("seen"),
        F.first("v", True).over(rest).alias("next"), F.lag("v").over(own).alias("before"), F.lead("v").over(own).alias("after"), (F.row_number().over(own) - 1).alias("at"),
    )
    for seconds in (1.0, 7.0, 1000.0):
        bucket = S.by_time("t", seconds)
        got = S.scan(df, ["k"], ["t", "i"], bucket, total=S.Sum("v"), top=S.MaxBefore("v"), seen=S.LastSeen("v"), next=S.NextSeen("v"), before=S.Before("v"), after=S.After("v"))
        got = S.position(got, ["k"], ["t", "i"], bucket, "at")
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def hot(spark, n=30_000):
    """Words of many recordings, of which one has a third of all rows."""
    rec = F.when(F.col("id") % 3 == 0, 0).otherwise(1 + F.col("id") % 101)
    words = spark.range(n).select(rec.cast("long").alias("rec_id"), F.col("id").alias("ord"), F.concat(F.lit("w"), F.col("id") % 7).alias("word"), (F.col("id") * 2.0).alias("start"))
    return words.select("*", (F.col("start") + 1.0 + F.pmod(F.hash("ord"), F.lit(9))).alias("end"), F.concat(F.lit("s"), F.pmod(F.hash("ord", "word"), F.lit(3))).alias("speaker"), F.lit(False).alias("overlap_candidate"))


def test_a_hot_recording_is_spread(spark):
    words = hot(spark)
    decisions = words.filter("ord % 5 < 3").select("rec_id", F.col("ord").alias("seg_ord"), F.col("start").alias("start"), "end", F.lit("keep").alias("decision"), F.lit("").alias("reason"))
    ranges = intervals.keep_ranges(decisions)
    keys = words.filter("ord % 11 = 0").select("rec_id", F.col("start").alias("t"))
    ways = {
        "flags": lambda b: transcript.flag_overlaps(words, b), "turns": lambda b: transcript.speaker_turns(words, b), "merged": lambda b: intervals.coalesce_ranges(ranges, b),
        "near": lambda b: intervals.merge_small_gaps(ranges, 3.0, b), "snapped": lambda b: intervals.snap_to_words(ranges, words, b), "numbered": lambda b: intervals.number_ranges(ranges, b),
        "tiny": lambda b: intervals.absorb_tiny(intervals.coalesce_ranges(ranges), 6.0, b), "cuts": lambda b: reports.keyframe_method(intervals.number_ranges(ranges), keys, bucket_seconds=b),
        "remapped": lambda b: transcript.remap_words(words, intervals.number_ranges(intervals.coalesce_ranges(ranges)), b),
    }
    for name, way in ways.items():
        rounded = lambda df: df.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])
        assert sorted(map(str, rounded(way(500.0)).collect())) == sorted(map(str, rounded(way(1e12)).collect())), name
    rows = words.withColumn("b", S.by_time(seconds=500.0)).repartition(16, "rec_id", "b").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in rows) < 3 * words.count() / 16  # by rec_id alone one task would have a third of all


def test_a_hot_window_runs_by_bucket(spark):
    plan = transcript.flag_overlaps(hot(spark, 300))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(rec_id" in plan and "__bucket" in plan


def test_sentences_of_one_long_recording(spark):
    """A recording of a million tokens without punctuation, and one of a few."""
    n, size = 20_000, 50
    cues = spark.range(n).select(F.lit(1).cast("long").alias("rec_id"), F.col("id").alias("ord"), F.array_join(F.array_repeat(F.concat(F.lit("t"), F.col("id") % 10), size), " ").alias("word"),
        (F.col("id") * 3.0).alias("start"), (F.col("id") * 3.0 + F.when(F.col("id") % 7 == 0, 30.0).otherwise(4.0)).alias("end"), F.lit("A").alias("speaker"), F.lit(False).alias("overlap_candidate"))
    cues = cues.unionByName(spark.createDataFrame([(2, 0, "one two. three", 0.0, 3.0, None, False), (2, 1, "four", 3.0, 4.0, "B", False)], schemas.WORDS))
    want, first, number = [], 0, 0
    while first < n * size:
        last, cue = first, first // size
        while last < n * size - 1 and last - first < 39 and (last // size) * 3.0 + (30.0 if last // size % 7 == 0 else 4.0) - cue * 3.0 < 20.0:
            last += 1
        want.append((number, " ".join(f"t{t // size % 10}" for t in range(first, last + 1))))
        first, number = last + 1, number + 1
    got = transcript.sentences(cues)
    assert [tuple(r) for r in got.filter("rec_id = 1").select("seg_ord", "text").orderBy("seg_ord").collect()] == want
    assert [(r.text, r.speaker, r.start, r.end) for r in got.filter("rec_id = 2").orderBy("seg_ord").collect()] == [("one two.", None, 0.0, 2.0), ("three four", None, 2.0, 4.0)]
