"""The interval join against all pairs."""

import random

from pyspark.sql import functions as F

from cueweave import schemas
from cueweave.operators import interval_join as ij
from cueweave.operators import reports, transcript

KIND = "rec_id long, id long, start double, end double"


def some(rng, n, recs=3):
    out = []
    for i in range(n):
        start = rng.randrange(-400, 4000) / 4
        out.append((rng.randrange(recs), i, start, start + rng.choice([0.0, 0.25, 1.0, 4.0, 4.25, 30.0, 256.0, 900.0, 50_000.0])))
    return [*out, (0, n, 5.0, 4.0), (1, n + 1, None, 3.0), (2, n + 2, 1.0, None), (None, n + 3, 0.0, 9.0)]


def pairs(df):
    return sorted((r.rec_id, r.l.id, r.r.id) for r in df.collect())


def test_all_pairs(spark):
    rng = random.Random(2)
    left, right = some(rng, 150), some(rng, 120)
    a, b = spark.createDataFrame(left, KIND).withColumn("level", F.lit("clash")).withColumn("m", F.lit(1)), spark.createDataFrame(right, KIND).withColumn("cell", F.lit(0))
    sound = [(x, y) for x in left for y in right if None not in (*x, *y) and x[0] == y[0] and x[2] <= x[3] and y[2] <= y[3]]
    for narrowest in (0.5, 4.0, 1000.0):
        assert pairs(ij.meeting(a.drop("level", "m"), b.drop("cell"), narrowest)) == sorted((x[0], x[1], y[1]) for x, y in sound if x[2] <= y[3] and y[2] <= x[3])
    assert pairs(ij.overlapping(a, b)) == sorted((x[0], x[1], y[1]) for x, y in sound if min(x[3], y[3]) > max(x[2], y[2]))
    assert pairs(ij.contained(a, b)) == sorted((x[0], x[1], y[1]) for x, y in sound if y[2] <= x[2] and x[3] <= y[3])
    assert ij.meeting(a, b.limit(0)).isEmpty() and ij.meeting(a.limit(0), b).isEmpty()


def test_an_interval_meets_few_cells(spark):
    rng = random.Random(3)
    left, right = (spark.createDataFrame(some(rng, 300), KIND).filter("start <= end and rec_id is not null").withColumn("level", ij._level(4.0)) for _ in range(2))
    levels = right.select("level").distinct().count()
    most = ij._in_cells(left, right, "l", 4.0).groupBy("rec_id", "l.id").count().agg(F.max("count")).first()[0]
    assert most <= 2 * (levels + 1)


def test_remapping_into_overlapping_ranges(spark):
    words = spark.createDataFrame([(1, i, f"w{i}", float(i), i + 1.0, "A", False) for i in range(10)], schemas.WORDS)
    ranges = spark.createDataFrame([(1, 0, 1.0, 4.0), (1, 1, 3.0, 5.5), (1, 2, 9.0, 9.5)], schemas.RANGES)
    got = sorted((r.range_ord, r.word, r.start) for r in transcript.remap_words_of_any(words, ranges).collect())
    assert got == [(0, "w1", 0.0), (0, "w2", 1.0), (0, "w3", 2.0), (1, "w3", 3.0), (1, "w4", 4.0)]


def test_share_removed_of_overlapping_spans(spark):
    spans = spark.createDataFrame([(1, "a", 0.0, 10.0), (1, "b", 5.0, 7.0), (2, "a", 0.0, 4.0)], "rec_id long, label string, start double, end double")
    ranges = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 1, 6.0, 12.0)], schemas.RANGES)
    got = {(r.rec_id, r.label): r.removed_share for r in reports.span_removed(spans, ranges).collect()}
    assert got == {(1, "a"): 0.5, (1, "b"): 0.5, (2, "a"): 1.0}


def test_pairs_are_not_joined_again_for_their_offsets(spark):
    words = spark.createDataFrame([(1, 0, "a", 1.0, 2.0, "A", False), (1, 1, "b", 6.0, 7.0, "A", False)], schemas.WORDS)
    ranges = spark.createDataFrame([(1, 0, 0.0, 4.0), (1, 1, 5.0, 8.0), (1, 2, 0.0, 9.0)], "rec_id long, range_ord long, start double, end double")
    moved = transcript.remap_words_of_any(words, ranges)
    assert sorted((r.ord, r.range_ord, r.start, r.end) for r in moved.collect()) == [(0, 0, 1.0, 2.0), (0, 2, 8.0, 9.0), (1, 1, 5.0, 6.0), (1, 2, 13.0, 14.0)]
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(moved) == joins(transcript.words_in_ranges(words, ranges))
