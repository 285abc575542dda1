"""Interval algebra over time ranges of recordings.

Ranges of a recording are few as a rule, so windows partition by ``rec_id`` and one exchange
serves a chain of operators.  With ``bucket_seconds`` what runs along a recording is found
in two levels, by recording and bucket of time (``functions.scan``), and steps are written
in between, so that a recording may hold any share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.functions import scan as S
from cueweave.functions.storage import materialise

MIN_GAP, MIN_SEGMENT = 0.3, 0.5
BUCKET_RANGES = 4096


def cut_lineage(df: DataFrame, bucket_seconds: float | None) -> DataFrame:
    """``df``, written where scans in two levels would evaluate it again and again."""
    return df if bucket_seconds is None else materialise(df, "scan")


def keep_ranges(decisions: DataFrame) -> DataFrame:
    """Ranges judged keep that have a length."""
    return decisions.filter("decision = 'keep' and end > start").select("rec_id", "start", "end")


def _merge(ranges: DataFrame, breaks, bucket_seconds: float | None) -> DataFrame:
    """Merge ranges into islands; ``breaks(start, latest end so far)`` begins a new one."""
    order, bucket = ["start", "end"], S.by_time(seconds=bucket_seconds)
    marked = S.scan(ranges.select("rec_id", "start", "end"), ["rec_id"], order, bucket, latest=S.MaxBefore("end"))
    marked = marked.withColumn("new", F.coalesce(breaks(F.col("start"), F.col("latest")), F.lit(True)).cast("int"))
    marked = S.scan(cut_lineage(marked, bucket_seconds), ["rec_id"], order, bucket, island=S.Sum("new"))
    return marked.groupBy("rec_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("rec_id", "start", "end")


def coalesce_ranges(ranges: DataFrame, bucket_seconds: float | None = None) -> DataFrame:
    """Merge ranges that overlap or touch."""
    return _merge(ranges, lambda start, latest: start > latest, bucket_seconds)


def merge_small_gaps(ranges: DataFrame, min_gap: float = MIN_GAP, bucket_seconds: float | None = None) -> DataFrame:
    """Merge ranges less than ``min_gap`` apart; a gap of exactly that stays."""
    return _merge(ranges, lambda start, latest: start - latest >= min_gap, bucket_seconds)


def absorb_tiny(ranges: DataFrame, min_duration: float = MIN_SEGMENT, bucket_seconds: float | None = None) -> DataFrame:
    """Join ranges shorter than ``min_duration`` to the next one, the last to the one before.

    A range that is long enough ends whatever is open before it, so only the run of
    short ranges up to it is folded, never all ranges of a recording.
    """
    item = "struct<start:double,end:double>"
    start = F.struct(F.array().cast(f"array<{item}>").alias("done"), F.lit(None).cast(item).alias("open"))

    def step(acc: Column, r: Column) -> Column:
        cur = F.struct(F.coalesce(acc["open"]["start"], r["start"]).alias("start"), r["end"].alias("end"))
        full = cur["end"] - cur["start"] >= min_duration
        return F.struct(F.when(full, F.concat(acc["done"], F.array(cur))).otherwise(acc["done"]).alias("done"), F.when(~full, cur).alias("open"))

    order, bucket = ["start", "end"], S.by_time(seconds=bucket_seconds)
    marked = ranges.select("rec_id", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    marked = marked.withColumn("long", (F.col("end") - F.col("start") >= min_duration).cast("int"))
    marked = S.scan(marked, ["rec_id"], order, bucket, run=S.Sum("long")).withColumn("run", F.col("run") - F.col("long"))
    folded = marked.groupBy("rec_id", "run").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("start", "end"))), start, step).alias("f"))
    # What a recording's last run leaves open goes to the range before it, or away if there is none.
    rows = folded.select("rec_id", F.explode(F.concat(F.transform("f.done", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.lit(False).alias("left"))),
        F.when(F.col("f.open").isNotNull(), F.array(F.struct("f.open.start", "f.open.end", F.lit(True).alias("left")))).otherwise(F.array().cast("array<struct<start:double,end:double,left:boolean>>")))).alias("r")).select("rec_id", "r.*")
    rows = S.scan(cut_lineage(rows, bucket_seconds), ["rec_id"], order, bucket, after=S.After(F.when(F.col("left"), F.col("end"))))
    return rows.filter("not left").select("rec_id", "start", F.greatest("end", "after").alias("end"))


def word_at(points: DataFrame, words: DataFrame, bucket_seconds: float | None = None) -> DataFrame:
    """As-of join: the points (rec_id, t, ...) with ``found``, the last word starting at or
    before t (among equal starts the last in order)."""
    extra = [c for c in points.columns if c not in ("rec_id", "t")]
    told = [c for c in ("ord", "start", "end", "offset") if c in words.columns]
    left = words.select("rec_id", F.col("start").alias("t"), F.lit(0).alias("side"), "ord", F.struct(*told).alias("w"))
    right = points.select("rec_id", "t", F.lit(1).alias("side"), F.lit(0).cast("long").alias("ord"), F.struct(*extra).alias("p"))
    both = left.unionByName(right, allowMissingColumns=True)
    both = S.scan(both, ["rec_id"], ["t", "side", "ord"], S.by_time("t", bucket_seconds), found=S.LastSeen("w"))
    return both.filter("side = 1").select("rec_id", "t", "p.*", "found")


def snap_to_words(ranges: DataFrame, words: DataFrame, bucket_seconds: float | None = None) -> DataFrame:
    """Move edges that fall inside a word out to the word's edge."""
    ranges = ranges.groupBy("rec_id", "start", "end").agg(F.count(F.lit(1)).alias("n"))  # repeated ranges are moved once
    edges = ranges.select("rec_id", F.struct("start", "end", "n").alias("range"), F.explode(F.array(F.struct(F.lit("s").alias("edge"), F.col("start").alias("t")), F.struct(F.lit("e").alias("edge"), F.col("end").alias("t")))).alias("x"))
    found = word_at(edges.select("rec_id", "x.t", "range", "x.edge"), words, bucket_seconds)
    inside = (F.col("found.start") < F.col("t")) & (F.col("t") < F.col("found.end"))
    to = F.when(F.coalesce(inside, F.lit(False)), F.when(F.col("edge") == "s", F.col("found.start")).otherwise(F.col("found.end"))).otherwise(F.col("t"))
    moved = found.withColumn("to", to).groupBy("rec_id", "range").agg(F.max(F.when(F.col("edge") == "s", F.col("to"))).alias("start"), F.max(F.when(F.col("edge") == "e", F.col("to"))).alias("end"))
    moved = moved.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("range.n"))))
    return moved.select("rec_id", "start", F.greatest("end", "start").alias("end"))


def number_ranges(ranges: DataFrame, bucket_seconds: float | None = None) -> DataFrame:
    numbered = S.position(ranges.select("rec_id", "start", "end"), ["rec_id"], ["start", "end"], S.by_time(seconds=bucket_seconds), "range_ord")
    return numbered.select("rec_id", "range_ord", "start", "end")


def build_edl(decisions: DataFrame, words: DataFrame, recordings: DataFrame, min_gap: float = MIN_GAP, min_duration: float = MIN_SEGMENT, bucket_seconds: float | None = None) -> DataFrame:
    """Kept ranges (rec_id, range_ord, start, end) of every recording.

    A recording with nothing left keeps its whole length; ranges are clamped to the
    recording unless its duration is 0.
    """
    step = lambda df: cut_lineage(df, bucket_seconds)
    kept = snap_to_words(step(coalesce_ranges(keep_ranges(decisions), bucket_seconds)), words, bucket_seconds)
    kept = step(merge_small_gaps(step(coalesce_ranges(step(kept), bucket_seconds)), min_gap, bucket_seconds))
    kept = step(absorb_tiny(kept, min_duration, bucket_seconds))
    whole = recordings.select("rec_id", "duration").join(kept, "rec_id", "left")
    end = F.coalesce("end", "duration")
    ranges = whole.select("rec_id", F.greatest(F.lit(0.0), F.coalesce("start", F.lit(0.0))).alias("start"), F.when(F.col("duration") != 0, F.least(end, F.col("duration"))).otherwise(end).alias("end"))
    return number_ranges(step(ranges), bucket_seconds)


def checked_edl(decisions: DataFrame, words: DataFrame, recordings: DataFrame, min_gap: float = MIN_GAP, min_duration: float = MIN_SEGMENT, bucket_seconds: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(ranges, violations): the kept ranges of the recordings whose ranges are sound, and what
    is wrong with those of the others."""
    # Written: they are read for what is sound, for what is not, and by whoever asks for either.
    ranges = materialise(build_edl(decisions, words, recordings, min_gap, min_duration, bucket_seconds), "ranges")
    wrong = edl_violations(ranges, bucket_ranges=None if bucket_seconds is None else BUCKET_RANGES)
    return ranges.join(wrong.select("rec_id").distinct(), "rec_id", "left_anti"), wrong


def edl_violations(ranges: DataFrame, strict: bool = False, bucket_ranges: int | None = None) -> DataFrame:
    """Ranges (in the order of range_ord) without a length, or that start before the one before ends."""
    near = S.scan(ranges.select("rec_id", "range_ord", "start", "end"), ["rec_id"], ["range_ord"], None if bucket_ranges is None else F.floor(F.col("range_ord") / bucket_ranges), before=S.Before("end"))
    kind = F.when(F.col("end") <= F.col("start"), "empty").when(F.col("start") < F.col("before"), "overlap")
    found = near.withColumn("kind", kind).filter("kind is not null").select("rec_id", "range_ord", "kind")
    if strict and not found.isEmpty():
        raise ValueError("ranges overlap, are out of order or have no length")
    return found


def nested_edl(ranges: DataFrame, recordings: DataFrame) -> DataFrame:
    """One row for each recording: its ranges as an array and its duration."""
    listed = ranges.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("range_ord", "start", "end"))).alias("list"))
    listed = listed.select("rec_id", F.transform("list", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("ranges"))
    return listed.join(recordings.select("rec_id", F.col("duration").alias("source_duration")), "rec_id")
