"""Pairs of intervals that meet, by a grid of cells of several widths.

An interval's level is the narrowest grid whose cells are as wide as it is long, so there it
lies in two cells at most, and in two at most of every wider grid.  A pair meets at the higher
of its two levels; of the cells that both lie in there, the one that holds the later start
reports it, so no pair comes twice.  An interval goes only to grids on which the other side
has intervals.  The join is on (recording, level, cell): no recording, long range or number of
overlaps puts everything into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The narrowest cells in seconds, and how many times wider those of the next level are.
NARROWEST, STEP = 4.0, 8.0


def _level(narrowest: float) -> Column:
    length = F.col("end") - F.col("start")
    return F.when(length <= narrowest, 0).otherwise(F.ceil(F.log(length / narrowest) / F.log(F.lit(STEP)))).cast("int")


def _width(level: Column, narrowest: float) -> Column:
    return narrowest * F.pow(F.lit(STEP), level)


def _in_cells(side: DataFrame, other: DataFrame, name: str, narrowest: float) -> DataFrame:
    """A row (rec_id, m, cell, name) for each cell in which an interval may meet others."""
    there = other.groupBy("rec_id").agg(F.collect_set("level").alias("levels"))
    own = F.col("level")
    at = F.filter("levels", lambda m: m >= own)
    at = F.when(F.exists("levels", lambda m: m < own), F.array_union(at, F.array(own))).otherwise(at)
    rows = side.join(there, "rec_id").withColumn("m", F.explode(at)).drop("levels")
    low, high = (F.floor(F.col(c) / _width(F.col("m"), narrowest)) for c in ("start", "end"))
    rows = rows.withColumn("cell", F.explode(F.sequence(low, high)))
    return rows.select("rec_id", "m", "cell", F.struct(*[c for c in rows.columns if c not in ("rec_id", "m", "cell")]).alias(name))


def meeting(left: DataFrame, right: DataFrame, narrowest: float = NARROWEST) -> DataFrame:
    """(rec_id, l, r) of all pairs of one recording whose closed intervals have a point in common.

    Both sides have rec_id, start, end and any other columns, which come in the structs l and
    r.  Intervals without an edge, and ones that end before they start, meet nothing.
    """
    sound = "start <= end and rec_id is not null"
    left, right = (df.filter(sound).withColumn("level", _level(narrowest)) for df in (left, right))
    both = _in_cells(left, right, "l", narrowest).join(_in_cells(right, left, "r", narrowest), ["rec_id", "m", "cell"])
    first = F.floor(F.greatest("l.start", "r.start") / _width(F.col("m"), narrowest))
    both = both.filter((F.greatest("l.level", "r.level") == F.col("m")) & (first == F.col("cell")) & (F.col("l.start") <= F.col("r.end")) & (F.col("r.start") <= F.col("l.end")))
    return both.select("rec_id", F.col("l").dropFields("level").alias("l"), F.col("r").dropFields("level").alias("r"))


def overlapping(left: DataFrame, right: DataFrame, narrowest: float = NARROWEST) -> DataFrame:
    """The pairs (rec_id, l, r) that share more than a point, with their ``shared`` seconds."""
    shared = F.least("l.end", "r.end") - F.greatest("l.start", "r.start")
    return meeting(left, right, narrowest).withColumn("shared", shared).filter("shared > 0")


def contained(inner: DataFrame, outer: DataFrame, narrowest: float = NARROWEST) -> DataFrame:
    """The pairs (rec_id, l, r) in which r holds all of l, edges included."""
    return meeting(inner, outer, narrowest).filter("l.start >= r.start and l.end <= r.end")
