"""Running values over the rows of a key in two levels, so that no key needs one task.

Rows of a key are cut into buckets along their order (hours of a recording, say).  Windows
run within buckets; each bucket gives a summary row; windows over a key's summaries, which
are as few as its buckets, give what earlier or later buckets carry; and the carries come
back by a join on (key, bucket), the partitioning that the rows have already.  So the rows
are shuffled once, as for a plain window, but by (key, bucket) and not by key.

The rows are evaluated twice, for themselves and for the summaries: cut the lineage
(``storage.materialise``) where one scan follows another, or evaluations double with each.
Without a bucket a scan is a plain window by key, for rows that are few for every key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A bucket of a time line.
BUCKET_SECONDS = 4 * 3600.0
HERE, FIRST, LAST = Window.currentRow, Window.unboundedPreceding, Window.unboundedFollowing
BUCKET = "__bucket"


class Running:
    """A running value: within a bucket, as a bucket's summary, carried, and put together."""

    def __init__(self, column: Column | str):
        self.column = F.col(column) if isinstance(column, str) else column


class Sum(Running):
    """The sum of this row and all before it."""

    def local(self, own: Window) -> Column:
        return F.sum(self.column).over(own.rowsBetween(FIRST, HERE))

    def summary(self, place: Column) -> Column:
        return F.sum(self.column)

    def carried(self, part: Column, over: Window) -> Column:
        return F.sum(part).over(over.rowsBetween(FIRST, -1))

    def whole(self, local: Column, carry: Column) -> Column:
        return F.coalesce(local + carry, local, carry)


class MaxBefore(Running):
    """The largest value of all rows before this one."""

    def local(self, own: Window) -> Column:
        return F.max(self.column).over(own.rowsBetween(FIRST, -1))

    def summary(self, place: Column) -> Column:
        return F.max(self.column)

    def carried(self, part: Column, over: Window) -> Column:
        return F.max(part).over(over.rowsBetween(FIRST, -1))

    def whole(self, local: Column, carry: Column) -> Column:
        return F.greatest(local, carry)


class LastSeen(Running):
    """The latest value that is not null, at this row or before it."""

    def local(self, own: Window) -> Column:
        return F.last(self.column, ignorenulls=True).over(own.rowsBetween(FIRST, HERE))

    def summary(self, place: Column) -> Column:
        return F.max_by(self.column, F.when(self.column.isNotNull(), place))

    def carried(self, part: Column, over: Window) -> Column:
        return F.last(part, ignorenulls=True).over(over.rowsBetween(FIRST, -1))

    def whole(self, local: Column, carry: Column) -> Column:
        return F.coalesce(local, carry)


class NextSeen(LastSeen):
    """The next value that is not null, at this row or after it."""

    def local(self, own: Window) -> Column:
        return F.first(self.column, ignorenulls=True).over(own.rowsBetween(HERE, LAST))

    def summary(self, place: Column) -> Column:
        return F.min_by(self.column, F.when(self.column.isNotNull(), place))

    def carried(self, part: Column, over: Window) -> Column:
        return F.first(part, ignorenulls=True).over(over.rowsBetween(1, LAST))


class Before(Running):
    """A struct of the value of the row before this one; null for the first row."""

    def local(self, own: Window) -> Column:
        return F.lag(F.struct(self.column.alias("v"))).over(own)

    def summary(self, place: Column) -> Column:
        return F.max_by(F.struct(self.column.alias("v")), place)

    def carried(self, part: Column, over: Window) -> Column:
        return F.lag(part).over(over)

    def whole(self, local: Column, carry: Column) -> Column:
        return F.coalesce(local, carry)["v"]


class After(Before):
    """The value of the row after this one; null for the last row."""

    def local(self, own: Window) -> Column:
        return F.lead(F.struct(self.column.alias("v"))).over(own)

    def summary(self, place: Column) -> Column:
        return F.min_by(F.struct(self.column.alias("v")), place)

    def carried(self, part: Column, over: Window) -> Column:
        return F.lead(part).over(over)


def scan(rows: DataFrame, keys: list[str], order: list[str], bucket: Column | None, **wanted: Running) -> DataFrame:
    """``rows`` with the running values ``wanted``.

    ``order`` must not leave ties that matter; ``bucket`` must not decrease along it (null
    is the least bucket).  Rows with a null key are kept, each bucket of them by itself.
    """
    if bucket is None:
        own = Window.partitionBy(*keys).orderBy(*order)
        marked = rows.withColumns({n: w.local(own) for n, w in wanted.items()})
        return marked.withColumns({n: F.col(n)["v"] for n, w in wanted.items() if isinstance(w, Before)})
    least = F.lit(-(2**62)).cast("long")
    cut = rows.withColumn(BUCKET, F.coalesce(bucket.cast("long"), least))
    own = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    place = F.struct(*[F.col(c).isNotNull() for c in order[:1]], *order)
    local = cut.withColumns({f"__l_{n}": w.local(own) for n, w in wanted.items()})
    parts = cut.groupBy(*keys, BUCKET).agg(*[w.summary(place).alias(f"__s_{n}") for n, w in wanted.items()])
    over = Window.partitionBy(*keys).orderBy(BUCKET)
    carries = parts.select(*keys, BUCKET, *[w.carried(F.col(f"__s_{n}"), over).alias(f"__c_{n}") for n, w in wanted.items()])
    both = local.join(carries, [*keys, BUCKET], "left")
    kept = [c for c in rows.columns if c not in wanted]
    return both.select(*kept, *[w.whole(F.col(f"__l_{n}"), F.col(f"__c_{n}")).alias(n) for n, w in wanted.items()])


def runs(rows: DataFrame, keys: list[str], value: str, order: list[str], bucket: Column | None) -> DataFrame:
    """``rows`` with ``run``, the number from 0 of the run of equal ``value`` that each is in.

    A bucket's summary is its number of changes with its first and last value, so that
    changes between buckets are seen too.
    """
    cut = rows.withColumn(BUCKET, F.lit(0) if bucket is None else F.coalesce(bucket.cast("long"), F.lit(-(2**62)).cast("long")))
    own = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    held = F.struct(F.col(value).alias("x"))
    before = F.lag(held).over(own)
    cut = cut.withColumn("__new", (before.isNotNull() & ~F.col(value).eqNullSafe(before["x"])).cast("int"))
    local = cut.withColumn("run", F.sum("__new").over(own.rowsBetween(FIRST, HERE)))
    if bucket is None:
        return local.drop(BUCKET, "__new")
    place = F.struct(*order)
    parts = cut.groupBy(*keys, BUCKET).agg(F.sum("__new").alias("n"), F.min_by(held, place).alias("first"), F.max_by(held, place).alias("last"))
    over = Window.partitionBy(*keys).orderBy(BUCKET)
    last = F.lag("last").over(over)
    parts = parts.withColumn("change", (last.isNotNull() & ~last.eqNullSafe(F.col("first"))).cast("int"))
    carry = F.coalesce(F.sum("n").over(over.rowsBetween(FIRST, -1)), F.lit(0)) + F.sum("change").over(over.rowsBetween(FIRST, HERE))
    return local.join(parts.select(*keys, BUCKET, carry.alias("__carry")), [*keys, BUCKET], "left").select(*rows.columns, (F.col("run") + F.coalesce("__carry", F.lit(0))).alias("run"))


def by_time(start: str = "start", seconds: float | None = BUCKET_SECONDS) -> Column | None:
    """The bucket of a time in seconds; none for none."""
    return None if seconds is None else F.floor(F.col(start) / seconds)


def position(rows: DataFrame, keys: list[str], order: list[str], bucket: Column | None, name: str) -> DataFrame:
    """``rows`` with their place in the order of their key, from 0."""
    counted = scan(rows, keys, order, bucket, **{name: Sum(F.lit(1).cast("long"))})
    return counted.withColumn(name, F.col(name) - 1)

