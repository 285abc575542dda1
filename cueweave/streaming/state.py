"""A keyed table that a stream keeps up to date by rewriting only what a batch touches.

Rows lie in hash buckets of their key.  Each bucket has two slots; a manifest names the slot
and so the version of each bucket that holds.  A batch reads the buckets that it touches,
writes their new versions into the other slots, and then writes a manifest; that has two
slots too, so the one before stays whole.  Readers follow the newest manifest and never see
half of a batch, untouched buckets keep their files, nothing has to be deleted, and an epoch
that comes again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class BucketedTable:
    """``columns`` is the schema of the rows; a table belongs to one stream (checkpoint)."""

    def __init__(self, path: str, columns: str, key: str, buckets: int = BUCKETS):
        self.path, self.columns, self.key, self.buckets = path, columns, key, buckets

    def _manifest(self, spark: SparkSession) -> tuple[int, dict[int, int]]:
        """(epoch, slot of each bucket) of the newest manifest; at most a row for each bucket and slot."""
        try:
            rows = spark.read.schema("epoch long, bucket int, place int, slot int").parquet(f"{self.path}/manifest").collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        epoch = max((r["epoch"] for r in rows), default=-1)
        return epoch, {r["bucket"]: r["place"] for r in rows if r["epoch"] == epoch}

    def _rows(self, spark: SparkSession, places: dict[int, int]) -> DataFrame:
        if not places:
            return spark.createDataFrame([], self.columns)
        # Each bucket's folder by name, so that no other bucket is listed or read.
        return spark.read.schema(self.columns).parquet(*[f"{self.path}/data/slot={slot}/bucket={bucket}" for bucket, slot in sorted(places.items())])

    def fold(self, batch: DataFrame, epoch: int, combine: Callable[[DataFrame], DataFrame]) -> None:
        """Bring ``combine`` of the rows there are and the batch's into the table."""
        spark = batch.sparkSession
        known, places = self._manifest(spark)
        if epoch <= known:
            return
        names = spark.createDataFrame([], self.columns).columns
        numbered = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        touched = [r["bucket"] for r in numbered(batch).select("bucket").distinct().collect()]  # at most ``buckets``
        if touched:
            there = self._rows(spark, {b: places[b] for b in touched if b in places})
            slots = {b: 1 - places.get(b, 1) for b in touched}
            slot = F.create_map(*[F.lit(x) for pair in slots.items() for x in pair])[F.col("bucket")]
            rows = numbered(combine(there.unionByName(batch.select(*names))).select(*names)).withColumn("slot", slot)
            rows = rows.repartition("slot", "bucket").sortWithinPartitions(self.key)
            rows.write.partitionBy("slot", "bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/data")
            places = places | slots
        manifest = spark.createDataFrame([(epoch, b, s, epoch % 2) for b, s in places.items()] or [(epoch, -1, -1, epoch % 2)], "epoch long, bucket int, place int, slot int")
        manifest.coalesce(1).write.partitionBy("slot").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/manifest")

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows of the newest whole version."""
        return self._rows(spark, {b: s for b, s in self._manifest(spark)[1].items() if b >= 0})
