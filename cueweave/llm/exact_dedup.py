"""Exact dedup with a log-structured merge index, in DataFrame operations only.

``flush`` turns a batch of documents into sorted runs: every task is a memtable
that sorts its (digest, identifier) rows and writes them as run files of at most
``memtable_rows`` rows with a Parquet Bloom filter and min/max statistics on the
digest, without a shuffle.  Texts stay where they are: as in stores that keep keys
apart from values, the index only remembers the batch.  ``compact`` merges the level
and the runs since into one level that keeps, for each digest, the smallest (or
largest) identifier and the number of rows; the merge combines before it shuffles, so
that a huge group of copies is a few rows.  ``lookup`` sends probes through the
filters.

Digests with more than one row, in one batch or in several, are *hits*; only their
texts are read again and compared byte by byte with the text of the row that stays.
A group's texts are dealt over as many tasks as it needs, with its one kept text sent
to each.  Rows that differ although the digest agrees are grouped by their whole text,
so that the result never rests on the digest alone.

Defined results: a null text counts as empty.  A null identifier is smaller than
all others for ``keep='largest'`` and larger for ``'smallest'``; it stays only if
its whole group has none.  Of repeated rows (same identifier, equal text) exactly
one is kept.  Empty input gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueweave.functions.storage import fresh_path, materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MEMTABLE_ROWS = 65_536
BROADCAST_HITS = 200_000
HOT_GROUPS = 10_000
TEXTS_PER_SALT = 500
PROBES_PUSHED = 1_000
RUN_SCHEMA = "digest binary, doc_id long, batch int, row long"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the fast path serves texts that are all ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def digest_of(text: Column, bits: int = 256) -> Column:
    return F.substring(F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)), 1, max(1, bits // 8))


class MergeIndex:
    """A log-structured index of text digests in the folder ``path``.

    Batches are flushed one after another; ``compact`` folds the runs since the last
    compaction into the level beneath, and ``report`` tells of every row so far which
    row of its group stays.  ``digest_bits`` below 256 only serves to test the byte
    verification.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "smallest", memtable_rows: int = MEMTABLE_ROWS, digest_bits: int = 256):
        if keep not in ("smallest", "largest"):
            raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
        self.spark, self.keep, self.memtable_rows, self.bits = spark, keep, memtable_rows, digest_bits
        self.path = path or fresh_path(spark, "merge-index")
        self.runs: list[str] = []
        self.batches: list[DataFrame] = []
        self.level: str | None = None
        self._folded = 0

    def _write(self, rows: DataFrame, name: str) -> str:
        path = f"{self.path}/{name}"
        (rows.sortWithinPartitions("digest").write.option("maxRecordsPerFile", self.memtable_rows)
         .option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.expected.ndv#digest", str(self.memtable_rows))
         .parquet(path))
        return path

    def flush(self, docs: DataFrame) -> None:
        """Write the digests of a batch (doc_id, text) as sorted runs."""
        number = len(self.runs)
        rows = docs.select(digest_of(normalised(F.col("text")), self.bits).alias("digest"), "doc_id", F.lit(number).alias("batch"), F.monotonically_increasing_id().alias("row"))
        self.runs.append(self._write(rows, f"run-{number:05d}"))
        self.batches.append(docs)

    def entries(self) -> DataFrame:
        """Every row that was flushed."""
        return self.spark.read.schema(RUN_SCHEMA).parquet(*self.runs)

    def _rank(self) -> Column:
        """What decides which row of a group stays; nulls last."""
        if self.keep == "largest":
            return F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "batch", "row")
        return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "batch", "row")

    def _best(self, rank: str) -> Column:
        return (F.max if self.keep == "largest" else F.min)(rank)

    def compact(self) -> DataFrame:
        """Fold new runs into the level: (digest, best struct<doc_id, batch, row, ...>, n)."""
        if self._folded < len(self.runs):
            new = self.spark.read.schema(RUN_SCHEMA).parquet(*self.runs[self._folded :])
            rows = new.select("digest", self._rank().alias("best"), F.lit(1).cast("long").alias("n"))
            if self.level:
                rows = rows.unionByName(self.spark.read.parquet(self.level))
            merged = rows.groupBy("digest").agg(self._best("best").alias("best"), F.sum("n").alias("n"))
            self.level = self._write(merged, f"level-{self._folded:05d}-{len(self.runs):05d}")
            self._folded = len(self.runs)
        return self.spark.read.parquet(self.level)

    def lookup(self, probes: DataFrame) -> DataFrame:
        """The level's entries (digest, keep_id, n) for the digests in ``probes``.

        Few probes are pushed to the scan, where the filters of the run files spare
        the reading of those that cannot hold them; more are joined.
        """
        probes = probes.select("digest").distinct()
        level = self.compact()
        few = probes.limit(PROBES_PUSHED + 1).collect()
        if len(few) <= PROBES_PUSHED:
            level = level.filter(F.col("digest").isin([F.lit(bytearray(r["digest"])) for r in few])) if few else level.limit(0)
        else:
            level = level.join(probes, "digest", "left_semi")
        return level.select("digest", F.col("best.doc_id").alias("keep_id"), "n")

    def _with_group(self, groups: DataFrame) -> DataFrame:
        """Every row with its digest's group.  A group of more than one in HOT_GROUPS of all
        rows is sent to the rows, and there are no more than HOT_GROUPS of those; the rest
        are joined by digest."""
        entries = self.entries()
        groups = groups.select("digest", "best", "n")
        limit = (groups.agg(F.sum("n")).first()[0] or 0) / HOT_GROUPS
        hot = groups.filter(F.col("n") > limit)
        if limit < 1:  # so few rows that every group counts as hot
            return entries.join(F.broadcast(hot), "digest")
        rest = entries.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(groups.filter(F.col("n") <= limit), "digest")
        return entries.join(F.broadcast(hot), "digest").unionByName(rest)

    def _told(self, rows: DataFrame) -> DataFrame:
        kept = (F.col("best.batch") == F.col("batch")) & (F.col("best.row") == F.col("row"))
        return rows.select("doc_id", "batch", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "digest")

    def _collisions(self, groups: DataFrame) -> DataFrame:
        """Digests whose rows do not all have the text of the row that stays."""
        hits = self._with_group(groups.filter("n > 1")).select("doc_id", "digest", F.col("best.doc_id").alias("keep_id"), F.ceil(F.col("n") / TEXTS_PER_SALT).alias("salts"))
        hits = materialise(hits.distinct(), "dedup-hits")
        wanted = hits.select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"), "keep_id", "salts")
        wanted = F.broadcast(wanted) if hits.count() <= BROADCAST_HITS else wanted
        # The identifier alone is the join key, and whether the digest is that of the hit is a written
        # column and no filter, which would become a key as well: so only texts of hits are digested again.
        texts = [b.join(wanted, b["doc_id"].eqNullSafe(wanted["hit_id"])).select("doc_id", "keep_id", "salts", "hit_digest", normalised(F.col("text")).alias("text")) for b in self.batches]
        texts = reduce(DataFrame.unionByName, texts).withColumn("same", digest_of(F.col("text"), self.bits) == F.col("hit_digest"))
        texts = texts.select("same", F.col("hit_digest").alias("digest"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("stays"), "salts", F.pmod(F.monotonically_increasing_id(), "salts").alias("salt"), F.when(F.col("same"), F.col("text")).alias("text"))
        texts = materialise(texts, "dedup-texts").filter("same").drop("same")
        kept = texts.filter("stays").groupBy("digest", "salts").agg(F.max("text").alias("kept_text"))
        kept = kept.select("digest", "kept_text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        differ = texts.join(kept, ["digest", "salt"]).filter(F.col("text") != F.col("kept_text"))
        return materialise(differ.select("digest").distinct(), "dedup-collisions")

    def report(self) -> DataFrame:
        """(doc_id, batch, keep_id, group_size, kept, digest) of every row that was flushed."""
        groups = self.compact()
        differ = self._collisions(groups)
        if differ.isEmpty():
            return self._told(self._with_group(groups))
        # Some digests stand for several texts: those rows are grouped by their whole text.
        clear = self._told(self._with_group(groups.join(differ, "digest", "left_anti")))
        mixed = [b.select("doc_id", F.lit(i).alias("batch"), normalised(F.col("text")).alias("text"), F.monotonically_increasing_id().alias("row")) for i, b in enumerate(self.batches)]
        mixed = reduce(DataFrame.unionByName, mixed).withColumn("digest", digest_of(F.col("text"), self.bits))
        mixed = materialise(mixed.join(differ, "digest", "left_semi"), "dedup-mixed")
        best = mixed.withColumn("rank", self._rank()).groupBy("digest", "text").agg(self._best("rank").alias("best"), F.count(F.lit(1)).alias("n"))
        return clear.unionByName(self._told(mixed.join(best, ["digest", "text"])))


def find_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest_bits: int = 256, index: MergeIndex | None = None) -> DataFrame:
    """Group documents whose texts are equal after lower-casing A-Z.

    Returns (doc_id, batch, keep_id, group_size, kept, digest) with a row for each input
    row, and for each row of earlier batches if an ``index`` is given that holds some.
    """
    index = index or MergeIndex(docs.sparkSession, keep=keep, digest_bits=digest_bits)
    index.flush(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return index.report()


def drop_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with their own columns.

    Of repeated rows (same identifier, equal text) one stays; rows that share an
    identifier but not a text are judged one by one.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = find_duplicates(docs, **options)
    by_id = found.groupBy(F.col("doc_id").alias("__id")).agg(F.max("kept").alias("__some"), F.min("kept").alias("__all"))
    by_id = materialise(by_id.filter("not __all"), "dedup-gone")
    same_id = docs[id_col].cast("long").eqNullSafe(F.col("__id"))
    stays = docs.join(by_id, same_id, "left_anti")
    divided = by_id.filter("__some")
    if divided.isEmpty():
        return stays
    # An identifier of rows that stay and rows that go: its texts decide.
    rows = docs.join(divided.select("__id"), same_id, "left_semi").withColumn("__digest", digest_of(normalised(docs[text_col]), options.get("digest_bits", 256)))
    kept = found.filter("kept").select(F.col("doc_id").alias("__kept_id"), F.col("digest").alias("__kept_digest"))
    match = rows[id_col].cast("long").eqNullSafe(F.col("__kept_id")) & (F.col("__digest") == F.col("__kept_digest"))
    whole = rows.withColumn("__text", normalised(F.col(text_col))).join(kept, match, "left_semi")
    return stays.unionByName(whole.dropDuplicates([id_col, "__text"]).drop("__digest", "__text"))
