"""Results of jobs as JSON documents, and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueweave import schemas
from cueweave.operators import intervals

BUCKET, ROW_GROUP, MOST_ASKED = "__bucket", 16 << 20, 1000
WORD = "struct<word:string,start:double,end:double,speaker:string,overlap_candidate:boolean>"
TRANSCRIPT = f"rec_id long, words array<{WORD}>"
EDL = f"rec_id long, ranges {schemas.EXPORT}, source_duration double"


def transcript_documents(words: DataFrame) -> DataFrame:
    """(rec_id, words): one document for each recording, its words in order."""
    item = F.struct("ord", "word", "start", "end", "speaker", "overlap_candidate")
    listed = words.groupBy("rec_id").agg(F.array_sort(F.collect_list(item)).alias("words"))
    return listed.select("rec_id", F.transform("words", lambda w: F.struct(*[w[c].alias(c) for c in ("word", "start", "end", "speaker", "overlap_candidate")])).alias("words"))


def write_transcripts(words: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON documents of transcripts, original or clean."""
    transcript_documents(words).write.mode(mode).json(path)


def write_edls(ranges: DataFrame, recordings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON documents of kept ranges with the length of their recording."""
    intervals.nested_edl(ranges, recordings).write.mode(mode).json(path)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """The words of written transcripts, numbered in order."""
    words = spark.read.schema(TRANSCRIPT).json(path).select("rec_id", F.posexplode("words").alias("ord", "w"))
    return words.select("rec_id", F.col("ord").cast("long").alias("ord"), "w.*")


def read_edls(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(ranges, recordings) of written documents."""
    documents = spark.read.schema(EDL).json(path)
    ranges = documents.select("rec_id", F.posexplode("ranges").alias("range_ord", "r")).select("rec_id", F.col("range_ord").cast("long").alias("range_ord"), "r.*")
    return ranges, documents.select("rec_id", F.col("source_duration").alias("duration"))


def write_lookup(rows: DataFrame, path: str, key: str = "rec_id", buckets: int = 256, mode: str = "errorifexists") -> None:
    """Rows laid out for look-ups of few identifiers: a folder for each hash bucket of the key,
    in it files sorted by the key with Bloom filters on it.  A row without a key is found by none."""
    placed = rows.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int"))
    ordered = placed.repartition(BUCKET).sortWithinPartitions(BUCKET, key)
    ordered.write.partitionBy(BUCKET).option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.block.size", ROW_GROUP).mode(mode).parquet(path)


def look_up_few(spark: SparkSession, path: str, identifiers: list, key: str = "rec_id", buckets: int = 256) -> DataFrame:
    """The rows of ``write_lookup`` (with as many buckets) for at most MOST_ASKED identifiers.

    Only the folders of their buckets are listed in the plan, and there only row groups whose
    range and Bloom filter allow an identifier are read.
    """
    if len(identifiers) > MOST_ASKED:
        raise ValueError(f"more than {MOST_ASKED} identifiers: use operators.jobs.look_up, which joins")
    stored = spark.read.parquet(path)
    kind = stored.schema[key].dataType
    asked = spark.createDataFrame([(i,) for i in identifiers if i is not None], f"`{key}` {kind.simpleString()}")
    places = asked.select(F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int").alias(BUCKET)).distinct().collect()
    return stored.filter(F.col(BUCKET).isin([r[0] for r in places]) & F.col(key).isin([i for i in identifiers if i is not None])).drop(BUCKET)
