"""A corpus pipeline of five stages, each writing what it keeps for the next.

Documents the toxicity model rejects go; of equal texts and of near-duplicate
groups one document stays; the rest is mixed to the sources' target weights
(documents taken twice appear twice, one taken in part is cut); the mix is packed
into training sequences.  Every stage takes (spark, docs, sf_dir) and works on all
rows of ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueweave.functions.storage import materialise
from cueweave.llm import exact_dedup, minhash, mixing, packing, toxicity


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number for each row, so that decisions meet rows and not
    identifiers, which may repeat.  ``docs`` is a written table: every reading numbers alike."""
    return docs.withColumn("__row", F.monotonically_increasing_id())


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose number is not in ``gone``."""
    return docs.join(gone, docs["__row"] == gone["__gone"], "left_anti").drop("__row")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity score is 0.5 or more; all labels teach."""
    index = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = numbered(docs)
    scored = toxicity.score(rows, index, id_col="__row")
    return without(rows, materialise(scored.filter("score >= 0.5").select(F.col("doc_id").alias("__gone")), "toxic"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the largest identifier of each group of equal texts."""
    return exact_dedup.drop_duplicates(docs, keep="largest")


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest identifier of each near-duplicate group (null the largest)."""
    rows = numbered(docs)
    found = minhash.near_duplicates(rows, id_col="__row").select(F.col("doc_id").alias("__found"), "component_id")
    ranked = rows.select("__row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row").alias("rank")).join(found, F.col("__row") == F.col("__found"))
    ranked = materialise(ranked.select("__row", "rank", "component_id"), "near-copies")
    best = ranked.groupBy("component_id").agg(F.min("rank").alias("best")).select(F.col("best.__row").alias("__best"))
    gone = ranked.join(best, ranked["__row"] == best["__best"], "left_anti").select(F.col("__row").alias("__gone"))
    return without(rows, materialise(gone, "near-gone"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    rows = numbered(docs)
    return mixing.apply_mix(rows, mixing.mix(rows, F.array("source"), carry=["__row"]), key="__row").drop("__row")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all training sequences."""
    return packing.with_checksums(packing.pack(docs))


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("minhash_near_dedup", remove_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores, sketches and tokens are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
