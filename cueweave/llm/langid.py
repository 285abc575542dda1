"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (n = 1 to 3, words
lower-cased and padded with a space), most frequent first.  A document's own list
is compared with each profile by the out-of-place distance: the sum over the
document's n-grams of the difference in rank, or the profile's length for an
n-gram that the profile lacks.  The nearest profile wins, ties by code point.

Profiles are learned from about ``train_docs`` labelled documents of each
language, chosen by a hash of the identifier (a documented bound, so that
learning costs the same at every size); every document is then scored over its
whole text in one map without a shuffle.  Profiles of more than ``max_languages``
languages stay a written table and are compared in parts, one after another in the
driver's memory; each part tells its two nearest languages of every document, and the
two nearest of all parts give the same results as one comparison would.

Defined results: a null text, or one without letters, is ``und`` with score 0;
without any labelled document every text is ``und``.  Repeated rows give repeated
results.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueweave.functions.storage import materialise, spread

PROFILE_LENGTH = 400
TRAIN_DOCS = 3000
MAX_LANGUAGES = 1000
SPACE = 32
_not_letters = re.compile(r"[\W\d_]+")


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text (three 21-bit code points in a number) and their counts."""
    words = " " + _not_letters.sub(" ", text.lower()) + " "
    c = np.frombuffer(words.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    inner = c != SPACE
    one = c[inner]
    two = ((c[:-1] << np.uint64(21)) | c[1:])[inner[:-1] | inner[1:]]
    three = ((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])[inner[1:-1]]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def most_frequent(grams: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The most frequent n-grams in order; ties by their code points."""
    return grams[np.argsort(-counts, kind="stable")[:length]]


class Profiles:
    """Rank-order profiles of several languages."""

    def __init__(self, ranked: dict[str, list[int]], length: int = PROFILE_LENGTH):
        self.languages, self.length = sorted(ranked), length
        self.grams = np.unique(np.array([g for grams in ranked.values() for g in grams], np.uint64))
        self.ranks = np.full((len(self.languages), len(self.grams) + 1), -1, np.int64)
        for i, language in enumerate(self.languages):
            own = np.array(ranked[language][:length], np.uint64)
            self.ranks[i, np.searchsorted(self.grams, own)] = np.arange(len(own))

    def distances(self, text: str) -> tuple[np.ndarray, int]:
        """The out-of-place distance to each language, and the largest possible one."""
        own = most_frequent(*gram_counts(text), self.length)
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        ranks = self.ranks[:, at]
        away = np.where(ranks < 0, self.length, np.abs(ranks - np.arange(len(own))))
        return away.sum(axis=1), self.length * len(own)

    def nearest(self, text: str | None) -> list[tuple[float, str]]:
        """(closeness, language) of the two nearest languages, ties by code point; none for ``und``."""
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return []
        away, most = self.distances(text)
        return [(float(most - away[i]) / max(1, most), self.languages[i]) for i in np.argsort(away, kind="stable")[:2]]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is the share of closeness that the winner holds
        against the runner-up, 1 when no other language has anything in common."""
        found = self.nearest(text)
        if not found:
            return "und", 0.0
        total = sum(near for near, _ in found)
        return found[0][1], found[0][0] / total if total > 0 else 1.0 / len(self.languages)


class ProfileTable:
    """Profiles of many languages as a written table (part, lang, gram, rank)."""

    def __init__(self, table: DataFrame, languages: int, parts: int, length: int):
        self.table, self.languages, self.parts, self.length = table, languages, parts, length

    def part(self, number: int) -> Profiles:
        return _gathered(self.table.filter(F.col("part") == number), self.length)


def _gathered(table: DataFrame, length: int) -> Profiles:
    ranked: dict[str, list[int]] = {}
    for r in sorted(table.select("lang", "gram", "rank").collect(), key=lambda r: r["rank"]):  # length x languages
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked, length)


def learn_profiles(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", length: int = PROFILE_LENGTH, train_docs: int = TRAIN_DOCS, max_languages: int = MAX_LANGUAGES) -> Profiles | ProfileTable:
    """Profiles from about ``train_docs`` labelled documents of each language.

    The number of documents by language decides which share of the hash space is
    read, so no language's documents are ever gathered in one place.
    """
    labelled = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    counted = counts.limit(max_languages + 1).collect()
    if not counted:
        return Profiles({}, length)
    place = F.shiftrightunsigned(F.xxhash64(F.lit("langid"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1))), 11) / F.lit(float(2**53))
    texts = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), place.alias("place"))
    few = len(counted) <= max_languages
    if few:
        share = F.create_map(*[F.lit(x) for r in counted for x in (r["lang"], min(1.0, train_docs / r["n"]))])
        sample = texts.filter(F.col("place") < share[F.col("lang")])
    else:
        counts = materialise(counts, "languages")
        large = counts.filter(F.col("n") > train_docs).select("lang", (F.lit(float(train_docs)) / F.col("n")).alias("share"))
        sample = texts.join(large, "lang", "left").filter(F.col("share").isNull() | (F.col("place") < F.col("share")))
    sample = sample.select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                grams, counts = gram_counts("\n".join(own))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view("<i8")), pa.array(counts)], ["lang", "gram", "n"])

    totals = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked = totals.withColumn("rank", rank).filter(F.col("rank") <= length)
    if few:
        return _gathered(ranked, length)
    languages = counts.count()
    parts = math.ceil(2 * languages / max_languages)  # about half of max_languages in each
    ranked = ranked.withColumn("part", F.pmod(F.xxhash64("lang"), F.lit(parts)).cast("int"))
    return ProfileTable(materialise(ranked, "profiles"), languages, parts, length)


def _nearest_of_parts(docs: DataFrame, profiles: ProfileTable) -> DataFrame:
    """(doc_id, lang_pred, score) from the two nearest languages of each part."""
    docs = materialise(docs.withColumn("row", F.monotonically_increasing_id()), "texts")
    near = "array<struct<away:double,lang:string>>"
    found = []
    for number in range(profiles.parts):
        part = profiles.part(number)

        def run(batches: Iterator[pa.RecordBatch], part: Profiles = part) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [[{"away": -n, "lang": lang} for n, lang in part.nearest(text.as_py())] for text in batch.column(2)]
                own = pa.array(rows, pa.list_(pa.struct([("away", pa.float64()), ("lang", pa.string())])))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), own], ["row", "doc_id", "near"])

        found.append(materialise(docs.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id long, near {near}"), "near-part"))
    both = reduce(DataFrame.unionByName, found).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, 2).alias("near"))
    best, total = F.get("near", 0), F.aggregate("near", F.lit(0.0), lambda s, x: s - x["away"])
    score = F.when(best.isNull(), 0.0).when(total > 0, -best["away"] / total).otherwise(1.0 / profiles.languages)
    return both.select("doc_id", F.coalesce(best["lang"], F.lit("und")).alias("lang_pred"), score.alias("score"))


def identify(docs: DataFrame, profiles: Profiles | ProfileTable, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    asked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if isinstance(profiles, ProfileTable):
        return _nearest_of_parts(asked, profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return spread(asked).mapInArrow(run, "doc_id long, lang_pred string, score double")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the identifier as text, modulo ``divisor`` (null for a null identifier)."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % divisor
