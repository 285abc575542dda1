"""How the sources of each language differ in their words, audited exactly.

1. Single-pass in-memory indexing.  Each task counts terms by (language, source) until its
   block holds ``block_postings`` postings, then spills the block as a run: for each hash
   shard its postings sorted by (language, term), cut into segments.
2. Every shard merges its runs with a heap.  Segments arrive in the order of their first
   term, so that a run's next segment is opened only when the merge reaches it; the heap
   tells up to which term all that is open can be merged at once.  Terms in ``min_docs`` documents of their language
   or more are kept, with their counts by source.
3. A source's smoothed share of a kept term is p = 1 + floor(10^9 (count + 2) / (N + 2 V)),
   and the divergence of p and q is floor((p - q)^2 / (p + q)).  A pair of sources sums it
   over all kept terms.  Most counts are 0, so the sum is made from three parts: V times
   the divergence of two zeros; for each source the corrections for its own counts against
   the other's zero, from a histogram of its counts; and the corrections of terms that
   both hold, streamed term by term and added up in tasks before they are shuffled.

All arithmetic is in whole numbers.  Nothing is collected on the driver or broadcast by
hand; a term's postings and a language's sources are as many as there are sources.

Defined results: null text, lang and source are ''.  A group without kept terms has shares
of zero counts; a language without kept terms gives pairs of value 0.  Rows that repeat
count again.  Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueweave.functions.storage import materialise, spread
from cueweave.llm.memory import releasing

MIN_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
BLOCK_POSTINGS = 400_000
SEGMENT_POSTINGS, MERGED_POSTINGS = 4096, 100_000
SOURCES_PER_SLICE, COUNTS_PER_CHUNK = 1000, 10_000
PAIRS_HELD = 1_000_000

#: Letters are A-Z, a-z and all of a code point over 0x7F, in UTF-8 every byte over 0x7F.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SEGMENTS = "shard int, lang string, first binary, last binary, terms array<binary>, ends array<int>, names array<string>, sources array<int>, counts array<long>, docs array<long>"
FREQUENCIES = "lang string, term string, total long, docs long, sources array<string>, counts array<long>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


# ---------------------------------------------------------------- runs
class Block:
    """Postings in memory: occurrences and documents of each term by (language, source)."""

    def __init__(self) -> None:
        self.counts: dict[tuple[str, str], Counter] = {}
        self.docs: dict[tuple[str, str], Counter] = {}
        self.size = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        key = (lang, source)
        if key not in self.counts:
            self.counts[key], self.docs[key] = Counter(), Counter()
        terms = terms_of(text)
        own = self.docs[key]
        before = len(own)
        self.counts[key].update(terms)
        own.update(list(dict.fromkeys(terms)))  # so that both have their terms in one order
        self.size += len(own) - before

    def segments(self, shards: int, limit: int) -> Iterator[pa.RecordBatch]:
        """The run: a language's segments of at least ``limit`` postings (a shard's last may
        be shorter), each sorted by term."""
        by_lang: dict[str, list[str]] = {}
        for lang, source in self.counts:
            by_lang.setdefault(lang, []).append(source)
        for lang in sorted(by_lang):
            names = [x for x in sorted(by_lang[lang]) if self.docs[lang, x]]
            if not names:
                continue
            counters = [(self.counts[lang, x], self.docs[lang, x]) for x in names]
            every = pa.array([t for counts, _ in counters for t in counts], pa.binary()).dictionary_encode()
            shard = np.array([zlib.crc32(t) % shards for t in every.dictionary.to_pylist()], np.int32)
            rank = np.empty(len(shard), np.int64)
            rank[pc.sort_indices(every.dictionary).to_numpy()] = np.arange(len(shard))
            code = every.indices.to_numpy()
            order = np.lexsort((rank[code], shard[code]))
            code = code[order]
            source = np.repeat(np.arange(len(names), dtype=np.int32), [len(c) for c, _ in counters])[order]
            counts, docs = (np.fromiter((n for c in counters for n in c[i].values()), np.int64, len(code))[order] for i in (0, 1))
            yield self._cut(lang, names, every.dictionary, shard, code, source, counts, docs, limit)

    @staticmethod
    def _cut(lang: str, names: list[str], dictionary: pa.Array, shard: np.ndarray, code: np.ndarray, source: np.ndarray, counts: np.ndarray, docs: np.ndarray, limit: int) -> pa.RecordBatch:
        first = np.flatnonzero(np.diff(code, prepend=-1))  # where each term's postings start
        ends = np.append(first[1:], len(code))
        part = shard[code[first]]
        opened = np.flatnonzero(np.diff(part, prepend=-1))  # the first term of each shard
        within = first - first[opened][np.cumsum(np.diff(part, prepend=-1) != 0) - 1]
        new = np.diff(within // limit, prepend=-1) != 0
        new[opened] = True
        at = np.flatnonzero(new)  # the first term of each segment
        terms_at, postings_at = (pa.array(x.astype(np.int32)) for x in (np.append(at, len(first)), np.append(first[at], len(code))))
        lists = lambda offsets, values: pa.ListArray.from_arrays(offsets, values)
        terms = dictionary.take(pa.array(code[first]))
        ends_ = ends - np.repeat(first[at], np.diff(np.append(at, len(first))))
        names_ = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(names)), pa.array(names * len(at), pa.string()))
        columns = [
            pa.array(part[at]), pa.array([lang] * len(at), pa.string()), terms.take(pa.array(at)), terms.take(pa.array(np.append(at[1:], len(first)) - 1)), lists(terms_at, terms), lists(terms_at, pa.array(ends_.astype(np.int32))),
            names_, lists(postings_at, pa.array(source)), lists(postings_at, pa.array(counts)), lists(postings_at, pa.array(docs)),
        ]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SEGMENTS.split(", ")])


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def spill_runs(docs: DataFrame, shards: int, block_postings: int, segment_postings: int) -> DataFrame:
    """The segments of all runs of (lang, source, text) documents."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in batches:
            langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
            for lang, source, text in zip(langs, sources, texts, strict=True):
                block.add(lang, source, text.as_py())
                if block.size >= block_postings:
                    yield from block.segments(shards, segment_postings)
                    block = Block()
        yield from block.segments(shards, segment_postings)

    return docs.mapInArrow(run, SEGMENTS)


# ---------------------------------------------------------------- merging
class Segment:
    """A sorted piece of a run, and how far it has been merged."""

    def __init__(self, first: bytes, last: bytes, terms: pa.Array, ends: np.ndarray, sources: np.ndarray, counts: np.ndarray, docs: np.ndarray):
        self.first, self.last, self.terms, self.done = first, last, terms, 0
        self.ends, self.sources, self.counts, self.docs = np.append(0, ends), sources, counts, docs
        self.keys: list[bytes] = terms.to_pylist()

    def upto(self, last: bytes) -> tuple:
        """The postings of the terms not merged yet, up to and with ``last``."""
        low, high = self.done, bisect.bisect_right(self.keys, last, self.done)
        self.done = high
        a, b = self.ends[low], self.ends[high]
        return self.terms.slice(low, high - low), np.diff(self.ends[low : high + 1]), self.sources[a:b], self.counts[a:b], self.docs[a:b]


def merge_segments(segments: Iterator[Segment]) -> Iterator[list[tuple]]:
    """Lists of postings of one language's segments, which come by first term; a term's
    postings are all in one list.

    The heap has the open segments by their last term.  What lies at or before the least
    of these last terms can be merged once every segment that starts there is open, so at
    most one segment of each run is open (segments of a run do not overlap).
    """
    heap: list[tuple[bytes, int, Segment]] = []
    ahead, number = next(segments, None), 0
    while heap or ahead is not None:
        while ahead is not None and (not heap or ahead.first <= heap[0][0]):
            heapq.heappush(heap, (ahead.last, number, ahead))
            ahead, number = next(segments, None), number + 1
        last = heap[0][0]
        yield [s.upto(last) for _, _, s in heap if s.keys[s.done] <= last]
        while heap and heap[0][2].done == len(heap[0][2].keys):
            heapq.heappop(heap)


def add_up(lang: str, names: list[str], parts: list[tuple], min_docs: int) -> pa.RecordBatch:
    """The frequencies of the kept terms among merged postings; sources are numbers of ``names``."""
    terms, lengths, sources, counts, docs = (list(x) for x in zip(*parts, strict=True))
    every = pa.concat_arrays(terms).dictionary_encode()
    code = np.repeat(every.indices.to_numpy(), np.concatenate(lengths)).astype(np.int64)
    source, n = np.concatenate(sources), np.concatenate(counts)
    held = np.zeros(len(every.dictionary), np.int64)
    np.add.at(held, code, np.concatenate(docs))
    keep = (held >= min_docs)[code]
    key = code[keep] * len(names) + source[keep]
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[keep][order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key, n = key[first], np.add.reduceat(n, first) if len(first) else n
    term, source = key // len(names), key % len(names)
    at = np.flatnonzero(np.diff(term, prepend=-1))
    offsets = pa.array(np.append(at, len(term)).astype(np.int32))
    total = np.add.reduceat(n, at) if len(at) else n
    columns = [
        pa.array([lang] * len(at), pa.string()), every.dictionary.take(pa.array(term[at])).cast(pa.string()), pa.array(total), pa.array(held[term[at]]),
        pa.ListArray.from_arrays(offsets, pa.array(names, pa.string()).take(pa.array(source))), pa.ListArray.from_arrays(offsets, pa.array(n)),
    ]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in FREQUENCIES.split(", ")])


def merge_runs(segments: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """The frequencies of kept terms: every shard in a task of its own."""
    dealt = segments.repartitionById(shards, F.col("shard")).sortWithinPartitions("lang", "first")

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, int] = {}

        def rows() -> Iterator[tuple[str, Segment]]:
            for batch in batches:
                for i in range(batch.num_rows):
                    lang, first, last, terms, ends, names, sources, counts, docs = (batch.column(k)[i] for k in range(1, 10))
                    own = np.array([places.setdefault(x, len(places)) for x in names.as_py()], np.int64)
                    yield lang.as_py(), Segment(first.as_py(), last.as_py(), terms.values, *(x.values.to_numpy() if k != 1 else own[x.values.to_numpy()] for k, x in enumerate((ends, sources, counts, docs))))

        for lang, own in itertools.groupby(rows(), key=lambda x: x[0]):
            parts, size = [], 0
            for merged in merge_segments(s for _, s in own):
                parts.extend(merged)
                size += sum(len(x[2]) for x in merged)
                if size >= MERGED_POSTINGS:
                    yield add_up(lang, list(places), parts, min_docs)
                    parts, size = [], 0
            if parts:
                yield add_up(lang, list(places), parts, min_docs)

    return dealt.mapInArrow(run, FREQUENCIES)


def frequencies(docs: DataFrame, min_docs: int = MIN_DOCS, shards: int | None = None, block_postings: int = BLOCK_POSTINGS, segment_postings: int = SEGMENT_POSTINGS) -> DataFrame:
    """(lang, term, total, docs, sources, counts) of the kept terms of (lang, source, text) documents."""
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(merge_runs(spill_runs(docs, shards, block_postings, segment_postings), shards, min_docs), "frequencies")


# ---------------------------------------------------------------- divergences
def share(count: Column, size: Column) -> Column:
    """1 + floor(10^9 (count + 2) / size), exactly."""
    scaled = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", scaled, size.cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class PairSums:
    """Sums over pairs of a language's sources in a square of at most ``limit`` cells."""

    def __init__(self, lang: str, limit: int):
        self.lang, self.most = lang, max(2, int(limit**0.5))
        self.places: dict[str, int] = {}
        self.square = np.zeros((16, 16), np.int64)

    def room(self, names: list[str]) -> bool:
        return len(self.places) + sum(x not in self.places for x in names) <= self.most

    def add(self, names: list[str], values: np.ndarray) -> None:
        at = np.array([self.places.setdefault(x, len(self.places)) for x in names])
        while len(self.square) < len(self.places):
            self.square = np.pad(self.square, (0, len(self.square)))
        self.square[np.ix_(at, at)] += values

    def rows(self) -> list[tuple]:
        names = list(self.places)
        return [(self.lang, names[i], names[j], int(self.square[i, j])) for i, j in zip(*np.nonzero(self.square), strict=True) if i != j]


_PAIR_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
PAIRS = "lang string, source string, item string, value long"


def _shared_terms(postings: DataFrame, limit: int) -> DataFrame:
    """Partial corrections (lang, source, item, value) for terms that both sources hold.

    ``postings``: (lang, held) with an array of (source, p, zero) of one term, where zero is
    the source's share of a count of 0.
    """

    def corrections(p: np.ndarray, zero: np.ndarray, q: np.ndarray, other: np.ndarray) -> np.ndarray:
        p, zero = p[:, None], zero[:, None]
        return _f(p, q) - _f(p, other) - _f(zero, q) + _f(zero, other)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, PairSums] = {}
        for batch in batches:
            lists = batch.column(1)
            rows, ends = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            sources, shares, zeros = rows.field(0).to_pylist(), rows.field(1).to_numpy(), rows.field(2).to_numpy()
            for lang, low, high in zip(batch.column(0).to_pylist(), ends[:-1], ends[1:], strict=True):
                names, p, zero = sources[low:high], shares[low:high], zeros[low:high]
                own = sums.setdefault(lang, PairSums(lang, limit))
                if not own.room(names):
                    yield _record(own.rows(), _PAIR_SCHEMA)
                    own = sums[lang] = PairSums(lang, limit)
                if own.room(names):
                    own.add(names, corrections(p, zero, p, zero))
                    continue
                step = max(1, limit // len(names))  # a term of more sources than a square holds
                for i in range(0, len(names), step):
                    values = corrections(p[i : i + step], zero[i : i + step], p, zero)
                    yield _record([(lang, names[i + a], names[b], int(values[a, b])) for a, b in zip(*np.nonzero(values), strict=True) if i + a != b], _PAIR_SCHEMA)
        for own in sums.values():
            yield _record(own.rows(), _PAIR_SCHEMA)

    return postings.mapInArrow(run, PAIRS)


def _own_terms(chunks: DataFrame) -> DataFrame:
    """Partial corrections for a source's own terms against the other's count of 0, and with a
    source's first chunk the sum over V terms that neither holds.

    ``chunks``: (lang, source, zero, terms, chunk, shares, times, others), where shares and
    times are a part of the histogram of the source's counts and others are (source, zero).
    """

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, source, zero, terms, chunk, shares, times, others = (c[i].as_py() for c in batch.columns)
                p, n = np.array(shares or [], np.int64), np.array(times or [], np.int64)
                rows = []
                for other in others:
                    if other["source"] == source:
                        continue
                    base = (zero - other["zero"]) ** 2 // (zero + other["zero"])
                    value = int((n * (_f(p, np.int64(other["zero"])) - base)).sum())
                    rows.append((lang, source, other["source"], value + (terms * base if chunk == 0 else 0)))
                    rows.append((lang, other["source"], source, value))
                if rows:
                    yield _record(rows, _PAIR_SCHEMA)

    return chunks.mapInArrow(run, PAIRS)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP,
    shards: int | None = None, block_postings: int = BLOCK_POSTINGS, segment_postings: int = SEGMENT_POSTINGS, pairs_held: int = PAIRS_HELD,
    sources_per_slice: int = SOURCES_PER_SLICE, counts_per_chunk: int = COUNTS_PER_CHUNK,
) -> DataFrame:
    """(lang, source, part, item, value, rank): for each (lang, source), part ``pair`` has its
    divergence from each other source of the language, part ``term`` its ``top`` terms that it
    has more of than the language as a whole."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    found = materialise(docs.select("lang", "source").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs")), "groups")
    kept = frequencies(spread(docs), min_docs, shards, block_postings, segment_postings)
    posted = kept.select("lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", "total", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))

    whole = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("sum"))
    sizes = posted.groupBy("lang", "source").agg(F.sum("count").alias("sum"))
    langs = whole.select("lang", "terms", (F.col("sum") + 2 * F.col("terms")).alias("all"))
    groups = found.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("sum", F.lit(0)).alias("sum"), "all")
    groups = groups.withColumn("size", F.col("sum") + 2 * F.col("terms"))
    # Without kept terms a share is of nothing: any will do, as no term is summed.
    groups = materialise(groups.withColumn("zero", F.when(F.col("size") > 0, share(F.lit(0).cast("long"), F.col("size"))).otherwise(F.lit(1).cast("long"))), "group-sizes")

    told = posted.join(groups.select("lang", "source", "size", "zero", "all"), ["lang", "source"])
    told = told.withColumns({"p": share(F.col("count"), F.col("size")), "q": share(F.col("total"), F.col("all"))}).drop("size", "all", "count", "total")
    told = materialise(told, "shares")
    scored = told.filter("p > q")
    best = _ranked(scored.select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value")), "term").filter(F.col("rank") <= top)

    held = told.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "zero")).alias("held")).filter("size(held) > 1").select("lang", "held")
    both = _shared_terms(held, pairs_held)

    times = told.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy("p")) - 1
    times = times.withColumn("chunk", F.floor(place / counts_per_chunk).cast("int"))
    chunks = times.groupBy("lang", "source", "chunk").agg(F.collect_list("p").alias("shares"), F.collect_list("times").alias("times"))
    first = groups.select("lang", "source", "zero", "terms")
    chunks = first.join(chunks, ["lang", "source"], "left").withColumn("chunk", F.coalesce("chunk", F.lit(0)))
    n = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    part = F.pmod(F.xxhash64("source"), F.ceil(F.col("sources") / sources_per_slice)).cast("int")
    others = groups.join(n, "lang").select("lang", part.alias("slice"), F.struct("source", "zero").alias("o")).groupBy("lang", "slice").agg(F.collect_list("o").alias("others"))
    slices = F.sequence(F.lit(0), (F.ceil(F.col("sources") / sources_per_slice) - 1).cast("int"))
    met = chunks.join(n, "lang").withColumn("slice", F.explode(slices)).join(others, ["lang", "slice"])
    alone = _own_terms(met.select("lang", "source", "zero", "terms", "chunk", "shares", "times", "others"))

    pairs = both.unionByName(alone).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return _ranked(pairs, "pair").unionByName(best)
