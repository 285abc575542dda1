"""Line dedup with a sharded minimal perfect hash.

The first pass hashes every eligible line (128 bits) and counts, with map-side
combining, how many documents hold it and the largest identifier among them.
The distinct hashes that reach the document threshold are dealt into shards by
hash; a task builds for each shard a minimal perfect hash (levels of collision
free bits with rank samples) over compact arrays: a 64-bit fingerprint, a count
and the identifier whose lines stay.  Hashes below the threshold can never
remove a line and are rejected by the fingerprint, so they take no space.

The second pass lets documents probe the arrays.  While the whole index is
within ``broadcast_bytes`` it is sent to the tasks and documents are not
shuffled at all.  Beyond that, 24-byte probes travel to their shard (salted, so
that one very frequent line does not meet in one task) and stream past its
arrays; only hits return to the documents.  Lines are never joined.

Defined results, the same on both ways: a null text is one empty line; rows are counted
as they are, so a repeated row counts twice.  Rows whose identifier is null count
towards the threshold and lose a frequent line like any other, since a named document
keeps it; a line that only such rows hold is left alone, because nobody can be named to
keep it.  Rows that repeat the largest identifier of a line all keep it.  Empty input
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueweave.functions.storage import materialise, spread

WHITESPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
KEYS_PER_SHARD = 65_536
PROBE_SALTS = 16
GAMMA = 2.0
MAX_LEVELS = 48
SHARD_SCHEMA = "shard int, shards int, sizes array<int>, words binary, fingerprints binary, counts binary, keepers binary, spare binary"


def line_key(line: bytes) -> bytes:
    """A line's key: ASCII white space stripped at both ends, A-Z lower-cased."""
    return line.strip(WHITESPACE).lower()


def eligible(key: bytes, min_chars: int) -> bool:
    if len(key) < min_chars:
        return False
    return len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars


def hashed_lines(text: str | None, min_chars: int) -> tuple[list[bytes], list[int], list[bytes]]:
    """The lines of a text, the positions of those that can be dropped, and their digests."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    at, digests = [], []
    for i, line in enumerate(lines):
        key = line_key(line)
        if eligible(key, min_chars):
            at.append(i)
            digests.append(xxhash.xxh3_128_digest(key))
    return lines, at, digests


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


# ---------------------------------------------------------------- the hash
def _slot(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    x = (hi ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) + lo * np.uint64(0x94D049BB133111EB | 1)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Levels of bits: a key belongs to the first level where no other key of that
    level shares its bit, and its number is the rank of that bit over all levels."""

    def __init__(self, sizes: list[int], words: np.ndarray, spare: dict[tuple[int, int], int]):
        self.sizes, self.words, self.spare = sizes, words, spare
        self.samples = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        sizes, parts = [], []
        for level in range(MAX_LEVELS):
            if not len(hi):
                break
            size = 64 * max(1, math.ceil(GAMMA * len(hi) / 64))
            at = _slot(hi, lo, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = ~alone[at]
            hi, lo = hi[left], lo[left]
        words = np.concatenate(parts) if parts else np.zeros(0, "<u8")
        taken = int(np.bitwise_count(words).sum())
        return cls(sizes, words, {(int(a), int(b)): taken + i for i, (a, b) in enumerate(zip(hi, lo, strict=True))})

    def lookup(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The number of each key; any number or -1 for keys that were not built in."""
        out = np.full(len(hi), -1, np.int64)
        left, start = np.arange(len(hi)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = _slot(hi[left], lo[left], level, size) + start
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.samples[at >> 6] + below)[hit]
            left, start = left[~hit], start + size
        for i in left if self.spare else ():
            out[i] = self.spare.get((int(hi[i]), int(lo[i])), -1)
        return out


class Shard:
    """One shard's perfect hash and arrays."""

    def __init__(self, sizes, words, fingerprints, counts, keepers, spare):
        rest = np.frombuffer(spare, "<u8").reshape(-1, 2)
        words = np.frombuffer(words, "<u8")
        first = int(np.bitwise_count(words).sum())
        self.hash = PerfectHash(list(sizes), words, {(int(a), int(b)): first + i for i, (a, b) in enumerate(rest)})
        self.fingerprints = np.frombuffer(fingerprints, "<u8")
        self.counts, self.keepers = np.frombuffer(counts, "<u4"), np.frombuffer(keepers, "<i8")

    def drops(self, hi: np.ndarray, lo: np.ndarray, doc: np.ndarray, named: np.ndarray, min_docs: int) -> np.ndarray:
        """Whether the document (given by identifier, if it is named) loses the line of this hash."""
        at = self.hash.lookup(hi, lo)
        known = at >= 0
        at = np.where(known, at, 0)
        return known & (self.fingerprints[at] == lo) & (self.counts[at] >= min_docs) & (~named | (self.keepers[at] != doc))


def build_shard(shard: int, shards: int, hi: np.ndarray, lo: np.ndarray, n: np.ndarray, keeper: np.ndarray) -> tuple:
    table = PerfectHash.build(hi, lo)
    at = table.lookup(hi, lo)
    arrays = [np.zeros(len(hi), kind) for kind in ("<u8", "<u4", "<i8")]
    for array, values in zip(arrays, (lo, np.minimum(n, 2**32 - 1), keeper), strict=True):
        array[at] = values
    spare = np.array(list(table.spare), "<u8").tobytes()
    return (shard, shards, table.sizes, table.words.tobytes(), *(a.tobytes() for a in arrays), spare)


# ---------------------------------------------------------------- the Spark job
def _shard_of(hi: np.ndarray, shards: int) -> np.ndarray:
    return ((hi >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)


def line_statistics(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(hi, lo, n, keeper) of every distinct line hash found in at least ``min_docs`` documents."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, docs_of = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = set(hashed_lines(text, min_chars)[2])
                digests.extend(own)
                docs_of.extend([doc] * len(own))
            hi, lo = halves(digests)
            yield pa.RecordBatch.from_arrays([pa.array(hi.view("<i8")), pa.array(lo.view("<i8")), pa.array(docs_of, pa.int64())], ["hi", "lo", "doc"])

    lines = docs.mapInArrow(hashes, "hi long, lo long, doc long")
    seen = lines.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("keeper"))
    return seen.filter((F.col("n") >= min_docs) & F.col("keeper").isNotNull())


def build_index(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The index as a table with a row of arrays for each shard (written in the shared folder)."""
    found = materialise(line_statistics(docs, min_chars, min_docs), "line-statistics")
    shards = max(1, math.ceil(found.count() / KEYS_PER_SHARD))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        hi, lo = frame["hi"].to_numpy().astype("<u8"), frame["lo"].to_numpy().astype("<u8")
        row = build_shard(int(frame["shard"].iloc[0]), shards, hi, lo, frame["n"].to_numpy(), frame["keeper"].to_numpy())
        return pd.DataFrame([row], columns=[c.split()[0] for c in SHARD_SCHEMA.split(", ")])

    shard = F.expr(f"cast(shiftrightunsigned(hi, 33) % {shards} as int)")
    return materialise(found.withColumn("shard", shard).groupBy("shard").applyInPandas(build, SHARD_SCHEMA), "line-index")


def _finish(doc, text: str | None, lines: list[bytes], gone: set[int]) -> tuple:
    kept = b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode("utf-8") if gone else text or ""
    return doc, len(lines), len(gone), kept


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_lines", "n_dropped", "text"])


OUT_SCHEMA = "doc_id long, n_lines long, n_dropped long, text string"


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers (0 for none) and whether there is one."""
    return column.fill_null(0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)


def _probe_broadcast(docs: DataFrame, index: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    rows = index.collect()
    sent = docs.sparkSession.sparkContext.broadcast({r["shard"]: tuple(r)[2:] for r in rows})
    shards = rows[0]["shards"] if rows else 1

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: Shard(*v) for k, v in sent.value.items()}
        for batch in batches:
            split = [(doc, text, *hashed_lines(text, min_chars)) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            hi, lo = halves([d for *_, digests in split for d in digests])
            doc, named = (np.repeat(x, [len(own[3]) for own in split]) for x in _ids(batch.column(0)))
            gone, shard = np.zeros(len(hi), bool), _shard_of(hi, shards)
            for k in np.unique(shard):
                if k in tables:
                    mine = np.flatnonzero(shard == k)
                    gone[mine] = tables[k].drops(hi[mine], lo[mine], doc[mine], named[mine], min_docs)
            rows, start = [], 0
            for doc_id, text, lines, at, _ in split:
                own = gone[start : start + len(at)]
                rows.append(_finish(doc_id, text, lines, {at[i] for i in np.flatnonzero(own)}))
                start += len(at)
            yield _batch(rows)

    return docs.mapInArrow(probe, OUT_SCHEMA)


def _probe_routed(docs: DataFrame, index: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """Probes travel to the shards; a row's hits come back by its identifier and text hash, so
    that neither rows without an identifier nor rows that repeat one meet in one group."""
    shards = index.first()["shards"]
    docs = docs.withColumn("tag", F.xxhash64(docs[1]))

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, row = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = set(hashed_lines(text, min_chars)[2])
                digests.extend(own)
                row.extend([i] * len(own))
            hi, lo = halves(digests)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(_shard_of(hi, shards)), pa.array(hi.view("<i8")), pa.array(lo.view("<i8")), batch.column(0).take(at), batch.column(2).take(at)], ["shard", "hi", "lo", "doc", "tag"])

    probes = docs.mapInArrow(requests, "shard int, hi long, lo long, doc long, tag long")
    probes = probes.withColumn("salt", F.expr(f"cast(pmod(xxhash64(doc, tag), {PROBE_SALTS}) as int)")).withColumn("side", F.lit(1))
    arrays = index.drop("shards").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(PROBE_SALTS - 1)))).withColumn("side", F.lit(0))
    both = arrays.unionByName(probes, allowMissingColumns=True)
    names = ["shard", "salt", "side", "hi", "lo", "doc", "tag", "sizes", "words", "fingerprints", "counts", "keepers", "spare"]
    dealt = both.select(*names).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "side")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table = None, None
        for batch in batches:
            side, shard = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            start = 0
            while start < len(side):
                if side[start] == 0:
                    at, table = shard[start], Shard(*(batch.column(i)[start].as_py() for i in range(7, 13)))
                    start += 1
                    continue
                end = start
                while end < len(side) and side[end] == 1 and shard[end] == shard[start]:
                    end += 1
                if table is not None and at == shard[start]:
                    own = batch.slice(start, end - start)
                    gone = table.drops(*(own.column(i).to_numpy().astype("<u8") for i in (3, 4)), *_ids(own.column(5)), min_docs)
                    yield pa.RecordBatch.from_arrays([own.column(i).filter(pa.array(gone)) for i in (5, 6, 3, 4)], ["doc", "tag", "hi", "lo"])
                start = end

    hits = dealt.mapInArrow(stream, "doc long, tag long, hi long, lo long").groupBy("doc", "tag").agg(F.collect_set(F.struct("hi", "lo")).alias("hits"))
    hits = hits.withColumnRenamed("tag", "hit_tag")
    paired = docs.join(hits, docs[0].eqNullSafe(hits["doc"]) & (docs["tag"] == hits["hit_tag"]), "left")
    paired = paired.select(docs[0], docs[1], F.col("hits.hi").alias("his"), F.col("hits.lo").alias("los"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, his, los in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                lines, at, digests = hashed_lines(text, min_chars)
                out = set(zip(his or (), los or (), strict=True))
                gone = {i for i, d in zip(at, digests, strict=True) if (int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)) in out}
                rows.append(_finish(doc, text, lines, gone))
            yield _batch(rows)

    return paired.mapInArrow(finish, OUT_SCHEMA)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Drop lines that at least ``min_docs`` documents hold, except in the largest identifier holding each.

    Only lines whose key has ``min_chars`` code points or more can be dropped.
    Returns (doc_id, n_lines, n_dropped, text) with a row for each input row.
    """
    docs = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    index = build_index(docs, min_chars, min_docs)
    size = index.agg(F.sum(sum(F.octet_length(c) for c in ("words", "fingerprints", "counts", "keepers", "spare")))).first()[0]
    return (_probe_routed if size and size > broadcast_bytes else _probe_broadcast)(docs, index, min_chars, min_docs)
