"""An exact n-gram Jaccard join by size-banded tiles, bitmap signatures and sorted arrays.

1. One map hashes each text's set of word n-grams.  Equal sets form a class that its
   smallest identifier represents, so copies are never paired.
2. Sizes fall into bands whose upper bounds grow as 1 / threshold, so linked sets lie in
   one band or in neighbours.  In the scheme of a band with upper bound h, linked sets
   differ in at most d elements (d follows from h and the threshold); the hash space is
   cut into d + 1 ranges, so at least one range holds the same elements in both.  A set
   therefore lies in the tiles (band, range, elements in the range) of its own band and of
   the next one, and no linked pair is missed.  Empty ranges make no tiles, as they would
   gather sets that have nothing in common: sets that have one, as both of a pair must whose
   like ranges are all empty, lie in the tiles of 2 d + 2 ranges too, of which a pair shares
   more than are empty.  Unequal sets of a size that allows no difference have no tiles.
3. Each set has a bitmap of hashed elements, some times as wide as the set is large.  Bits that
   differ stand for different elements, so bit counts bound the overlap from above; pairs
   that the bound leaves are counted exactly on the sorted arrays.
4. In every tile all members meet one centre; a tile of m members gives m - 1 pairs.
   Confirmed links make components.  In tiles whose members are in several components yet,
   another centre follows, one that is not connected to the first.  What is open after
   ``rounds`` centres is compared in blocks of bounded size, two to a task, bitmaps first and
   then sorted arrays; pairs inside a component are passed over, the largest component of a
   cluster of tiles is not compared with itself, and only links that join components come
   out.  Nothing is capped, so no link between different sets is lost.

Defined results: null and empty texts have no n-grams and are linked with nothing; a text
of fewer words than n is one n-gram.  Rows with a null identifier are linked with nothing
(their component is null).  Rows that repeat an identifier are one node.  Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueweave.functions.storage import materialise, spread
from cueweave.llm.memory import release, releasing, small_batches
from cueweave.llm.minhash import BROADCAST_IDS, WordHashes, components, open_units, repeated_ids, shingle_set, star_components

ROUNDS, BLOCK = 2, 128
LEAST_BITS, MOST_BITS = 64, 1 << 18


class Bands:
    """Size bands, tiles and bitmaps for links of 100 * |common| >= percent * |union|."""

    def __init__(self, percent: int):
        self.percent = percent
        self.tops = [0]
        self.edges: dict[int, np.ndarray] = {}

    def differ(self, total: int) -> int:
        """The most elements in which linked sets of ``total`` elements together can differ."""
        return total * (100 - self.percent) // (100 + self.percent)

    def band(self, size: int) -> int:
        """The number of the band that holds ``size``."""
        while self.tops[-1] < size:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * 100 // self.percent))
        return int(np.searchsorted(self.tops, size))

    def top(self, band: int) -> int:
        while len(self.tops) <= band:
            self.band(self.tops[-1] + 1)
        return self.tops[band]

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """The tiles of a sorted set: in its own band's scheme and in the next one's."""
        own, out = self.band(len(shingles)), []
        mixed = (shingles ^ (shingles >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        mixed ^= mixed >> np.uint64(28)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        for band in (own, own + 1):
            differ = self.differ(2 * self.top(band))
            if not differ:  # only equal sets are linked
                continue
            for times in (1, 2):
                key, held = self._ranges(shingles, sums, band, times * (differ + 1))
                enough = len(held) - np.count_nonzero(held) < len(held) - differ
                out.append(key[held > 0] if times == 1 or enough else key)
                if held.all():
                    break
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def _ranges(self, shingles: np.ndarray, sums: np.ndarray, band: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """A key for the content of each range of the hash space, and how many elements it has."""
        if parts not in self.edges:
            self.edges[parts] = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
        at = np.concatenate([[0], np.searchsorted(shingles, self.edges[parts]), [len(shingles)]])
        held = np.diff(at)
        key = sums[at[1:]] - sums[at[:-1]]
        key += held.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        key = (key ^ (key >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        key += np.arange(parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((band * 0xC2B2AE3D27D4EB4F + parts) % 2**64)
        return (key ^ (key >> np.uint64(30))) * np.uint64(0x94D049BB133111EB), held

    def width(self, size: int) -> int:
        """Bits of a bitmap: the power of two at or over eight times the band's largest size, so
        that few differences hide behind other elements."""
        top = 8 * self.top(self.band(size))
        return min(MOST_BITS, max(LEAST_BITS, 1 << (top - 1).bit_length()))

    def bitmap(self, shingles: np.ndarray) -> np.ndarray:
        width = self.width(len(shingles))
        bits = np.zeros(width, bool)
        bits[(shingles & np.uint64(width - 1)).astype(np.int64)] = True
        return np.packbits(bits, bitorder="little").view(np.uint64)

    def possible(self, size: np.ndarray, other: np.ndarray, differing: np.ndarray) -> np.ndarray:
        """Whether sets whose bitmaps differ in that many bits can be linked."""
        total = size + other
        common = (total - differing) // 2
        common = np.minimum(common, np.minimum(size, other))
        return 100 * common >= self.percent * (total - common)


def fold(bitmap: np.ndarray, words: int) -> np.ndarray:
    """A bitmap narrowed to so many words: bits are numbered modulo the width."""
    return np.bitwise_or.reduce(bitmap.reshape(-1, words), axis=0) if len(bitmap) > words else bitmap


def differing_bits(first: np.ndarray, second: np.ndarray) -> int:
    words = min(len(first), len(second))
    return int(np.bitwise_count(fold(first, words) ^ fold(second, words)).sum())


# ---------------------------------------------------------------- the Spark job
def sketches(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, set_digest, keys); the last two for documents with an identifier."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bands = WordHashes(), Bands(percent)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                sizes, digests, keys, last = [], [], [], set()
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    shingles = shingle_set(text.as_py(), words, memo)
                    sizes.append(len(shingles))
                    linked = len(shingles) and doc is not None
                    digest = xxhash.xxh3_128_digest(shingles.tobytes()) if linked else None
                    digests.append(digest)
                    fresh = linked and digest not in last  # a copy in the same batch: its class has the rest already
                    keys.append(bands.keys(shingles).view(np.int64) if fresh else None)
                    last.add(digest)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "set_digest", "keys"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_digest binary, keys array<long>")


def _shingles(docs: DataFrame, ids: DataFrame, words: int, percent: int, several: bool) -> DataFrame:
    """(rep, n, bitmap, shingles) of the representatives in ``ids``; other texts are not moved.
    ``several``: identifiers may repeat, with one set or more; empty ones link nothing."""
    ids = ids.withColumnRenamed("rep", "wanted")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bands = WordHashes(), Bands(percent)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [shingle_set(t.as_py(), words, memo) for t in part.column(1)]
                filled = [len(x) > 0 for x in sets]
                sets = [x for x in sets if len(x)]
                columns = [pa.array([len(x) for x in sets], pa.int64()), pa.array([bands.bitmap(x).tobytes() for x in sets], pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(filled, pa.bool_())), *columns], ["rep", "n", "bitmap", "shingles"])

    texts = docs.join(ids, docs["doc_id"] == ids["wanted"], "left_semi")
    sets = texts.mapInArrow(run, "rep long, n long, bitmap binary, shingles array<long>")
    return materialise(sets.distinct() if several else sets, "ngrams")


def bounded(pairs: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and bit counts allow a link."""
    left = table.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("x"))
    right = table.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").filter((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            bits = np.array([differing_bits(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column(4), batch.column(5), strict=True)], np.int64)
            keep = pa.array(bands.possible(na, nb, bits))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return both.select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, counted on their sorted arrays."""
    left, right = table.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), table.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, rep, component, low) of the members of the tiles that several components share
    yet; low is the tile's least component."""
    placed = members.join(labels, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    return placed.join(mixed.select("key", "low"), "key")


def unit_links(ids: list[int], own: list[bool], component: list[int], sets: list[np.ndarray], percent: int, across: bool) -> list[tuple[int, int]]:
    """Links between sets of different components, as few as connect the same components.
    ``across``: only between the two sides."""
    bands = Bands(percent)
    size = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(size, kind="stable")
    ids, sets, size = [ids[i] for i in order], [sets[i] for i in order], size[order]
    side, part = np.array(own)[order], np.array(component, np.int64)[order]
    maps = [bands.bitmap(x) for x in sets]
    words = min(map(len, maps))
    maps = np.stack([fold(x, words) for x in maps])
    out = []
    for i in range(len(ids) - 1):
        rest = np.arange(i + 1, int(np.searchsorted(size, size[i] * 100 // percent, "right")))
        rest = rest[(part[rest] != part[i]) & ((side[rest] != side[i]) if across else True)]
        if not len(rest):
            continue
        bits = np.bitwise_count(maps[rest] ^ maps[i]).sum(axis=1, dtype=np.int64)
        fine = bands.possible(size[i], size[rest], bits)
        for j in rest[fine][np.argsort(bits[fine], kind="stable")]:
            if part[i] != part[j]:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= percent * (size[i] + size[j] - common):
                    out.append((ids[i], ids[j]))
                    low, high = sorted((part[i], part[j]))
                    part[part == high] = low
    return out


def _cluster_links(members: DataFrame, labels: DataFrame, table: DataFrame, percent: int, block: int) -> DataFrame | None:
    """Links (a, b) between components that share tiles; none if no tile is open."""
    units = open_units(members, labels, block)
    if units is None:
        return None
    dealt = units.join(table.select("rep", "shingles"), "rep").select("cluster", "rep", "component", "own", "shingles", F.explode("units").alias("u"))
    dealt = dealt.select("cluster", "u.across", "u.i", "u.j", "rep", "component", "own", "shingles")

    def test(unit: tuple, rows: pa.Table) -> pa.Table:
        ids, component, sides = (rows.column(c).to_pylist() for c in ("rep", "component", "own"))
        sets = [x.values.to_numpy().view(np.uint64) for x in rows.column("shingles")]
        links = unit_links(ids, sides, component, sets, percent, unit[1].as_py())
        del sets
        release()
        return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return dealt.groupBy("cluster", "across", "i", "j").applyInArrow(test, "a long, b long")


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components (rep, component) after more links (a, b)."""
    at = labels.select("rep", "component")
    ends = links.join(at.toDF("a", "ca"), "a", "left").join(at.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    ends = materialise(ends.filter("a <> b").distinct(), "component-links")
    if ends.isEmpty():
        return labels
    merged = components(ends).toDF("component", "top")
    alone = ends.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(labels, "rep", "left_anti").select("rep", F.col("rep").alias("component"))
    return materialise(labels.unionByName(alone).join(merged, "component", "left").select("rep", F.coalesce("top", "component").alias("component")), "labels")


def linked_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90, rounds: int = ROUNDS, block: int = BLOCK
) -> DataFrame:
    """(doc_id, n_shingles, component_id) with a row for each input row.

    Documents are linked by 100 * |common| >= percent * |union| of their word n-grams;
    ``component_id`` is the smallest identifier that a document reaches.
    """
    small_batches(docs.sparkSession)
    docs = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    sketch = materialise(sketches(docs, words, percent), "ngram-sketches")
    # Keys are written once, with the sketches, and move once to their class and once to their tile.
    classed = sketch.filter("set_digest is not null").groupBy("set_digest")
    tiles = classed.agg(F.min("doc_id").alias("rep"), F.max("keys").alias("keys")).select("rep", F.explode("keys").alias("key"))
    tile = Window.partitionBy("key")
    tiles = tiles.select("key", "rep", F.min("rep").over(tile).alias("centre"), F.max("rep").over(tile).alias("other"))
    members = materialise(tiles.filter("centre <> other").select("key", "rep", "centre"), "tiles")
    classes = materialise(classed.agg(F.min("doc_id").alias("rep")), "ngram-classes")
    several = sketch.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    several = not materialise(several, "repeated-ids").isEmpty()

    table = _shingles(docs, members.select("rep").distinct(), words, percent, several)
    labels = None
    for turn in range(rounds):
        if turn == 0:
            pairs = members.filter("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
        else:
            open_ = materialise(_open(members, labels), "open-tiles")
            if open_.isEmpty():
                break
            # Another centre: the least member of the next component.
            centres = open_.filter("component <> low").groupBy("key").agg(F.min(F.struct("component", "rep")).alias("c"))
            met = open_.join(centres, "key").filter("component <> c.component")
            pairs = met.select(F.least("c.rep", "rep").alias("a"), F.greatest("c.rep", "rep").alias("b")).distinct()
        links = materialise(confirmed(materialise(bounded(pairs, table, percent), "bounded"), table, percent), "links")
        labels = star_components(links) if labels is None else _merge(labels, links)
    more = _cluster_links(members, labels, table, percent, block)
    if more is not None:
        labels = _merge(labels, materialise(more, "cluster-links"))

    ties = None
    if several:
        ties = materialise(repeated_ids(sketch, classes), "ties")
        labels = _merge(labels, ties.filter("a <> b").select("a", "b"))
    whole = classes.select("set_digest", "rep").join(labels, "rep", "left").select("set_digest", F.coalesce("component", "rep").alias("component"))
    out = sketch.select("doc_id", "n_shingles", "set_digest").join(whole, "set_digest", "left")
    if several:  # rows without n-grams go with the other rows of their identifier
        named = ties.select("doc_id", F.col("a").alias("rep")).distinct().join(labels, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("named"))
        out = out.join(named, "doc_id", "left").withColumn("component", F.coalesce("component", "named"))
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
