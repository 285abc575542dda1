"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard checks.

All signature coordinates come from two permutations of a table of D slots: the
first scatters the hashed shingles, the second gives the values, and coordinate k
reads the second one shifted circularly by k.  A signature is therefore a running
minimum over windows of one table.

1. One map over the documents hashes each text's set of word shingles and makes a
   128-bit digest of the set and the band keys.  Texts with equal sets form a
   class (J = 1) that its smallest identifier represents, so exact copies are
   settled by one aggregation and never paired.
2. Representatives that share a band key are candidates.  In every band bucket all
   members are compared with one centre only, the smallest identifier: a bucket of
   m members gives m - 1 pairs, not m squared.  Pairs are confirmed on the full
   sets, and confirmed links are merged into components.
3. Buckets whose members are not all in one component yet form clusters.  Pairs of
   different components that share a band are checked there in blocks of bounded
   size: the cluster's largest component is never paired with itself, a task holds
   two blocks, and only links that join components leave it.  Nothing is capped, so
   no link between components is lost.

Defined results: null and empty texts have no shingles and are linked with
nothing; a text of fewer words than the shingle is one shingle.  Rows with a null
identifier are linked with nothing (their component is null).  Rows that repeat an
identifier are one node, whatever their texts: what one of them is linked with, all are.
Empty input gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueweave.functions.storage import materialise, spread
from cueweave.llm.memory import release, releasing, small_batches

SLOTS = 1 << 20
BANDS, ROWS = 42, 6
SEED = 7
MEMO_WORDS = 100_000
BLOCK_MEMBERS = 256
DENSE_CELLS = 40_000_000
CHUNK_CELLS = 8_000_000
BROADCAST_IDS = 200_000


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, words: int, memo: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
    width = min(words, len(tokens))
    total = np.full(len(tokens) - width + 1, width, np.uint64)
    for i in range(width):
        part = hashes[i : i + len(total)]
        total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + part * np.uint64(0x9E3779B97F4A7C15)
    total ^= total >> np.uint64(32)
    total *= np.uint64(0x94D049BB133111EB)
    total ^= total >> np.uint64(29)
    return np.unique(total)


class Circulant:
    """Signatures from two permutations."""

    def __init__(self, coordinates: int, seed: int = SEED, slots: int = SLOTS):
        rng = np.random.default_rng(seed)
        self.slots = slots
        self.first = rng.permutation(slots).astype(np.int32)
        second = rng.permutation(slots).astype(np.uint32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:coordinates]]), coordinates)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = self.first[(shingles & np.uint64(self.slots - 1)).astype(np.int64)]
        out = self.windows[at[:512]].min(axis=0)
        for i in range(512, len(at), 512):
            np.minimum(out, self.windows[at[i : i + 512]].min(axis=0), out=out)
        return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of a signature."""
    table = signature[: bands * rows].reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(rows):
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + table[:, i] * np.uint64(0x9E3779B97F4A7C15)
    return key ^ (key >> np.uint64(30))


def sketches(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, set_digest, keys) of each document; keys only for documents with an identifier."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, circulant = WordHashes(), Circulant(bands * rows)
        for batch in batches:
            sizes, digests, keys, last = [], [], [], {}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shingles = shingle_set(text.as_py(), words, memo)
                sizes.append(len(shingles))
                linked = len(shingles) and doc is not None
                digest = xxhash.xxh3_128_digest(shingles.tobytes()) if linked else None
                digests.append(digest)
                if linked and digest not in last:
                    last[digest] = band_keys(circulant.signature(shingles), bands, rows).view(np.int64)
                    keys.append(last[digest])
                else:  # a copy in the same batch: its class has the keys already
                    keys.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_digest", "keys"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_digest binary, keys array<long>")


def _shingle_table(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(rep, shingles) of the representatives in ``ids``; texts of other documents are not moved."""
    ids = ids.withColumnRenamed("rep", "wanted")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.join(ids, docs["doc_id"] == ids["wanted"], "left_semi")

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            step = 256
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                sets = [shingle_set(t.as_py(), words, memo).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["rep", "shingles"])

    return materialise(texts.mapInArrow(run, "rep long, shingles array<long>"), "shingles")


def confirm(pairs: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with their exact distance and whether they are linked."""
    left = table.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    right = table.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("common"), F.size("x").cast("long").alias("nx"), F.size("y").cast("long").alias("ny"))
    union = F.col("nx") + F.col("ny") - F.col("common")
    return both.select("a", "b", (100 * F.col("common") >= percent * union).alias("linked"), (1 - F.col("common") / union).alias("distance"))


def components(edges: DataFrame) -> DataFrame:
    """(rep, component) of every node with an edge: the smallest identifier that it reaches.

    Labels spread along edges and then jump to their label's label until nothing
    changes; each round is written, so a lost executor costs one round at most.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("component")).select("rep", F.least("rep", "component").alias("component"))
    while True:
        labels = materialise(labels, "labels")
        near = both.join(labels, both["b"] == labels["rep"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["rep"] == near["a"], "left").select("rep", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        jump = labels.select(F.col("rep").alias("new"), F.col("component").alias("far"))
        moved = materialise(step.join(jump, "new", "left").select("rep", "old", F.least("new", "far").alias("component")), "labels")
        if moved.filter("old <> component").isEmpty():
            return moved.select("rep", "component")
        labels = moved.select("rep", "component")


def star_components(pairs: DataFrame) -> DataFrame:
    """(rep, component) of the members b and centres a of star-shaped links.

    A member's centres are connected through it, so it stands for edges between its
    smallest centre and its others; only that much smaller graph is iterated.
    """
    pairs = materialise(pairs.select("a", "b").distinct(), "stars")
    first = pairs.groupBy("b").agg(F.min("a").alias("first"))
    centres = pairs.select(F.col("a").alias("centre")).distinct()
    between = pairs.join(first, "b").filter("a <> first").select(F.col("first").alias("a"), F.col("a").alias("b"))
    chained = first.join(centres, first["b"] == centres["centre"], "left_semi").select(F.col("first").alias("a"), "b")
    top = components(between.unionByName(chained)).withColumnRenamed("rep", "first")
    nodes = first.select(F.col("b").alias("rep"), "first").unionByName(centres.select(F.col("centre").alias("rep"), F.col("centre").alias("first")))
    found = nodes.join(top, "first", "left").groupBy("rep").agg(F.min(F.coalesce("component", "first")).alias("component"))
    return materialise(found, "labels")


def _cross_links(ids: np.ndarray, sides: np.ndarray, component: np.ndarray, keys: np.ndarray, sets: list[np.ndarray], percent: int, across: bool) -> list[tuple[int, int]]:
    """Links between members of different components that share a band, as few as connect
    the same components.  ``across``: only between the two sides."""
    share = np.zeros((len(ids), len(ids)), bool)
    for band in keys.T:
        share |= band[:, None] == band[None, :]
    share &= component[:, None] != component[None, :]
    if across:
        share &= sides[:, None] != sides[None, :]
    first, second = np.nonzero(np.triu(share, 1))
    if not len(first):
        return []
    sizes = np.array([len(x) for x in sets], np.int64)
    close = 100 * np.minimum(sizes[first], sizes[second]) >= percent * np.maximum(sizes[first], sizes[second])
    first, second = first[close], second[close]
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    if len(values) * len(ids) <= DENSE_CELLS:
        order = np.argsort(at, kind="stable")
        owner, at = np.repeat(np.arange(len(ids)), sizes)[order], at[order]
        width, product = max(1, CHUNK_CELLS // len(ids)), np.zeros((len(ids), len(ids)))
        for low in range(0, len(values), width):
            i, j = np.searchsorted(at, (low, low + width))
            holds = np.zeros((len(ids), min(width, len(values) - low)), np.float32)
            holds[owner[i:j], at[i:j] - low] = 1
            product += holds @ holds.T
        common = product[first, second].astype(np.int64)
    else:
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(first, second, strict=True)], np.int64)
    linked = 100 * common >= percent * (sizes[first] + sizes[second] - common)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for i, j in zip(first[linked], second[linked], strict=True):
        a, b = find(int(component[i])), find(int(component[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(ids[i]), int(ids[j])))
    return out


def open_units(members: DataFrame, labels: DataFrame, block: int) -> DataFrame | None:
    """(cluster, rep, component, own, units) of the members (key, rep, centre) of keys whose
    members are in several components; units are the pairs of blocks that a member is in."""
    placed = members.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    open_ = materialise(placed.join(mixed.select("key"), "key").select("rep", "centre", "component").distinct(), "open")
    if open_.isEmpty():
        return None
    cluster = star_components(open_.filter("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")))
    inside = open_.select("rep", "component").distinct().join(cluster.select("rep", F.col("component").alias("cluster")), "rep")
    inside = materialise(inside, "clusters")
    counts = inside.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"))
    blocks = inside.join(main, "cluster").withColumn("own", F.col("component") == F.col("main"))
    blocks = blocks.withColumn("others", F.ceil((F.col("n") - F.col("n_main")) / block)).withColumn("mains", F.ceil(F.col("n_main") / block))
    spread = F.xxhash64("rep")
    blocks = blocks.withColumn("at", F.when(F.col("own"), F.pmod(spread, "mains")).otherwise(F.pmod(spread, "others")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    meet = lambda across, i, j: F.struct(F.lit(across).alias("across"), i.alias("i"), j.alias("j"))
    units = F.when(F.col("own"), F.transform(upto(F.col("others")), lambda i: meet(True, i, F.col("at")))).otherwise(
        F.concat(F.transform(upto(F.col("others")), lambda j: meet(False, F.least("at", j), F.greatest("at", j))), F.transform(upto(F.col("mains")), lambda j: meet(True, F.col("at"), j)))
    )
    return blocks.select("cluster", "rep", "component", "own", units.alias("units"))


def _open_links(members: DataFrame, classes: DataFrame, labels: DataFrame, table: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) that the centres have not shown.

    Buckets whose members are in several components form clusters by shared
    members.  In a cluster only pairs of different components can matter, so its
    largest component is never paired with itself: the others, in blocks, meet one
    another and the blocks of the largest.  A task holds two blocks, and gives the
    links that join components, not the pairs.
    """
    units = open_units(members, labels, block)
    if units is None:
        return labels.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    dealt = units.join(classes.select("rep", "keys"), "rep").join(table, "rep")
    dealt = dealt.select("cluster", "rep", "component", "own", "keys", "shingles", F.explode("units").alias("unit")).select("*", "unit.*").drop("unit")

    def test(group: pd.DataFrame) -> pd.DataFrame:
        links = _cross_links(
            group["rep"].to_numpy(), group["own"].to_numpy(), group["component"].to_numpy(), np.stack(group["keys"].to_numpy()),
            [np.asarray(x) for x in group["shingles"]], percent, bool(group["across"].iloc[0]),
        )
        release()
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return materialise(dealt.groupBy("cluster", "across", "i", "j").applyInPandas(test, "a long, b long"), "open-links")


def repeated_ids(sketch: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, a, b) of identifiers whose rows are not all in one class: a is the least of
    their classes' representatives, b each of them."""
    rows = sketch.filter("doc_id is not null").groupBy("doc_id").agg(F.min("set_digest").alias("low"), F.max("set_digest").alias("high"), F.count("set_digest").alias("filled"), F.count(F.lit(1)).alias("n"))
    ids = materialise(rows.filter("low <> high or (filled > 0 and filled < n)").select("doc_id"), "repeated-ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    held = sketch.filter("set_digest is not null").join(wanted, "doc_id").select("doc_id", "set_digest").distinct()
    held = held.join(classes.select("set_digest", "rep"), "set_digest").select("doc_id", F.col("rep").alias("b"))
    return held.join(held.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").select("doc_id", "a", "b")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """Components of documents linked by 100 * |intersection| >= percent * |union|.

    Returns (doc_id, n_shingles, component_id, kept) with a row for each input
    row; the smallest identifier of each component is kept.
    """
    small_batches(docs.sparkSession)
    docs = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    sketch = materialise(sketches(docs, words, bands, rows), "sketches")
    classes = sketch.filter("set_digest is not null").groupBy("set_digest").agg(F.min("doc_id").alias("rep"), F.max("keys").alias("keys"))
    classes = materialise(classes, "classes")
    buckets = classes.select("rep", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("other")).filter("centre <> other")
    members = materialise(buckets.join(shared.select("key", "centre"), "key"), "buckets")

    table = _shingle_table(docs, members.select("rep").distinct(), words)
    pairs = members.filter("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    tested = materialise(confirm(pairs, table, percent), "tested")
    labels = star_components(tested.filter("linked"))
    more = _open_links(members, classes, labels, table, percent, block_members)
    several = materialise(repeated_ids(sketch, classes), "repeated")
    more = more.unionByName(several.filter("a <> b").select("a", "b"))
    if not more.isEmpty():
        # Links between members are links between their components.
        at = labels.select("rep", "component")
        ends = more.join(at.toDF("a", "ca"), "a", "left").join(at.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        merged = components(ends.filter("a <> b")).toDF("component", "top")
        alone = ends.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(labels, "rep", "left_anti").select("rep", F.col("rep").alias("component"))
        labels = labels.unionByName(alone).join(merged, "component", "left").select("rep", F.coalesce("top", "component").alias("component"))

    whole = classes.select("set_digest", "rep").join(labels, "rep", "left").select("set_digest", F.coalesce("component", "rep").alias("component"))
    out = sketch.join(whole, "set_digest", "left")
    if not several.isEmpty():  # rows without shingles go with the other rows of their identifier
        named = several.select("doc_id", F.col("a").alias("rep")).distinct().join(labels, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("named"))
        out = out.join(named, "doc_id", "left").withColumn("component", F.coalesce("component", "named"))
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
