"""Mixing overlapping sources to target weights as a minimum-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold
them), so the flow network has a node for each pattern and each source, however
many documents there are.  A pattern can give its words once for free, a second
time at a cost, a third time at a higher cost and so on (convex repetition
costs); sources take words up to their quota.  The capacity is routed along shortest
paths, all paths of one cost at a time, and each pattern's flow is then spread over its
documents: whole passes for all, and the rest for the documents that come first in a
seeded hash order.  Where the order is cut is found level by level with histograms of
256 hash buckets, summed before they are shuffled, so only the documents that share the
leading bits of the cut are ever ordered one by one; there the last document may be taken
in part.  The order is a hash of identifier and text.  Rows that share it are counted by
partition first and then placed behind the counts of earlier partitions, so a group of
copies, however large, is never sorted in one task.  ``routes`` tells how many of a
pattern's words count for each of its sources.

The flow is routed on the driver, for at most ``max_patterns`` patterns (100,000 patterns
of two out of 100 sources took 7 s).  If there are more, every pattern is narrowed to its
neediest sources (largest quota for their size): to as many of them as leave no more than
``max_patterns`` narrowed patterns, a single one if need be.  All documents still take
part and quotas and repeats hold; a document then counts for these sources only, so the
flow is the cheapest among such flows.

Defined results: a null text has size 0; documents of size 0 are never taken.  A
null source is a source of its own, ordered last; a null array of sources is none, and
such documents are not taken.  Repeated rows count and are taken like any others; null
identifiers count as -1 in the hash.  Which of several rows alike in identifier, text and
sources are taken is open, how many are is not.  Empty input gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Sequence
from fractions import Fraction
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueweave.functions.storage import materialise

WEIGHTS = (3, 1, 2)
LEVEL_BITS, LEVELS = 8, 3
MAX_PATTERNS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def target_words(sizes: Sequence[int], weights: Sequence[int], share: Fraction = Fraction(3, 2), most: int = 2) -> list[Fraction]:
    """Split ``share`` of all words by weight; what exceeds ``most`` times a source's
    size is shared again among the others until none is above."""
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    targets = [Fraction(0)] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        above = {i for i in open_ if weights[i] * unit > most * sizes[i]}
        for i in above or open_:
            targets[i] = Fraction(most * sizes[i]) if above else weights[i] * unit
            left -= targets[i]
        if not above:
            break
        open_ -= above
    return targets


class Network:
    """Arcs with capacities and costs; arc i and its way back, i ^ 1, lie side by side."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.price = [0] * nodes

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for start, end, own, price in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[start].append(len(self.to))
            self.to.append(end)
            self.room.append(own)
            self.cost.append(price)
        return len(self.to) - 2

    def reprice(self, root: int, sink: int) -> bool:
        """Raise prices by the distances from the root, so that cheapest paths cost nothing."""
        distance, heap = {root: 0}, [(0, root)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > distance[a]:
                continue
            for i in self.out[a]:
                b = self.to[i]
                if self.room[i] and (new := d + self.cost[i] + self.price[a] - self.price[b]) < distance.get(b, float("inf")):
                    distance[b] = new
                    heapq.heappush(heap, (new, b))
        if sink not in distance:
            return False
        most = distance[sink]
        for a in range(len(self.out)):
            self.price[a] += min(distance.get(a, most), most)
        return True

    def levels(self, root: int, sink: int) -> list[int] | None:
        """Steps from the root along arcs that cost nothing; None if they do not reach the sink."""
        level, queue = [-1] * len(self.out), deque([root])
        level[root] = 0
        while queue:
            a = queue.popleft()
            for i in self.out[a]:
                b = self.to[i]
                if level[b] < 0 and self.room[i] and self.cost[i] + self.price[a] == self.price[b]:
                    level[b] = level[a] + 1
                    queue.append(b)
        return level if level[sink] >= 0 else None

    def fill(self, root: int, sink: int, level: list[int]) -> None:
        """Send what goes along paths that rise by one level with each arc."""
        at, path, a = [0] * len(self.out), [], root
        while True:
            if a == sink:
                amount = min(self.room[i] for i in path)
                for i in path:
                    self.room[i] -= amount
                    self.room[i ^ 1] += amount
                full = next(k for k, i in enumerate(path) if not self.room[i])
                a = self.to[path[full] ^ 1]
                del path[full:]
                continue
            for k in range(at[a], len(self.out[a])):
                i = self.out[a][k]
                b = self.to[i]
                if self.room[i] and level[b] == level[a] + 1 and self.cost[i] + self.price[a] == self.price[b]:
                    at[a] = k
                    path.append(i)
                    a = b
                    break
            else:
                at[a] = len(self.out[a])
                if not path:
                    return
                a = self.to[path.pop() ^ 1]
                at[a] += 1


def route(supplies: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], repeats: int) -> list[dict[int, int]]:
    """Minimum-cost maximum flow from patterns to the sources that hold them.

    Pattern p may give ``supplies[p]`` words ``repeats`` times, pass r at cost r.
    Returns for each pattern the words that it gives to each source.
    """
    first, sink = len(quotas), len(quotas) + len(supplies)
    root = sink + 1
    net, given = Network(root + 1), []
    for s, quota in enumerate(quotas):
        net.arc(s, sink, quota, 0)
    for p, supply in enumerate(supplies):
        for level in range(repeats):
            net.arc(root, first + p, supply, level)
        given.append({s: net.arc(first + p, s, supply * repeats, 0) for s in members[p]})
    while net.reprice(root, sink):
        while (level := net.levels(root, sink)) is not None:
            net.fill(root, sink, level)
    return [{s: net.room[i ^ 1] for s, i in arcs.items() if net.room[i ^ 1]} for arcs in given]


SOURCE = "struct<none:boolean,name:string>"


def _cut(sized: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """(pattern, cut, before): the leading bits of the hash at which each pattern's rest ends,
    and the words of the documents with lesser bits."""
    cut = plan.filter("rest > 0").select("pattern", "rest", F.lit(0).cast("long").alias("cut"), F.lit(0).cast("long").alias("before"))
    for level in range(1, LEVELS + 1):
        prefix = F.shiftrightunsigned("order", 64 - LEVEL_BITS * level)
        inside = sized.join(F.broadcast(cut) if few else cut, "pattern").filter(F.shiftright(prefix, LEVEL_BITS) == F.col("cut"))
        histogram = inside.groupBy("pattern", prefix.alias("cut")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("start"))
        upto = Window.partitionBy("pattern").orderBy("cut")  # at most 2 ** LEVEL_BITS rows
        histogram = histogram.withColumn("before", F.col("start") + F.sum("words").over(upto) - F.col("words"))
        cut = histogram.filter("before < rest and before + words >= rest").select("pattern", "rest", "cut", "before")
    return cut.drop("rest")


def _narrowed(sized: DataFrame, need: dict[tuple[bool, str], tuple[Fraction, int, Fraction]], max_patterns: int) -> DataFrame:
    """``sized`` with each pattern narrowed to its neediest sources, so that few patterns are left.

    ``need`` has the need, size and target of each source.  Adds ``whole``, the pattern as
    it was, and source_size and target, the sums over it.
    """
    ranked = sorted(need, key=lambda s: (-need[s][0], s))
    rows = [({"none": s[0], "name": s[1]}, i, need[s][1], float(need[s][2])) for i, s in enumerate(ranked)]
    sources = sized.sparkSession.createDataFrame(rows, f"source {SOURCE}, place long, own_size long, own_target double")
    if len(rows) <= max_patterns:
        sources = F.broadcast(sources)
    held = sized.select("row", F.explode("pattern").alias("source")).join(sources, "source")
    held = held.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("place", "source"))).alias("needy"),  # a document's own sources
        F.sum("own_size").alias("source_size"), F.sum("own_target").alias("target"),
    )
    needy = F.coalesce(F.transform("needy", lambda x: x["source"]), F.array().cast(f"array<{SOURCE}>"))
    sized = sized.join(held, "row", "left").withColumn("needy", needy).fillna(0, ["source_size", "target"])
    sized = materialise(sized, "mix-needs")
    width = sized.agg(F.max(F.size("needy"))).first()[0] // 2
    while width > 1 and sized.select(F.slice("needy", 1, width)).distinct().limit(max_patterns + 1).count() > max_patterns:
        width //= 2
    whole = sized.withColumnRenamed("pattern", "whole")
    return whole.withColumn("pattern", F.array_sort(F.slice("needy", 1, max(1, width)))).drop("needy")


def _behind(edge: DataFrame) -> DataFrame:
    """Adds ``done``: the words of a pattern's rows that come before each row of ``edge``.

    The order is that of (order, doc_id, size, partition, row), the last two of the written
    table.  Words are summed by all but the row first, so one window sees a row for each
    of these sums and the other only rows alike in one partition.
    """
    alike = ["pattern", "order", "doc_id", "size", "part"]
    edge = edge.withColumn("part", F.shiftright("row", 33))
    upto = Window.partitionBy("pattern").orderBy("order", "doc_id", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = edge.groupBy(*alike).agg(F.sum("size").alias("words"))
    sums = sums.select(*[F.col(c).alias(f"{c}_") for c in alike], F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("ahead"))
    placed = edge.join(sums, reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in alike]))
    nth = F.row_number().over(Window.partitionBy(*alike).orderBy("row"))
    return placed.withColumn("done", F.col("before") + F.col("ahead") + (nth - 1) * F.col("size")).drop("part", "ahead", *[f"{c}_" for c in alike])


def mix(docs: DataFrame, sources: Column, *, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[int] = WEIGHTS, share: Fraction = Fraction(3, 2), repeats: int = 2, seed: int = 20_240_501, max_patterns: int = MAX_PATTERNS, carry: Sequence[str] = ()) -> DataFrame:
    """Choose how many words the mix takes of each document.

    ``sources`` gives the array of a document's sources (null elements allowed).
    Sources are ordered by code point, null last, and get ``weights`` in turn.
    Returns (doc_id, pattern, size, source_size, target, taken, routes) and the columns
    in ``carry``; for a document in several sources, source_size and target are sums
    over them.
    """
    spark = docs.sparkSession
    marked = F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.struct(s.isNull().alias("none"), F.coalesce(s, F.lit("")).alias("name")))))
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(marked, F.array().cast(f"array<{SOURCE}>")).alias("pattern"),
        word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), F.col(text_col)).alias("order"),
        F.monotonically_increasing_id().alias("row"), *([F.struct(*carry).alias("carried")] if carry else []),
    )
    sized = materialise(sized, "mix-sizes")

    totals = sized.groupBy("pattern").agg(F.sum("size").alias("words"))
    found = totals.limit(max_patterns + 1).collect()
    narrow = len(found) > max_patterns
    if narrow:
        held = sized.select(F.explode("pattern").alias("s"), "size").groupBy("s").agg(F.sum("size").alias("words")).collect()  # a row for each source
        by_source = {(r["s"]["none"], r["s"]["name"]): r["words"] for r in held}
    else:
        by_source = {}
        for r in found:
            for s in r["pattern"]:
                by_source[s["none"], s["name"]] = by_source.get((s["none"], s["name"]), 0) + r["words"]
    names = sorted(by_source)
    number, sizes = {s: i for i, s in enumerate(names)}, [by_source[s] for s in names]
    targets = target_words(sizes, [weights[i % len(weights)] for i in range(len(names))], share, repeats)
    if narrow:
        need = {s: (Fraction(t, max(1, n)), n, t) for s, n, t in zip(names, sizes, targets, strict=True)}
        sized = _narrowed(sized, need, max_patterns)
        found = sized.groupBy("pattern").agg(F.sum("size").alias("words")).collect()
    found = sorted((tuple((x["none"], x["name"]) for x in r["pattern"]), r["words"]) for r in found)
    flows = route([w for _, w in found], [[number[s] for s in p] for p, _ in found], [round(t) for t in targets], repeats)

    rows = []
    for (pattern, words), flow in zip(found, flows, strict=True):
        passes, rest = divmod(sum(flow.values()), words) if words else (0, 0)
        ours = [number[s] for s in pattern]
        routes = [{"source": None if s[0] else s[1], "words": flow.get(number[s], 0)} for s in pattern]
        rows.append(([{"none": n, "name": s} for n, s in pattern], sum(sizes[i] for i in ours), float(sum(targets[i] for i in ours)), passes, rest, routes))
    plan = spark.createDataFrame(rows, f"pattern array<{SOURCE}>, source_size long, target double, passes long, rest long, routes array<struct<source:string,words:long>>")
    plan = plan.drop("source_size", "target") if narrow else plan
    few = len(rows) <= max_patterns  # more only if there are more sources than that
    plan = F.broadcast(plan) if few else plan

    cut = _cut(sized, plan, few)  # a row for each pattern
    cut = F.broadcast(cut) if few else cut
    placed = sized.withColumn("bucket", F.shiftrightunsigned("order", 64 - LEVEL_BITS * LEVELS)).join(plan, "pattern", "left").join(cut, "pattern", "left")
    inside = F.col("bucket") == F.col("cut")
    whole = placed.filter(~F.coalesce(inside, F.lit(False)))
    whole = whole.withColumn("extra", F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(F.lit(0)))
    edge = _behind(placed.filter(inside))
    edge = edge.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("done")))).drop("done")
    taken = F.col("passes") * F.col("size") + F.col("extra")
    pattern = F.col("whole" if narrow else "pattern").alias("pattern")
    return whole.unionByName(edge).select("doc_id", pattern, "size", "source_size", "target", taken.alias("taken"), "routes", *(["carried.*"] if carry else []))


def apply_mix(docs: DataFrame, mixed: DataFrame, *, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix as documents: each as often as it is taken whole, and once more cut after
    the last word that is taken in part, with its white space as it is.  ``key`` names
    a column of both tables that tells their rows apart."""
    take = mixed.filter("taken > 0").select(F.col(key).alias("__key"), F.expr("taken div size").alias("__whole"), F.expr("taken % size").alias("__part"))
    joined = docs.join(take, docs[key].eqNullSafe(take["__key"]))
    parts = F.concat(F.array_repeat(F.lit(0).cast("long"), F.col("__whole").cast("int")), F.when(F.col("__part") > 0, F.array("__part")).otherwise(F.array().cast("array<bigint>")))
    copies = joined.withColumn("__words", F.explode(parts))
    spaced = F.regexp_extract_all(F.col(text_col), F.lit(rf"([\x20\x09-\x0D]*{WORD})"), 1)  # words with the white space before them
    text = F.when(F.col("__words") > 0, F.array_join(F.slice(spaced, 1, F.col("__words").cast("int")), "")).otherwise(F.col(text_col))
    return copies.withColumn(text_col, text).select(*docs.columns)
