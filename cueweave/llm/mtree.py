"""Exact top-k by inner product with an M-tree over all vectors.

Inner-product order is nearest-neighbour order in a metric space: each candidate
gets one more component, sqrt(M^2 - |x|^2) with M the largest norm of all, and queries
get 0 there.

The tree's top level are at most ``ROUTES`` routing vectors; every vector belongs to the
nearest.  What belongs to one is cut into shards by its distance from the routing
vector, so a shard is a ring with a least and a largest distance; rows at one distance
are dealt over as many shards as they fill, so copies do not meet in one.  A task loads
each shard once as a subtree of paged nodes: an entry of an inner page is a routing
vector with its covering radius and its distance to the parent's routing vector, an
entry of a leaf is a vector with that distance.

Queries travel in blocks of one routing vector.  A block first meets the shards of its
own; then, with the k-th score of every query known, only shards whose ring can hold a
better vector for one of the block's queries.  Inside a shard the search is best first:
the page with the smallest lower bound on the distance is next, entries whose stored
parent distance already rules them out by the triangle inequality are skipped before
any distance is computed, and it ends when no page can hold a better one.  The queries
of a block advance together: in each round every query takes the next page of its own
queue, and the queries that take the same page share one matrix product.

Scores are exact integers; distances only prune, with half a unit of slack, and
equal scores are never pruned, so ties go to the smaller identifier.

Defined results: vectors that are null, empty, or hold null or non-finite components take
no part; queries only meet candidates of their own length.  Rows that repeat an
identifier are candidates of their own, but no query meets a row with its own
identifier; a query identifier that repeats is asked once, with its shortest and then
least vector.  Null identifiers take no part.  Empty input gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueweave.functions.storage import materialise

SCALE = 64
ROUTES = 256
RINGS = 256
SHARD_ROWS = 8192
BLOCK_ROWS = 1024
PAGE = 512
FANOUT = 24
NO_ID = np.iinfo(np.int64).max


class Node:
    """A page: routing vectors with radii and children, or vectors with their rows."""

    __slots__ = ("children", "points", "radii", "rows", "squares", "to_parent")

    def __init__(self, points, to_parent, rows=None, radii=None, children=None):
        self.points, self.to_parent, self.rows, self.children = points, to_parent, rows, children
        self.radii = radii if children is not None else np.zeros(len(points))
        self.squares = (points**2).sum(axis=1)


def distance(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - point) ** 2).sum(axis=1))


def reach_of(squares: np.ndarray, top: float, worst: np.ndarray) -> np.ndarray:
    """No vector further from a query than this can have a score as high as ``worst``."""
    return np.sqrt(np.maximum(0.0, squares + top - 2 * (worst - 0.5)))


class Best:
    """The k best candidates of each query of a block: highest score first, ties to the smaller identifier."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), NO_ID)

    def add(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Merge candidates of the queries ``who``; returns the queries concerned."""
        rows = np.unique(who)
        who = np.concatenate([np.repeat(rows, self.k), who])
        scores = np.concatenate([self.scores[rows].ravel(), scores])
        ids = np.concatenate([self.ids[rows].ravel(), ids])
        order = np.lexsort((ids, -scores, who))
        own = np.searchsorted(who[order], rows)
        first = order[(own[:, None] + np.arange(self.k)).ravel()]
        self.scores[rows] = scores[first].reshape(len(rows), self.k)
        self.ids[rows] = ids[first].reshape(len(rows), self.k)
        return rows


class MTree:
    """An M-tree over integer vectors for maximum inner products."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float, page: int = PAGE, fanout: int = FANOUT):
        """``top`` is the largest squared norm of all vectors, in this tree or not."""
        self.ids, self.vectors, self.top, self.width = ids, vectors, top, vectors.shape[1]
        squares = (vectors**2).sum(axis=1)
        self.points = np.hstack([vectors, np.sqrt(self.top - squares)[:, None]])
        self.page, self.fanout = page, fanout
        self.rng = np.random.default_rng(5)
        self.computed = 0
        self.nodes: list[Node] = []
        self.root = self._load(np.arange(len(ids)), None)

    def _load(self, rows: np.ndarray, parent: np.ndarray | None) -> int:
        """The number of a node over ``rows``; inner pages have no more entries than fill their leaves."""
        points = self.points[rows]
        if len(rows) <= self.page:
            to_parent = distance(points, parent) if parent is not None else np.zeros(len(rows))
            return self._keep(Node(points, to_parent, rows=rows))
        fanout = min(self.fanout, -(-len(rows) // self.page))
        routes = np.unique(points[self.rng.choice(len(rows), fanout, replace=False)], axis=0)
        near = ((routes**2).sum(axis=1) - 2 * points @ routes.T).argmin(axis=1)
        if np.bincount(near).max() == len(rows):  # alike vectors: pages in order
            near = np.arange(len(rows)) * fanout // len(rows)
            routes = points[[np.flatnonzero(near == i)[0] for i in range(fanout)]]
        used = [i for i in range(len(routes)) if (near == i).any()]
        groups, routes = [rows[near == i] for i in used], routes[used]
        radii = np.array([distance(self.points[g], r).max() for g, r in zip(groups, routes, strict=True)])
        children = [self._load(g, r) for g, r in zip(groups, routes, strict=True)]
        to_parent = distance(routes, parent) if parent is not None else np.zeros(len(routes))
        return self._keep(Node(routes, to_parent, radii=radii, children=children))

    def narrow(self) -> MTree:
        """Without what can be made again, for sending."""
        self.vectors = _packed(self.vectors.astype(np.int64))
        self.points = None
        for node in self.nodes:
            if node.children is None:
                node.points = node.squares = None
        return self

    def widened(self) -> MTree:
        self.vectors = np.frombuffer(self.vectors, f"<i{len(self.vectors) // (len(self.ids) * self.width)}").reshape(-1, self.width).astype(np.float64)
        return self

    def _keep(self, node: Node) -> int:
        self.nodes.append(node)
        return len(self.nodes) - 1

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> Best:
        """The k best of every query; a row with the query's own identifier is no candidate.
        Scores below a query's ``floor`` need not be found."""
        best = Best(len(queries), k)
        squares = (queries**2).sum(axis=1)
        slack = 1e-6 * (1.0 + np.sqrt(squares + self.top))
        reach = reach_of(squares, self.top, np.full(len(queries), -np.inf) if floor is None else floor)
        queues: list[list[tuple[float, int, float]]] = [[(0.0, self.root, 0.0)] for _ in queries]
        active = range(len(queries))
        while active:
            visits: dict[int, list[tuple[int, float]]] = {}
            limits, still = reach.tolist(), []
            for i in active:
                if queues[i] and queues[i][0][0] <= limits[i]:
                    _, number, away = heapq.heappop(queues[i])
                    visits.setdefault(number, []).append((i, away))
                    still.append(i)
            active = still
            for number, visitors in visits.items():
                node = self.nodes[number]
                who = np.array([i for i, _ in visitors], np.int64)
                away = np.array([d for _, d in visitors])
                use = np.abs(away[:, None] - node.to_parent) - node.radii <= (reach + slack)[who][:, None]
                entries = np.flatnonzero(use.any(axis=0))
                if not len(entries):
                    continue
                use = use[:, entries]
                self.computed += int(use.sum())
                if node.children is None:
                    rows = node.rows[entries]
                    scores = queries[who] @ self.vectors[rows].T
                    scores[~use | (query_ids[who][:, None] == self.ids[rows])] = -np.inf
                    floor = best.scores[who, -1]
                    if len(rows) > k and np.isinf(floor).any():
                        floor = np.maximum(floor, np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k])
                    at, entry = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
                    if len(at):
                        new = best.add(who[at], scores[at, entry], self.ids[rows[entry]])
                        worst = best.scores[new, -1]
                        reach[new] = np.minimum(reach[new], reach_of(squares[new], self.top, worst))
                else:
                    far = squares[who][:, None] + node.squares[entries] - 2 * queries[who] @ node.points[entries, :-1].T
                    far = np.sqrt(np.maximum(0.0, far))
                    low = np.maximum(0.0, far - node.radii[entries] - slack[who][:, None])
                    at, entry = np.nonzero(use & (low <= reach[who][:, None]))
                    for i, bound, j, d in zip(who[at].tolist(), low[at, entry].tolist(), entries[entry].tolist(), far[at, entry].tolist(), strict=True):
                        heapq.heappush(queues[i], (bound, node.children[j], d))
        return best


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x, width) with components floor(64 * x); invalid vectors left out."""
    x = F.transform(F.col(vector_col), lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))
    finite = F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    valid = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & finite
    return vectors.filter(valid).select(F.col(id_col).cast("long").alias("id"), x.alias("x"), F.size(vector_col).alias("width"))


def _packed(x: np.ndarray) -> bytes:
    """Vectors in the narrowest integers that hold them."""
    kind = next(t for t in ("<i2", "<i4", "<i8") if x.min() >= np.iinfo(t).min and x.max() <= np.iinfo(t).max)
    return x.astype(kind).tobytes()


def _squares(points: np.ndarray) -> np.ndarray:
    """Squared distances of all routing vectors from one another."""
    own = (points**2).sum(axis=1)
    return own[:, None] + own - 2 * points @ points.T


class Routes:
    """The top level of the tree for vectors of one length."""

    def __init__(self, vectors: np.ndarray, top: float):
        self.top = top
        last = np.sqrt(np.maximum(0.0, top - (vectors**2).sum(axis=1)))
        self.points = np.hstack([vectors, last[:, None]])

    def distances(self, vectors: np.ndarray, *, queries: bool) -> np.ndarray:
        squares = (vectors**2).sum(axis=1)
        last = np.zeros(len(vectors)) if queries else np.sqrt(np.maximum(0.0, self.top - squares))
        cross = vectors @ self.points[:, :-1].T + last[:, None] * self.points[:, -1]
        return np.sqrt(np.maximum(0.0, (squares + last**2)[:, None] + (self.points**2).sum(axis=1) - 2 * cross))


def _routes(data: DataFrame, shard_rows: int) -> dict[int, Routes]:
    """Routing vectors for each length, chosen by a hash of the identifier; at most ROUTES."""
    norm = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    found = {r["width"]: r for r in data.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top")).collect()}
    out = {}
    for width, r in found.items():
        few = data.filter(F.col("width") == width).orderBy(F.xxhash64(F.lit("route"), "id", "x")).limit(min(ROUTES, math.ceil(r["n"] / shard_rows)))
        out[width] = Routes(np.array([list(v["x"]) for v in few.select("x").collect()], np.float64), r["top"])
    return out


def _belonging(rows: DataFrame, routes: dict[int, Routes], *, queries: bool) -> DataFrame:
    """Adds the routing vector (cell) that each row belongs to and its distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(2).to_numpy()
            cell, away = np.zeros(len(widths), np.int32), np.zeros(len(widths))
            for width in np.unique(widths):
                own = np.flatnonzero(widths == width)
                x = batch.column(1).take(pa.array(own)).flatten().to_numpy().reshape(len(own), width).astype(np.float64)
                found = routes[int(width)].distances(x, queries=queries)
                cell[own] = found.argmin(axis=1)
                away[own] = found.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cell), pa.array(away)], ["id", "x", "width", "cell", "away"])

    return rows.select("id", "x", "width").mapInArrow(run, "id long, x array<bigint>, width int, cell int, away double")


def _shards(data: DataFrame, routes: dict[int, Routes], shard_rows: int, page: int) -> DataFrame:
    """(width, cell, ring, part, low, high, tree): every shard as a subtree."""
    grid = [i / RINGS for i in range(1, RINGS)]
    cells = data.groupBy("width", "cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("away", grid, 2000).alias("grid"))
    shards = F.ceil(F.col("n") / shard_rows).cast("int")
    rings = F.least(shards, F.lit(RINGS))
    step = F.when(rings > 1, F.transform(F.sequence(F.lit(1), rings - 1), lambda i: F.get("grid", (i * RINGS / rings).cast("int") - 1)))
    cells = cells.select("width", "cell", F.coalesce(step, F.array().cast("array<double>")).alias("cuts"), F.ceil(shards / RINGS).cast("int").alias("parts"))
    spread = F.xxhash64("id", "x")
    low, high = F.size(F.filter("cuts", lambda c: c < F.col("away"))), F.size(F.filter("cuts", lambda c: c <= F.col("away")))
    dealt = data.join(F.broadcast(cells), ["width", "cell"])  # at most ROUTES cells of each length
    dealt = dealt.withColumn("ring", (low + F.pmod(spread, high - low + 1)).cast("int")).withColumn("part", F.pmod(F.shiftright(spread, 8), F.col("parts")).cast("int"))

    def load(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        width = int(group["width"].iloc[0])
        tree = MTree(group["id"].to_numpy("<i8"), np.stack(group["x"].to_numpy()).astype(np.float64), routes[width].top, page)
        return pd.DataFrame({"width": [width], **{c: [int(group[c].iloc[0])] for c in ("cell", "ring", "part")}, "low": [group["away"].min()], "high": [group["away"].max()], "tree": [pickle.dumps(tree.narrow())]})

    return dealt.select("width", "cell", "ring", "part", "id", "x", "away").groupBy("width", "cell", "ring", "part").applyInPandas(load, "width int, cell int, ring int, part int, low double, high double, tree binary")


def _blocks(asked: DataFrame, block_rows: int) -> DataFrame:
    """(width, cell, block, reach, rho, ids, data, floors): queries of one cell in blocks."""
    counts = asked.groupBy("width", "cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    dealt = asked.join(F.broadcast(counts), ["width", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        x = np.stack(group["x"].to_numpy())
        reach = reach_of((x.astype(np.float64) ** 2).sum(axis=1), group["top"].to_numpy(), group["floor"].to_numpy()).max()
        return pd.DataFrame({**{c: [int(group[c].iloc[0])] for c in ("width", "cell", "block")}, "reach": [reach], "rho": [group["away"].max()], "ids": [group["id"].to_numpy("<i8").tobytes()], "data": [_packed(x)], "floors": [group["floor"].to_numpy("<f8").tobytes()]})

    return dealt.groupBy("width", "cell", "block").applyInPandas(pack, "width int, cell int, block int, reach double, rho double, ids binary, data binary, floors binary")


def _meet(shards: DataFrame, meetings: DataFrame, blocks: DataFrame, routes: dict[int, Routes], k: int) -> DataFrame:
    """(query_id, vec_id, score) of the blocks' queries in the shards that they meet.

    ``meetings`` has (width, cell, ring, part, to_cell, block).  A shard's subtree goes
    ahead of the blocks that it meets and is loaded once for all of them.
    """
    key = ["width", "cell", "ring", "part"]
    visits = meetings.join(blocks.withColumnRenamed("cell", "to_cell"), ["width", "to_cell", "block"])
    visits = visits.select(*key, F.lit(1).alias("side"), "ids", "data", "floors")
    trees = shards.join(meetings.select(*key).distinct(), key, "left_semi").select(*key, F.lit(0).alias("side"), "low", "high", "tree")
    names = [*key, "side", "low", "high", "tree", "ids", "data", "floors"]
    dealt = trees.unionByName(visits, allowMissingColumns=True).select(*names).repartition(*key).sortWithinPartitions(*key, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shard = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in names}
                if row["side"] == 0:
                    tree, shard = pickle.loads(row["tree"]).widened(), row
                    continue
                ids, floors = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["floors"], "<f8")
                points = np.frombuffer(row["data"], f"<i{len(row['data']) // (len(ids) * row['width'])}").reshape(len(ids), -1).astype(np.float64)
                squares = (points**2).sum(axis=1)
                away = routes[row["width"]].distances(points, queries=True)[:, row["cell"]]
                slack = 1e-6 * (1.0 + np.sqrt(squares + tree.top))
                need = np.maximum(away - shard["high"], shard["low"] - away) - slack <= reach_of(squares, tree.top, floors)
                if need.any():
                    ids, points = ids[need], points[need]
                    best = tree.search(ids, points, k, floors[need])
                    who, place = np.nonzero(best.scores > -np.inf)
                    columns = [ids[who], best.ids[who, place], best.scores[who, place].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, "query_id long, vec_id long, score long")


def _best_of(found: DataFrame, k: int) -> DataFrame:
    """(query_id, best): a shard gives each query k rows at most, so its rows number k times the shards it met."""
    return found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id"))), 1, k).alias("best"))


def top_inner_products(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, page: int = PAGE) -> DataFrame:
    """The k highest inner products of each query among all other vectors.

    Returns (query_id, rank, vec_id, score); rank counts from 1.
    """
    spark = vectors.sparkSession
    data = materialise(quantised(vectors, id_col, vector_col), "vectors")
    routes = _routes(data, shard_rows)
    tops = F.create_map(*[F.lit(x) for w, r in routes.items() for x in (w, float(r.top))]) if routes else F.create_map().cast("map<int,double>")
    asked = quantised(queries, id_col, vector_col).groupBy("id").agg(F.min(F.struct("width", "x")).alias("q")).select("id", "q.x", "q.width")
    asked = _belonging(asked.filter(F.col("width").isin(list(routes))), routes, queries=True)
    asked = materialise(asked.withColumn("top", tops[F.col("width")]), "queries")
    shards = materialise(_shards(_belonging(data, routes, queries=False), routes, shard_rows, page), "shards")
    rings = shards.drop("tree")

    near = materialise(_blocks(asked.withColumn("floor", F.lit(float("-inf"))), block_rows), "query-blocks")
    own = rings.join(near.select("width", F.col("cell").alias("to_cell"), "block"), "width").filter("cell = to_cell")
    first = materialise(_best_of(_meet(shards, own, near, routes, k), k), "first-best")

    floor = F.when(F.size("best") == k, -F.col("best")[k - 1]["low"].cast("double")).otherwise(F.lit(float("-inf")))
    known = asked.join(first.select(F.col("query_id").alias("id"), floor.alias("floor")), "id", "left").fillna(float("-inf"), ["floor"])
    far = materialise(_blocks(known, block_rows), "query-blocks")
    between = [(w, i, j, float(d)) for w, r in routes.items() for i, row in enumerate(np.sqrt(np.maximum(0, _squares(r.points)))) for j, d in enumerate(row)]
    between = F.broadcast(spark.createDataFrame(between, "width int, cell int, to_cell int, apart double"))  # at most ROUTES ** 2 of each length
    # Bounds from the distance of two routing vectors, for all queries of a block at once.
    pairs = rings.join(between, ["width", "cell"]).join(far.select("width", F.col("cell").alias("to_cell"), "block", "reach", "rho"), ["width", "to_cell"]).filter("cell <> to_cell")
    slack = F.lit(1e-6) * (1 + F.col("apart") + F.col("rho"))
    pairs = pairs.filter(F.greatest(F.col("apart") - F.col("rho") - F.col("high"), F.col("low") - F.col("apart") - F.col("rho")) - slack <= F.col("reach"))
    more = _meet(shards, pairs.select("width", "cell", "ring", "part", "to_cell", "block"), far, routes, k)

    merged = _best_of(more.unionByName(first.select("query_id", F.explode("best").alias("b")).select("query_id", "b.vec_id", (-F.col("b.low")).alias("score"))), k)
    best = merged.select("query_id", F.posexplode("best").alias("rank", "best"))
    return best.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "best.vec_id", (-F.col("best.low")).alias("score"))
