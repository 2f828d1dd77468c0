"""Exact top-k by inner product: best-first search in M-trees.

Inner products become distances. With M the largest norm, a vector x gets one more
coordinate, sqrt(M^2 - |x|^2), and a query q gets 0 there; then |q - x|^2 = |q|^2 +
M^2 - 2 q.x, so the nearest vectors have the highest products, in a metric space.

The top of the tree is a layer of pivots, drawn from a bounded sample. Equal vectors
count once, with the k + 1 smallest ids that any answer could need, so a vector that
occurs thousands of times is one entry. Every vector goes to its nearest pivot, and
the vectors of a pivot are dealt by a hash to as many shards as keep each within
`SHARD` entries. Each shard is an M-tree of pages, built and written once: an entry has
its routing object, its covering radius and its distance to the parent's object. A
page is searched in order of the least distance anything in it can have; the stored
distance to the parent rules entries out by the triangle inequality before their
own distance is computed.

Queries go in blocks: those of a block that have to search a shard search its tree
together, a page being read once for all of them, each with its own bound. They first
search one shard of their nearest pivot; what they find bounds the rest, and they go
on only to pivots whose ball can hold a product as high. Scores are sums of integers
and exact; bounds have a margin for rounding.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, giving_back

#: Pivots (one for each shard's worth of vectors, within these limits), sampled vectors
#: for each, entries of a shard and of a page, branches of a page, queries of a block.
PIVOTS, SAMPLE, SHARD, PAGE, FAN, TOGETHER = (64, 1024), 64, 4096, 64, 12, 1024
#: Margin of a bound against rounding, relative to the distances.
MARGIN = 1e-7
FOUND = "query_id long, vec_id long, score long"


def scaled(column: str = "embedding", by: float = 1024.0):
    return F.transform(F.col(column), lambda x: F.floor(x.cast("double") * by).cast("long"))


def usable(column: str = "embedding"):
    """Not null and without null, NaN or infinite components."""
    fine = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.col(column).isNotNull() & fine


class Page:
    """Entries of a node: objects, the distance of each to the parent's object, and
    for inner nodes the covering radius and the page below."""

    __slots__ = ("at", "to_parent", "radius", "below")

    def __init__(self, at, to_parent, radius=None, below=None):
        self.at, self.to_parent, self.radius, self.below = at, to_parent, radius, below


class MTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float):
        """vectors: integers as floats; top: the square of the largest norm of all."""
        self.ids, self.flat, self.top = ids, vectors, top
        x = _lifted(vectors, top)
        self.root = self._load(x, np.arange(len(ids)), None)

    def _load(self, x: np.ndarray, rows: np.ndarray, parent: int | None) -> Page:
        """Bulk load: far-apart objects route, each row goes to the nearest."""
        apart = lambda rows, one: np.sqrt(((x[rows] - x[one]) ** 2).sum(axis=1))
        if len(rows) <= PAGE:
            return Page(rows, apart(rows, parent) if parent is not None else np.zeros(len(rows)))
        chosen = [int(rows[0])]
        near = apart(rows, chosen[0])
        whose = np.zeros(len(rows), np.int64)
        for _ in range(1, FAN):
            far = int(np.argmax(near))
            if near[far] <= 0:
                break
            chosen.append(int(rows[far]))
            d = apart(rows, chosen[-1])
            closer = d < near
            near[closer], whose[closer] = d[closer], len(chosen) - 1
        parts = [(c, rows[whose == i]) for i, c in enumerate(chosen)]
        if len(chosen) == 1:  # copies of one vector: pages of equal objects
            parts = [(chosen[0], rows[i : i + PAGE]) for i in range(0, len(rows), PAGE)]
        at = np.array([c for c, _ in parts])
        radius = np.array([apart(r, c).max() for c, r in parts])
        return Page(at, apart(at, parent) if parent is not None else np.zeros(len(at)), radius, [self._load(x, r, c) for c, r in parts])

    def search(self, owns: np.ndarray, queries: np.ndarray, k: int, least: list) -> Iterator[tuple[int, int, int]]:
        """(query's place, id, score) of the k best of each query but its own, if its
        `least` (None: anything) or better. Also counts scores and distances computed."""
        square = np.einsum("ij,ij->i", queries, queries)
        best: list[list[tuple]] = [[] for _ in owns]  # heaps: the worst first; ids negated
        least = [-np.inf if x is None else x for x in least]
        reach = np.array([_reach(s, self.top, x) for s, x in zip(square, least, strict=True)])
        self.scored = self.measured = 0
        queue: list[tuple] = [(0.0, 0, self.root, np.arange(len(owns)), np.zeros(len(owns)), None)]
        count = 1
        while queue:
            _, _, page, live, bound, to_parent = heapq.heappop(queue)
            fine = bound <= reach[live]
            live = live[fine]
            if not len(live):
                continue
            at, size = page.at, page.radius if page.radius is not None else np.zeros(len(page.at))
            open_ = np.ones((len(live), len(at)), bool)
            if to_parent is not None:
                open_ = np.abs(to_parent[fine][:, None] - page.to_parent) - size <= reach[live][:, None]
            entries = np.flatnonzero(open_.any(axis=0))
            if not len(entries):
                continue
            if page.below is None:
                scores = _products(queries[live], self.flat[at[entries]], self.top)
                self.scored += int(open_.sum())
                floor = np.array([least[q] for q in live], scores.dtype if scores.dtype == object else float)
                for i in np.flatnonzero((open_[:, entries] & (scores >= floor[:, None])).any(axis=1)).tolist():
                    q = int(live[i])
                    for j in np.flatnonzero(open_[i, entries] & (scores[i] >= least[q])).tolist():
                        found = (int(scores[i, j]), -int(self.ids[at[entries[j]]]))
                        if -found[1] == owns[q]:
                            continue
                        if len(best[q]) < k:
                            heapq.heappush(best[q], found)
                        elif found > best[q][0]:
                            heapq.heapreplace(best[q], found)
                    if len(best[q]) == k and best[q][0][0] > least[q]:
                        least[q] = best[q][0][0]
                        reach[q] = _reach(square[q], self.top, least[q])
                continue
            self.measured += int(open_.sum())
            apart = np.sqrt(np.maximum(square[live][:, None] + self.top - 2 * (queries[live] @ self.flat[at[entries]].T), 0))
            for j, e in enumerate(entries.tolist()):
                near = np.maximum(apart[:, j] - size[e], 0)
                goes = open_[:, e] & (near <= reach[live])
                if goes.any():
                    heapq.heappush(queue, (float(near[goes].min()), count, page.below[e], live[goes], near[goes], apart[goes, j]))
                    count += 1
        for q, found in enumerate(best):
            yield from ((q, -i, score) for score, i in found)


def _lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that gives all the same norm."""
    return np.column_stack([vectors, np.sqrt(np.maximum(top - np.einsum("ij,ij->i", vectors, vectors), 0))])


def _reach(square: float, top: float, least: float) -> float:
    """The distance at which a product of `least` lies."""
    if least == -np.inf:
        return np.inf
    return float(np.sqrt(max(square + top - 2 * float(least), 0)) + MARGIN * (1 + np.sqrt(square + top)))


def _products(a: np.ndarray, b: np.ndarray, top: float) -> np.ndarray:
    """All inner products, exact: as floats while these hold every integer that may
    occur, else as Python's integers."""
    if top < 2**52:
        return a @ b.T
    whole = np.vectorize(int, otypes=[object])
    return whole(a) @ whole(b).T


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists as rows of a matrix; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def pivots_of(sample: np.ndarray, n: int, top: float) -> np.ndarray:
    """Up to n far-apart rows of the sample."""
    if not len(sample):
        return sample
    x = _lifted(sample, top)
    chosen, near = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(x)):
        far = int(np.argmax(near))
        if near[far] <= 0:
            break
        chosen.append(far)
        near = np.minimum(near, ((x - x[far]) ** 2).sum(axis=1))
    return sample[chosen]


def _nearest(pivots: np.ndarray, width: int, top: float):
    lifted = _lifted(pivots, top) if len(pivots) else np.zeros((0, width + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                x = _lifted(_vectors(batch.column("vec"), width), top)
                apart = 2 * top - 2 * (x @ lifted.T)  # all have the norm `top`
                which = apart.argmin(axis=1)
                near = np.sqrt(((x - lifted[which]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(which, pa.int32()), pa.array(near)], [*batch.schema.names, "pivot", "apart"])

    return run


def _growing(width: int, top: float):
    """Rows sorted by shard to one tree for each."""

    def grown(key: tuple, ids: list, vectors: list) -> pa.RecordBatch:
        tree = MTree(np.array(ids, np.int64), np.concatenate(vectors), top)
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([pickle.dumps(tree)], pa.binary())], ["pivot", "salt", "tree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors = None, [], []
        for batch in batches:
            x = np.repeat(_vectors(batch.column("vec"), width), batch.column("copies").to_numpy(), axis=0)
            names = np.repeat(batch.column("vec_id").to_numpy(), batch.column("copies").to_numpy())
            keys = np.repeat(np.column_stack([batch.column("pivot").to_numpy(), batch.column("salt").to_numpy()]), batch.column("copies").to_numpy(), axis=0)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if key is not None and key != tuple(keys[a]):
                    yield grown(key, ids, vectors)
                    ids, vectors = [], []
                key = tuple(keys[a].tolist())
                ids += names[a:b].tolist()
                vectors.append(x[a:b])
        if ids:
            yield grown(key, ids, vectors)

    return run


ASKED = "pivot int, query_ids array<long>, least array<long>, vecs binary"


def _routing(pivots: np.ndarray, radius: np.ndarray, width: int, top: float, first: bool):
    """Queries (vec_id, vec, least) to blocks for the pivots they have to search: the
    nearest one first; then all whose ball can hold `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows if len(pivots) else 0, TOGETHER):
                batch = whole.slice(begin, TOGETHER)
                v, ids, least = _vectors(batch.column("vec"), width), batch.column("vec_id").to_pylist(), batch.column("least").to_pylist()
                square = np.einsum("ij,ij->i", v, v)
                bound = np.maximum(np.sqrt(np.maximum(square[:, None] + top - 2 * (v @ pivots.T), 0)) - radius, 0)
                bound[:, radius < 0] = np.inf  # a pivot without vectors
                if first:
                    goes = np.zeros(bound.shape, bool)
                    goes[np.arange(len(v)), bound.argmin(axis=1)] = True
                else:
                    reach = np.array([_reach(s, top, -np.inf if x is None else x) for s, x in zip(square, least, strict=True)])
                    goes = (bound <= reach[:, None]) & (radius >= 0)
                for p in np.flatnonzero(goes.any(axis=0)).tolist():
                    at = np.flatnonzero(goes[:, p]).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([[ids[i] for i in at]], pa.list_(pa.int64())), pa.array([[least[i] for i in at]], pa.list_(pa.int64())), pa.array([v[at].tobytes()], pa.binary())], ["pivot", "query_ids", "least", "vecs"])

    return run


def _searching(width: int, k: int):
    """Rows sorted by shard, its tree before the blocks of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, shard = None, None
        for batch in batches:
            for pivot, salt, ids, least, vecs, own in zip(*(batch.column(c).to_pylist() for c in ("pivot", "salt", "query_ids", "least", "vecs", "tree")), strict=True):
                if own is not None:
                    tree, shard = pickle.loads(own), (pivot, salt)
                    continue
                if (pivot, salt) != shard:
                    continue
                found = list(tree.search(np.array(ids), np.frombuffer(vecs).reshape(len(ids), width), k, least))
                rows = [(ids[q], i, max(-(2**63), min(s, 2**63 - 1))) for q, i, s in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score: of each query (vec_id divisible by `every`) the
    k rows with the highest integer products, but those of its own id; ties to the
    smaller vec_id.

    Components become floor(scale * x). Rows whose vector is null or holds a null or
    non-finite component, or whose id is null, take no part; shorter vectors count as
    if zeros followed. Of rows that share a query's id the first gives the query;
    repeated rows are candidates each. With fewer candidates than k all come; an empty table gives no rows.
    Components beyond a long, and scores, are taken as the nearest long.
    """
    scratch = Scratch(vectors.sparkSession, "mtree")
    rows = vectors.where(F.col("vec_id").isNotNull() & usable()).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(by=scale).alias("vec"))
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    # of equal vectors the k + 1 smallest ids, each at most k times, hold all that any query needs
    kinds = rows.groupBy("vec", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("copies"))
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    kinds = scratch.table(kinds.withColumn("place", place).where(F.col("place") <= k + 1).drop("place"), "kinds")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    width, top, n = kinds.agg(F.max(F.size("vec")), F.max(square), F.count(F.lit(1))).first()
    width, top = max(width or 0, 1), float(top or 0)
    many = max(PIVOTS[0], min(PIVOTS[1], n // SHARD))
    drawn = kinds.orderBy(F.xxhash64("vec_id"), "vec_id").select("vec").limit(SAMPLE * many).toArrow()
    pivots = pivots_of(_vectors(drawn.column("vec"), width) if len(drawn) else np.zeros((0, width)), many, top)
    homes = scratch.table(kinds.mapInArrow(_nearest(pivots, width, top), "vec array<long>, vec_id long, copies long, pivot int, apart double"), "homes")
    stats = homes.groupBy("pivot").agg(F.sum("copies").alias("n"), F.max("apart").alias("radius"))
    radius, salts = np.full(len(pivots), -1.0), np.ones(max(len(pivots), 1), np.int64)
    for r in stats.collect():  # a row for each pivot
        radius[r["pivot"]], salts[r["pivot"]] = r["radius"] + MARGIN * (1 + np.sqrt(2 * top)), -(-r["n"] // SHARD)
    shares = F.element_at(F.array(*[F.lit(int(s)) for s in salts]), F.col("pivot") + 1)
    shards = int(salts.sum())
    stored = homes.withColumn("salt", F.pmod(F.xxhash64("vec_id"), shares).cast("int"))
    stored = stored.repartition(shards, "pivot", "salt").sortWithinPartitions("pivot", "salt", "vec_id")
    trees = scratch.table(stored.mapInArrow(giving_back(_growing(width, top)), "pivot int, salt int, tree binary"), "trees")

    def searched(asked: DataFrame, name: str) -> DataFrame:
        both = trees.unionByName(asked.select("pivot", "salt", "query_ids", "least", "vecs"), allowMissingColumns=True)
        both = both.repartition(shards, "pivot", "salt").sortWithinPartitions("pivot", "salt", F.col("tree").isNull())
        return scratch.table(both.mapInArrow(giving_back(_searching(width, k)), FOUND), name)

    one = F.pmod(F.xxhash64("pivot"), shares).cast("int")  # the shard of a pivot that is searched first
    route = lambda rows, first: rows.mapInArrow(_routing(pivots, radius, width, top, first), ASKED)
    first = scratch.table(route(queries.withColumn("least", F.lit(None).cast("long")), True).withColumn("salt", one), "first")
    near = searched(first, "near")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    bound = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    again = route(queries.join(bound, "vec_id", "left").select("vec_id", "vec", "least"), False)
    again = again.withColumn("salt", F.explode(F.sequence(F.lit(0), (shares - 1).cast("int"))))
    found = searched(again, "rest")  # the first shards too: their rows come again, with the bound
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
