"""Exact top-k search by integer inner product with KD-trees per shard.

Vectors are dealt to shards by the top splits of one KD-tree, medians of a bounded sample (SAMPLE rows) on its widest sides; a cell of that tree
that holds more rows than a shard is dealt on by a hash of the id, so copies of one vector share no shard beyond its size. All rows of a cell
give it a tight bounding box. Each query is first searched in its own shard; the k-th score found there is its bound: it only goes to shards of cells
whose box can hold such a score, in blocks of queries from neighbouring shards, a task for each block and shard, and vectors
only go to blocks that ask for their shard. The sample decides where rows lie, never what is found.

A shard is a few trees: median splits on the widest side down to small leaves, every node with its tight bounding box. The largest
score inside a box is q+ . high + q- . low, with the positive and negative parts of the query. A query first goes
down to its most promising leaf, then nodes whose bound is below its k-th score so far are pruned level by level,
and the remaining leaves are visited best first. The k-th score is carried from tree to tree and from the own shard to all others. Equal vectors of a
tree are one point with its k + 1 smallest distinct ids, at most k rows of each: a query leaves out all rows of its own
id, and k others remain. The best k of every task meet in a window over the query.

Nulls: vectors that are null or hold a null or non-finite component take no part, nor do rows with a null id.
Vectors only meet vectors of their length. Rows that share a query's id are its own rows, and a query id is one
query: that of its smallest vector, arrays compared component by component. Shards and blocks of queries are bounded in rows and in bytes. Ties go to the smaller id; an empty table gives an empty result. Scores are exact below 2**53.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.store import written

TREE_ROWS, LEAF, QUERY_BLOCK, LEAST_SHARD, MOST_SHARD = 8192, 256, 16384, 4096, 65536
SAMPLE, MOST_DEPTH, MOST_BYTES = 8192, 10, 64 << 20
NO_ID = (1 << 63) - 1


class KdTree:
    """A balanced tree over distinct points, each with the rows of its keep smallest ids; levels[d] holds the boxes (low, high) of the nodes of depth d."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, keep: int):
        rows = np.ascontiguousarray(points).view(np.dtype((np.void, max(1, points.shape[1] * points.itemsize)))).ravel() if points.shape[1] else np.zeros(len(points), np.int8)
        _, first, group = np.unique(rows, return_index=True, return_inverse=True)
        by_id = np.lexsort((ids, group))
        groups, own = group[by_id], ids[by_id]
        new = np.ones(len(own), bool)
        new[1:] = (groups[1:] != groups[:-1]) | (own[1:] != own[:-1])
        place = np.cumsum(new)
        copy = np.arange(len(own)) - np.flatnonzero(new)[place - 1]
        place = place - place[np.searchsorted(groups, groups)]
        by_id = by_id[(place < keep) & (copy < keep - 1)]
        self.points = points[first]
        members, owner = ids[by_id], group[by_id]

        self.depth = max(0, math.ceil(math.log2(max(1, len(self.points)) / LEAF)))
        parts = [np.arange(len(self.points))]
        self.levels = [self._boxes(parts)]
        for _ in range(self.depth):
            parts = [half for p in parts for half in self._halves(p)]
            self.levels.append(self._boxes(parts))
        order = np.concatenate(parts)
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.points = self.points[order]
        by_leaf = np.argsort(rank[owner], kind="stable")
        members, owner = members[by_leaf], rank[owner][by_leaf]
        cuts = np.searchsorted(owner, at)
        self.leaves = [(self.points[a:b], members[x:y], owner[x:y] - a) for a, b, x, y in zip(at[:-1], at[1:], cuts[:-1], cuts[1:])]

    def _halves(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.points[part]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if own.size else 0
        middle = len(part) // 2
        split = np.argpartition(own[:, axis], middle) if own.size else np.arange(len(part))
        return part[split[:middle]], part[split[middle:]]

    def _boxes(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([self.points[p].min(axis=0) for p in parts]), np.array([self.points[p].max(axis=0) for p in parts])


class Cells:
    """The top splits of a KD-tree by medians of a sample, and the rows and boxes of its cells; vectors of another
    length are in one cell more, without a box."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.dim, self.levels = sample.shape[1], []
        parts = [sample]
        for _ in range(depth):
            axes = np.array([int(np.argmax(np.ptp(p, axis=0))) if p.size else 0 for p in parts])
            cuts = np.array([np.median(p[:, a]) if p.size else 0.0 for p, a in zip(parts, axes)])
            parts = [half for p, a, c in zip(parts, axes, cuts) for half in (p[p[:, a] < c] if p.size else p, p[p[:, a] >= c] if p.size else p)]
            self.levels.append((axes, cuts))
        self.n = len(parts)

    def of(self, points: np.ndarray) -> np.ndarray:
        cell = np.zeros(len(points), np.int64)
        for axes, cuts in self.levels:
            cell = 2 * cell + (points[np.arange(len(points)), axes[cell]] >= cuts[cell])
        return cell

    def of_rows(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cells of a batch's rows, which rows have the tree's length, and their points."""
        fits = batch.column("dim").to_numpy() == self.dim
        vectors = batch.column("v").filter(pa.array(fits))
        points = np.floor(vectors.flatten().to_numpy(zero_copy_only=False)).reshape(len(vectors), self.dim)
        cell = np.full(len(fits), self.n, np.int64)
        cell[fits] = self.of(points)
        return cell, fits, points

    def summarize(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a partition's rows: how many each cell has, and their box."""
        counts = np.zeros(self.n + 1, np.int64)
        low, high = np.full((self.n + 1, self.dim), np.inf), np.full((self.n + 1, self.dim), -np.inf)
        for batch in batches:
            cell, fits, points = self.of_rows(batch)
            counts += np.bincount(cell, minlength=self.n + 1)
            if len(points):
                order = np.argsort(cell[fits], kind="stable")
                own, at = np.unique(cell[fits][order], return_index=True)
                low[own] = np.minimum(low[own], np.minimum.reduceat(points[order], at, axis=0))
                high[own] = np.maximum(high[own], np.maximum.reduceat(points[order], at, axis=0))
        some = np.flatnonzero(counts)
        box = [pa.array(list(x[some]), pa.list_(pa.float64())) for x in (low, high)]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), *box], names=["cell", "n", "low", "high"])

    def take(self, summaries: DataFrame, shard_rows: int) -> None:
        """Adds up the partitions' summaries: boxes, and the shards first .. first + parts - 1 of each cell."""
        counts = np.zeros(self.n + 1, np.int64)
        for cell, n in summaries.groupBy("cell").agg(F.sum("n")).collect():
            counts[cell] = n
        self.low, self.high = np.full((self.n, self.dim), np.inf), np.full((self.n, self.dim), -np.inf)
        sides = summaries.filter(F.col("cell") < self.n).select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("i", "s"))
        sides = sides.groupBy("cell", "i").agg(F.min("s.low").alias("low"), F.max("s.high").alias("high"))
        for cell, box in sides.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high")))).collect():
            self.low[cell], self.high[cell] = [s["low"] for s in box], [s["high"] for s in box]
        self.parts = -(-counts // shard_rows)
        self.first = np.cumsum(self.parts) - self.parts
        self.shards = int(self.parts.sum())

    def deal(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (dim, key, vec_id, v, q) with their shard in place of the key."""
        for batch in batches:
            cell, _, _ = self.of_rows(batch)
            key = batch.column("key").to_numpy().view(np.uint64)
            shard = self.first[cell] + (key % self.parts[cell].astype(np.uint64)).astype(np.int64)
            columns = [batch.column("dim"), pa.array(shard.astype(np.int32)), *(batch.column(c) for c in ("vec_id", "v", "q"))]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "shard", "vec_id", "v", "q"])

    def route(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries (dim, own, vec_id, v, floor) with the shards, besides their own, that may hold a score of at least their floor."""
        for batch in batches:
            _, fits, points = self.of_rows(batch)
            floor = batch.column("floor").fill_null(-np.inf).to_numpy()[fits]
            some = np.flatnonzero(self.parts[: self.n])
            bounds = np.maximum(points, 0) @ self.high[some].T + np.minimum(points, 0) @ self.low[some].T
            open_cells = np.zeros((len(fits), self.n + 1), bool)
            open_cells[np.flatnonzero(fits)[:, None], some[None, :]] = bounds >= floor[:, None]
            open_cells[~fits, self.n] = True
            open_shards = np.repeat(open_cells, self.parts, axis=1)
            open_shards[np.arange(len(fits)), batch.column("own").to_numpy()] = False
            who, shard = np.nonzero(open_shards)
            at = np.searchsorted(who, np.arange(len(fits) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(shard.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "shards"])


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.queries, self.own, self.k = queries, ids, k
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor
        self.up, self.down = np.maximum(queries, 0), np.minimum(queries, 0)
        self.scores = np.full((len(ids), k), -np.inf)
        self.ids = np.full((len(ids), k), NO_ID, np.int64)

    def kth(self, who: np.ndarray) -> np.ndarray:
        return np.maximum(self.scores[who, -1], self.floor[who])

    def bound(self, who: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The largest score that a point of each box can have with each query."""
        return self.up[who] @ high.T + self.down[who] @ low.T

    def visit(self, who: np.ndarray, leaf: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        points, ids, owner = leaf
        scores = (self.queries[who] @ points.T)[:, owner]
        scores[self.own[who][:, None] == ids[None, :]] = -np.inf
        better = (scores >= self.kth(who)[:, None]) & (scores > -np.inf)
        some = np.flatnonzero(better.any(axis=1))
        if not len(some):
            return
        who, scores = who[some], np.where(better[some], scores[some], -np.inf)
        all_scores = np.concatenate([self.scores[who], scores], axis=1)
        all_ids = np.concatenate([self.ids[who], np.broadcast_to(ids, scores.shape)], axis=1)
        all_ids = np.where(all_scores > -np.inf, all_ids, NO_ID)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
        self.scores[who] = np.take_along_axis(all_scores, order, axis=1)
        self.ids[who] = np.take_along_axis(all_ids, order, axis=1)

    def visit_each(self, who: np.ndarray, leaf: np.ndarray, tree: KdTree) -> None:
        order = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.diff(leaf[order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                self.visit(who[part], tree.leaves[int(leaf[part[0]])])

    def search(self, tree: KdTree) -> None:
        everyone = np.arange(len(self.own))
        node = np.zeros(len(everyone), np.int64)
        for depth in range(1, tree.depth + 1):  # down to the most promising leaf
            bounds = self.bound(everyone, *tree.levels[depth])
            left, right = bounds[everyone, 2 * node], bounds[everyone, 2 * node + 1]
            node = 2 * node + (right > left)
        self.visit_each(everyone, node, tree)
        open_nodes = np.ones((len(everyone), 1), bool)
        bounds = np.zeros((len(everyone), 1))
        for depth in range(1, tree.depth + 1):  # a pruned node's children stay closed
            bounds = self.bound(everyone, *tree.levels[depth])
            open_nodes = np.repeat(open_nodes, 2, axis=1) & (bounds >= self.kth(everyone)[:, None])
        open_nodes[everyone, node] = False
        ranked = np.argsort(np.where(open_nodes, -bounds, np.inf), axis=1, kind="stable")
        counts = open_nodes.sum(axis=1)
        who = everyone[counts > 0]
        for turn in range(int(counts.max(initial=0))):
            who = who[counts[who] > turn]
            leaf = ranked[who, turn]
            alive = bounds[who, leaf] >= self.kth(who)
            who, leaf = who[alive], leaf[alive]
            if not len(who):
                break
            self.visit_each(who, leaf, tree)


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.floor(values.astype(np.float64)).reshape(rows, -1)


def _search(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not queries.num_rows or not vectors.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        ids = vectors.column("vec_id").to_numpy()
        points = _matrix(vectors.column("v"), len(ids))
        floor = queries.column("floor").fill_null(-np.inf).to_numpy()
        best = Best(_matrix(queries.column("v"), queries.num_rows), queries.column("vec_id").to_numpy(), k, floor)
        for lo in range(0, len(ids), TREE_ROWS):
            best.search(KdTree(points[lo : lo + TREE_ROWS], ids[lo : lo + TREE_ROWS], k + 1))
        found = best.scores > -np.inf
        who = np.repeat(best.own, k).reshape(-1, k)
        return pa.table([pa.array(who[found]), pa.array(best.ids[found]), pa.array(best.scores[found].astype(np.int64))], names=names)

    return run


def _cells(keyed: DataFrame, n: int, shard_rows: int) -> Cells:
    """The cells of the rows (dim, vec_id, v): at most 2 ** MOST_DEPTH for vectors of the sample's most frequent length."""
    depth = min(MOST_DEPTH, max(0, math.ceil(math.log2(max(1, n / shard_rows)))))
    drawn = keyed.select("v").sample(min(1.0, SAMPLE / max(1, n)), 1).collect() if depth else []
    lengths = [len(v) for (v,) in drawn]
    dim = max(set(lengths), key=lambda d: (lengths.count(d), d)) if lengths else 0
    chosen = [v for (v,) in drawn if len(v) == dim]
    sample = np.floor(np.array(chosen, np.float64)).reshape(len(chosen), dim)
    cells = Cells(sample, depth if dim else 0)
    cells.take(written(keyed.mapInArrow(cells.summarize, "cell int, n long, low array<double>, high array<double>")), shard_rows)
    return cells


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k highest integer inner products of each row that is_query picks with
    every other row, components taken as floor(scale * x)."""
    sound = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(vector_col, lambda x: F.lit(scale) * x.cast("double"))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & sound)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("v"), F.size(vector_col).alias("dim"), is_query.alias("q"))
    n, n_queries, dim = rows.agg(F.count("*"), F.count_if("q"), F.max("dim")).first()
    slots = vectors.sparkSession.sparkContext.defaultParallelism
    fit = max(1, MOST_BYTES // (8 * max(1, dim or 0)))
    shard_rows = min(fit, MOST_SHARD, max(LEAST_SHARD, n // (2 * slots)))
    blocks = max(1, math.ceil(n_queries / min(fit, QUERY_BLOCK)))
    keyed = rows.select("dim", F.xxhash64("vec_id").alias("key"), "vec_id", "v", "q")
    cells = _cells(keyed, n, shard_rows)
    tasks, out = ["dim", "block", "shard"], "query_id long, vec_id long, score long"
    dealt = keyed.mapInArrow(cells.deal, "dim int, shard int, vec_id long, v array<double>, q boolean")
    searched = dealt.select("dim", F.lit(0).alias("block"), "shard", "vec_id", "v")
    smallest = dealt.filter("q").groupBy("vec_id").agg(F.min(F.struct("v", "dim", "shard")).alias("of"))
    asked = smallest.select("of.dim", F.col("of.shard").alias("own"), "vec_id", "of.v")
    first = asked.select("dim", F.lit(0).alias("block"), F.col("own").alias("shard"), "vec_id", "v", F.lit(None).cast("double").alias("floor"))
    found = first.groupBy(*tasks).cogroup(searched.groupBy(*tasks)).applyInArrow(_search(k), out)
    if cells.shards > 1:
        found = written(found)
        floors = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("floor"))
        bounded = asked.join(floors, "vec_id", "left").select("dim", "own", "vec_id", "v", "floor")
        routed = written(bounded.mapInArrow(cells.route, "dim int, own int, vec_id long, v array<double>, floor double, shards array<int>"))
        within = F.col("own") + F.pmod(F.xxhash64("vec_id"), F.lit(1024)) / 1024
        block = F.floor(within * F.lit(blocks) / F.lit(cells.shards)).cast("int").alias("block")
        rest = routed.select("dim", block, F.explode("shards").alias("shard"), "vec_id", "v", "floor")
        # Written, so that its size is known before the vectors move: a small one is broadcast by Spark's own threshold.
        wanted = written(rest.select(*tasks).distinct().groupBy("dim", "shard").agg(F.collect_list("block").alias("blocks")))
        searched = searched.join(wanted, ["dim", "shard"]).select("dim", F.explode("blocks").alias("block"), "shard", "vec_id", "v")
        found = found.union(rest.groupBy(*tasks).cogroup(searched.groupBy(*tasks)).applyInArrow(_search(k), out))
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", ranked).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
