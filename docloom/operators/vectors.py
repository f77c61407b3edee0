"""Exact top-k by clamped inner product over a partitioned index of balls, and hybrid top-k on top of it.

Vectors of one space (say a workspace) and length are dealt to the nearest of a few pivots, which gives cells with a ball each:
centre and radius. No vector of a cell has an inner product with a query above q . centre + |q| * radius. A query is
first searched in its most promising cell; its k-th score there goes with it to all other cells, and it enters only those
whose ball may still hold a better row. Cells beyond CHUNK_ROWS are searched in chunks, queries in parts, so a task's
matrices are bounded whatever the data look like.

Scores are rounded to six decimals; ties go to the smaller item. Vectors that are missing, hold a null or a non-finite component or
are of another length score 0 and come last by item. Items with several vectors (a page with its units) score their best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.search import dot
from docloom.sources.store import forget, written

#: Rows a pivot stands for, most pivots of a space, and the rows of vectors and queries that a task takes at a time.
CELL_ROWS, MOST_CELLS, PART_ROWS, CHUNK_ROWS, QUERY_ROWS = 512, 1024, 16384, 4096, 1024
SLACK = 1e-6


def usable(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(vector) > 0), F.lit(False))


def six(x: Column) -> Column:
    """x at six decimals, half up, in doubles as in the tasks: x is not negative."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


def _assign(keys: list[str]):
    """Vectors of a part to their nearest pivots: cell and distance."""

    def run(vectors: pa.Table, pivots: pa.Table) -> pa.Table:
        x, p = _matrix(vectors.column("v"), vectors.num_rows), _matrix(pivots.column("pivot"), pivots.num_rows)
        order = np.argsort(pivots.column("cell").to_numpy())
        p = p[order]
        cell, far = np.empty(len(x), np.int32), np.empty(len(x))
        for lo in range(0, len(x), 1024):
            own = x[lo : lo + 1024]
            best = np.argmin((p * p).sum(axis=1) - 2 * own @ p.T, axis=1)
            cell[lo : lo + 1024] = pivots.column("cell").to_numpy()[order][best]
            far[lo : lo + 1024] = np.sqrt(((own - p[best]) ** 2).sum(axis=1))
        return vectors.select([*keys, "dim", "item", "v"]).append_column("cell", pa.array(cell)).append_column("far", pa.array(far))

    return run


def _route(keys: list[str], first: bool):
    """Queries to cells: the most promising one, or all others that may hold a better row than the k-th so far."""

    def run(queries: pa.Table, balls: pa.Table) -> pa.Table:
        q, centres = _matrix(queries.column("asked"), queries.num_rows), _matrix(balls.column("centre"), balls.num_rows)
        length = np.sqrt((q * q).sum(axis=1))[:, None]
        radius = balls.column("radius").to_numpy()[None, :]
        bound = q @ centres.T + length * radius
        bound += SLACK + 1e-9 * length * (radius + np.sqrt((centres * centres).sum(axis=1))[None, :])
        best = np.argmax(bound, axis=1)
        if first:
            who, where = np.arange(len(q)), best
        else:
            weight = queries.column("weight").to_numpy()[:, None]
            open_ = np.clip(bound, 0, 1) * weight + SLACK >= queries.column("floor").fill_null(-1.0).to_numpy()[:, None]
            open_[np.arange(len(q)), best] = False
            who, where = np.nonzero(open_)
        out = queries.select([*keys, "dim", "part", "query_id", "asked", "weight"]).take(pa.array(who))
        return out.append_column("cell", balls.column("cell").take(pa.array(where))).append_column("n", balls.column("n").take(pa.array(where)))

    return run


def _search(k: int, item_type: pa.DataType, id_type: pa.DataType):
    """The k best items of a chunk for each query of a part."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        names = ["query_id", "item", "score", "weight"]
        schema = pa.schema(list(zip(names, [id_type, item_type, pa.float64(), pa.float64()])))
        if not queries.num_rows or not vectors.num_rows:
            return schema.empty_table()
        vectors = vectors.sort_by("item").combine_chunks()
        items = vectors.column("item").combine_chunks()
        items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
        code = items.dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        x, weights = _matrix(vectors.column("v"), vectors.num_rows), queries.column("weight").to_numpy()
        asked = _matrix(queries.column("asked"), queries.num_rows)
        parts = []
        for lo in range(0, len(asked), QUERY_ROWS):
            score = _rounded(np.clip(np.maximum.reduceat(asked[lo : lo + QUERY_ROWS] @ x.T, starts, axis=1), 0, 1))
            weight = weights[lo : lo + QUERY_ROWS][:, None]
            top = np.argsort(-_rounded(score * weight), axis=1, kind="stable")[:, :k]
            who = np.repeat(np.arange(lo, lo + len(score)), top.shape[1])
            columns = [queries.column("query_id").take(pa.array(who)), items.take(pa.array(starts[top.ravel()])), np.take_along_axis(score, top, axis=1).ravel(), weights[who]]
            parts.append(pa.table([columns[0].combine_chunks(), columns[1], pa.array(columns[2]), pa.array(columns[3])], schema=schema))
        return pa.concat_tables(parts)

    return run


class VectorIndex:
    """An index of rows (keys..., item, v); keys name the columns of a space, within which queries search."""

    def __init__(self, vectors: DataFrame, keys: list[str]):
        self.keys, by = keys, [*keys, "dim"]
        sound = usable(F.col("v"))
        rows = vectors.select(*keys, "item", F.when(sound, F.transform("v", lambda x: x.cast("double"))).alias("v"), F.when(sound, F.size("v")).otherwise(-1).alias("dim"))
        self.types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        # The smallest items of each space and length: they stand in where their vectors do not count.
        place = F.row_number().over(Window.partitionBy(*by).orderBy("item"))
        self.smallest = lambda k: rows.select(*by, "item").distinct().withColumn("k", place).filter(F.col("k") <= k).drop("k")
        sizes = written(rows.filter("dim > 0").groupBy(*by).agg(F.count("*").alias("rows")))
        dealt = rows.filter("dim > 0").withColumn("hash", F.xxhash64("item", "v"))
        drawn = F.row_number().over(Window.partitionBy(*by).orderBy("hash", "item", "v"))
        wanted = F.least(F.lit(MOST_CELLS), F.ceil(F.col("rows") / CELL_ROWS))
        pivots = dealt.withColumn("cell", drawn).filter(F.col("cell") <= MOST_CELLS).join(sizes, by).filter(F.col("cell") <= wanted)
        pivots = written(pivots.select(*by, "cell", F.col("v").alias("pivot"), "rows"))
        n_parts = F.ceil(F.col("rows") / PART_ROWS)
        left = dealt.join(sizes, by).withColumn("part", F.pmod("hash", n_parts).cast("int"))
        right = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), (n_parts - 1).cast("int"))))
        right = right.select(*[F.col(c).alias(f"{c}_p") for c in [*by, "part"]], "cell", "pivot")
        spaces = ", ".join(f"{c} {self.types[c]}" for c in by)
        assigned = left.groupBy(*by, "part").cogroup(right.groupBy(*[f"{c}_p" for c in [*by, "part"]])).applyInArrow(_assign(keys), f"{spaces}, item {self.types['item']}, v array<double>, cell int, far double")
        assigned = written(assigned)
        balls = assigned.groupBy(*by, "cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
        self.balls = written(balls.join(pivots.select(*by, "cell", F.col("pivot").alias("centre")), [*by, "cell"]))
        chunk = F.pmod(F.xxhash64("item"), F.ceil(F.col("n") / CHUNK_ROWS)).cast("int")
        self.cells = written(assigned.join(self.balls.select(*by, "cell", "n"), [*by, "cell"]).select(*by, "cell", chunk.alias("chunk"), "item", "v"))
        forget(assigned, pivots, sizes)

    def _routed(self, queries: DataFrame, first: bool) -> DataFrame:
        by = [*self.keys, "dim"]
        parts = queries.select(*by, "part").distinct()
        balls = self.balls.join(parts, by).select(*[F.col(c).alias(f"{c}_b") for c in [*by, "part"]], "cell", "centre", "radius", "n")
        kind = dict(queries.dtypes)["query_id"]
        spaces = ", ".join(f"{c} {self.types[c]}" for c in by)
        schema = f"{spaces}, part int, query_id {kind}, asked array<double>, weight double, cell int, n long"
        known = queries.join(self.balls.select(*by).distinct(), by, "left_semi")
        return written(known.groupBy(*by, "part").cogroup(balls.groupBy(*[f"{c}_b" for c in [*by, "part"]])).applyInArrow(_route(self.keys, first), schema))

    def _found(self, routed: DataFrame, k: int) -> DataFrame:
        by = [*self.keys, "dim", "cell"]
        wanted = written(routed.select(*by, "part").distinct())
        cells = self.cells.join(wanted, by).select(*[F.col(c).alias(f"{c}_c") for c in [*by, "part", "chunk"]], "item", "v")
        chunks = self.cells.select(*by, "chunk").distinct()
        asked = routed.join(chunks, by)
        group = [*by, "part", "chunk"]
        kinds = dict(routed.dtypes)["query_id"], self.types["item"]
        arrow = [pa.int64() if k in ("bigint", "long") else pa.int32() if k == "int" else pa.string() for k in kinds]
        search = _search(k, arrow[1], arrow[0])
        return written(asked.groupBy(*group).cogroup(cells.groupBy(*[f"{c}_c" for c in group])).applyInArrow(search, f"query_id {kinds[0]}, item {kinds[1]}, score double, weight double"))

    def search(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(rows (query_id, item, score, rank) of the k best items of each query, rows (query_id, n) of the cells searched and their sizes).

        queries: query_id, keys..., asked and, if scores are to be ranked by a share of theirs, weight (0 to 1): ranks then go by weight * score.
        """
        sound = usable(F.col("asked"))
        weight = F.col("weight").cast("double") if "weight" in queries.columns else F.lit(1.0)
        own = queries.select("query_id", *self.keys, F.when(sound, F.transform("asked", lambda x: x.cast("double"))).alias("asked"), F.when(sound, F.size("asked")).otherwise(-2).alias("dim"), weight.alias("weight"))
        per_space = own.groupBy(*self.keys, "dim").agg(F.count("*").alias("queries"))
        part = F.pmod(F.xxhash64("query_id"), F.ceil(F.col("queries") / QUERY_ROWS)).cast("int")
        own = written(own.join(per_space, [*self.keys, "dim"]).withColumn("part", part))
        by_score = Window.partitionBy("query_id").orderBy(F.desc(six(F.col("weight") * F.col("score"))), "item")
        able = own.filter("dim > 0")
        near = self._routed(able, first=True)
        found = self._found(near, k)
        floors = found.groupBy("query_id", "item", "weight").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") == k)
        floors = floors.select("query_id", six(F.col("weight") * F.col("score")).alias("floor"))
        far = self._routed(written(able.join(floors, "query_id", "left")), first=False)
        rest = self._found(far, k)
        other = self.smallest(k).withColumnRenamed("dim", "other")
        zero = own.join(other, self.keys).filter(F.col("dim") != F.col("other")).select("query_id", "item", F.lit(0.0).alias("score"), "weight")
        best = found.union(rest).union(zero).groupBy("query_id", "item", "weight").agg(F.max("score").alias("score"))
        ranked = best.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("query_id", "item", "score", "rank")
        return ranked, near.union(far).select("query_id", "n")


def hybrid_top(queries: DataFrame, text: DataFrame, vectors: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    """Rows (query_id, item, score, rank): the k best items of each query by weight * dense + (1 - weight) * text.

    queries: query_id, keys..., asked, weight; text: query_id, item, text for the items with a text score above 0, any others have 0;
    vectors: keys..., item, v with one row an item, those of the index. Items without a text score can only be
    among the k best if they are so by vectors alone, so only these and the items with a text score are looked at; and of
    the latter only those that a full vector score would lift to the k-th place known so far.
    """
    keys = index.keys
    dense, _ = index.search(queries, k)
    alone = dense.select("query_id", "item", F.col("score").alias("dense"))
    asked = queries.select("query_id", *keys, "asked", F.col("weight").cast("double").alias("weight"))
    mix = six(F.col("weight") * F.col("dense") + (1 - F.col("weight")) * F.coalesce("text", F.lit(0.0)))
    known = written(alone.join(text, ["query_id", "item"], "left").join(asked.select("query_id", "weight"), "query_id").select("query_id", "item", mix.alias("score")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item"))
    floors = known.withColumn("rank", place).filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    hopeful = text.join(asked, "query_id").join(floors, "query_id", "left").join(known.select("query_id", "item"), ["query_id", "item"], "left_anti")
    hopeful = hopeful.filter(F.col("floor").isNull() | (F.col("weight") + (1 - F.col("weight")) * F.col("text") + SLACK >= F.col("floor")))
    own = vectors.select(*keys, "item", F.when(usable(F.col("v")), F.col("v")).alias("v"))
    whole = six(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.when(usable(F.col("asked")), dot(F.col("asked"), F.col("v"))), F.lit(0.0)))))
    more = hopeful.join(own, [*keys, "item"], "left").withColumn("dense", whole).select("query_id", "item", mix.alias("score"))
    return known.union(more).withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "item", "score", "rank")
