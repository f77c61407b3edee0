"""How the sources of a language differ in their use of terms, from run-length encoded count columns.

Terms are counted by (language, source) in tasks, whose dictionaries compare terms by all their bytes; a term's documents are counted
beside. The counts of a kept term in the sources of its language are a row of a matrix; a source is a column. Terms with equal rows are
collapsed to one row that knows how many they are, and rows are sorted, so that equal counts stand together. Blocks of
neighbouring rows are then encoded column by column as runs of equal counts; for each pair of columns the run boundaries are
intersected, and a run adds |p - q| times its length. Sums over blocks are partial until the last grouping.

p is 1 + floor(SCALE * (count + ALPHA) / (N + ALPHA * V)), in integers throughout.

Nulls: null text, language and source are read as ''. A group without terms is compared like any other. Repeated rows count as
documents of their own. An empty table gives an empty result. Other columns do not matter, whatever their names. A text is worked
on as a whole, at about 100 bytes for each of its words. A term's row has at most one entry for each source of its language, and the
result has all ordered pairs of those, so sources are taken to be a few thousands in a language at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm import kernels as K
from docloom.llm.memo import SpanMemo
from docloom.sources.store import written

SCALE, ALPHA = 1_000_000_000, 5
#: Rows of a block of the matrix; counts that a task holds before it sends them; terms in a task's dictionary.
BLOCK_ROWS, HELD, MOST_TERMS = 1 << 13, 1 << 20, 1 << 20
#: Bytes of terms once A-Z are in lower case: letters and all bytes of characters outside ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Counts:
    """Occurrences and documents by (group, term) in a task."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self._restart()

    def _restart(self) -> None:
        self.terms: list[bytes] = []
        self.memo = SpanMemo(self._number)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def _number(self, term: bytes) -> tuple[int]:
        self.terms.append(term)
        return (len(self.terms) - 1,)

    def add(self, data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> None:
        """groups: the number of each text's group."""
        data = K.LOWER[data]
        starts, ends, rows = K.words(data, offsets, INSIDE)
        places, _ = self.memo.lookup(data, starts, ends)
        term = self.memo.values[places].astype(np.int64)
        text = np.repeat(np.arange(len(groups)), np.diff(rows))
        keys, n = np.unique(text << 32 | term, return_counts=True)
        by_group = groups[keys >> 32] << 32 | keys & 0xFFFFFFFF
        self.held.append(self._summed(by_group, n, np.ones(len(n), np.int64)))
        self.size += len(self.held[-1][0])

    @staticmethod
    def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)

    def rows(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """What is to be sent now: everything at the last call, and once too much is held."""
        if self.held and (last or self.size >= HELD):
            self.held = [self._summed(*(np.concatenate(x) for x in zip(*self.held)))]
            self.size = len(self.held[0][0])
        if self.held and (last or self.size >= HELD // 2 or len(self.terms) > MOST_TERMS):
            keys, n, docs = self._summed(*(np.concatenate(x) for x in zip(*self.held)))
            names = list(self.groups)
            lang, source = (pa.array([x[k] for x in names], pa.string()).take(pa.array(keys >> 32)) for k in (0, 1))
            terms = pa.array(self.terms, pa.binary()).take(pa.array(keys & 0xFFFFFFFF)).cast(pa.string())
            for lo in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([x[lo : lo + (1 << 16)] for x in (lang, source, terms, pa.array(n), pa.array(docs))], names=["lang", "source", "term", "n", "docs"])
            self._restart()


def term_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, docs) of docs (lang, source, text), added up within tasks only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            groups = np.array([counts.groups.setdefault(p, len(counts.groups)) for p in pairs], np.int64)
            for lo, hi, data, offsets in K.text_chunks(batch.column(2)):
                counts.add(data, offsets, groups[lo:hi])
                yield from counts.rows()
        yield from counts.rows(last=True)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column) -> Column:
    """p of a count, exact beyond 64 bits; total is N + ALPHA * V."""
    big = lambda c: c.cast("decimal(20,0)")
    quotient = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * big(count + ALPHA), big(total))
    return (quotient + 1).cast("long")


def runs(rows: np.ndarray, counts: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, counts) of the runs of equal counts in a column of n_rows rows that is zero but for the given rows."""
    edges = np.concatenate([[0], rows, rows + 1])
    values = np.concatenate([[0], counts, np.zeros(len(rows), counts.dtype)])
    # At one place a row's own count comes after the zero behind the row before it.
    order = np.lexsort((np.concatenate([[0], np.full(len(rows), 2), np.ones(len(rows), np.int64)]), edges))
    edges, values = edges[order], values[order]
    keep = np.append(edges[1:] != edges[:-1], True) & (edges < n_rows)
    edges, values = edges[keep], values[keep]
    change = np.r_[True, values[1:] != values[:-1]] if len(values) else np.zeros(0, bool)
    return edges[change], values[change]


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """p of each count, each different count once and in whole numbers of any size."""
    own, back = np.unique(counts, return_inverse=True)
    return np.array([1 + SCALE * (c + ALPHA) // total for c in own.tolist()], np.int64)[back]


def run_distance(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], upto: np.ndarray) -> int:
    """Sum of |p - q| over the rows of two columns of runs (starts, shares); upto[k] is how many terms the rows before k stand for."""
    cuts = np.union1d(one[0], other[0])
    p, q = (x[1][np.searchsorted(x[0], cuts, side="right") - 1] for x in (one, other))
    return int((np.abs(p - q) * np.diff(upto[np.append(cuts, len(upto) - 1)])).sum())


def _block(left: pa.Table, right: pa.Table) -> pa.Table:
    """Partial sums over a block's rows for all pairs of columns; right: the columns' totals."""
    lang, totals = right.column("of_lang")[0].as_py(), right.column("totals")[0].as_py()
    left = left.sort_by("place").combine_chunks()
    n_rows = left.num_rows
    upto = np.concatenate([[0], np.cumsum(left.column("times").to_numpy())])
    cells = left.column("cells").combine_chunks()
    cells = cells.chunk(0) if isinstance(cells, pa.ChunkedArray) else cells
    row = np.repeat(np.arange(n_rows), pa.compute.list_value_length(cells).to_numpy())
    flat = cells.flatten()
    column, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    order = np.argsort(column, kind="stable")
    row, n = row[order], n[order]
    at = np.searchsorted(column[order], np.arange(len(totals) + 1))
    columns = []
    for k, total in enumerate(totals):
        starts, values = runs(row[at[k] : at[k + 1]], n[at[k] : at[k + 1]], n_rows)
        columns.append((starts, shares(values, total)))
    pairs = [(a, b) for a in range(len(totals)) for b in range(a + 1, len(totals))]
    values = [run_distance(columns[a], columns[b], upto) for a, b in pairs]
    out = [pa.array([lang] * len(pairs), pa.string()), pa.array([a for a, _ in pairs], pa.int32()), pa.array([b for _, b in pairs], pa.int32()), pa.array(values, pa.int64())]
    return pa.Table.from_arrays(out, names=["lang", "a", "b", "value"])


def divergence(docs: DataFrame, min_docs: int = 30, most_terms: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows (lang, source, part, item, value, rank). Part 'pair': the distance of a group's shares to those of each other source of its language.
    Part 'term': the most_terms kept terms whose share is most above that of the language. Ties go to the smaller item.

    Kept are the terms that at least min_docs documents of a language hold. All languages and sources that occur take part.
    """
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    order = Window.partitionBy("lang").orderBy(F.desc("size"), "source")
    groups = written(texts.groupBy("lang", "source").agg(F.count("*").alias("size")).select("lang", "source", (F.row_number().over(order) - 1).alias("k")))
    counted = term_counts(texts).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = counted.join(groups, ["lang", "source"]).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("k", "n")).alias("cells"))
    kept = written(by_term.filter(F.col("docs") >= min_docs).select("lang", "term", "n", F.array_sort("cells").alias("cells")))

    langs = kept.groupBy("lang").agg((F.sum("n") + ALPHA * F.count("*")).alias("of_lang"), F.count("*").alias("terms"))
    sizes = kept.select("lang", F.explode("cells").alias("cell")).groupBy("lang", F.col("cell.k").alias("k")).agg(F.sum("cell.n").alias("n"))
    of_group = F.coalesce(F.col("n"), F.lit(0)) + ALPHA * F.col("terms")
    groups_of = written(groups.join(langs, "lang").join(sizes, ["lang", "k"], "left").select("lang", "k", "source", of_group.alias("of_group"), "of_lang"))

    collapsed = written(kept.groupBy("lang", "cells").agg(F.count("*").alias("times")))
    blocks = max(1, math.ceil(collapsed.count() / BLOCK_ROWS))
    ranged = collapsed.repartitionByRange(blocks, "lang", "cells").sortWithinPartitions("lang", "cells")
    placed = written(ranged.select("*", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("place")))
    totals = groups_of.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "of_group"))), lambda x: x["of_group"]).alias("totals"))
    of_block = placed.select("lang", "block").distinct().join(totals, "lang").toDF("of_lang", "of_block", "totals")
    partial = placed.groupBy("lang", "block").cogroup(of_block.groupBy("of_lang", "of_block")).applyInArrow(_block, "lang string, a int, b int, value long")
    both = partial.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("pair"), "value").select("lang", "pair.a", "pair.b", "value")
    # Languages without kept terms have no blocks, but their pairs are in the result.
    other = groups.select("lang", F.col("k").alias("b"), F.col("source").alias("item"))
    all_pairs = groups.withColumnRenamed("k", "a").join(other, "lang").filter("a <> b")
    summed = both.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = all_pairs.join(summed, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    cells = kept.select("lang", "term", F.col("n").alias("all"), F.explode("cells").alias("cell")).select("lang", "term", "all", "cell.*")
    above = share(F.col("n"), F.col("of_group")) - share(F.col("all"), F.col("of_lang"))
    terms = cells.join(groups_of, ["lang", "k"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), above.alias("value")).filter("value > 0")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [t.withColumn("rank", F.row_number().over(best)) for t in (pairs, terms)]
    return ranked[0].union(ranked[1].filter(F.col("rank") <= most_terms))
