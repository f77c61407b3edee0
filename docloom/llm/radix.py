"""A distributed radix sort, least significant digit first.

A row has a place; BLOCK rows of neighbouring places are a block. Each pass takes one digit of the composite key: rows
are counted by (block, digit), the counts' prefix sums in the order (digit, block) tell where each block's rows of each digit
begin, and each block sorts its rows by counting, stably, and gives them their new places. So a pass is one shuffle of
the rows by block and one of the counts, a task holds one block at a time whatever the keys are, and hot keys
are only long runs of places. After the last pass places are ranks. Every pass ends in a written table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.sources.store import forget, written

BLOCK_BITS, DIGIT_BITS, WORD_BITS = 15, 12, 62


def _packed(keys: list[tuple[Column, int]]) -> list[tuple[Column, int]]:
    """The same composite key in fewer numbers of at most WORD_BITS bits."""
    out: list[tuple[Column, int]] = []
    for column, bits in reversed(keys):
        if out and out[-1][1] + bits <= WORD_BITS:
            low, width = out[-1]
            out[-1] = (F.shiftleft(column.cast("long"), width).bitwiseOR(low), width + bits)
        else:
            out.append((column.cast("long"), bits))
    return out[::-1]


def _move(shift: int, mask: int, word: str, names: list[str]):
    """Rows of a block to their new places: left are the rows, right the first place of each of its digits."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        digit = (left.column(word).to_numpy() >> shift) & mask
        order = np.lexsort((left.column("place").to_numpy(), digit))
        digit = digit[order]
        first = np.flatnonzero(np.r_[True, digit[1:] != digit[:-1]])
        base = np.zeros(mask + 1, np.int64)
        base[right.column("digit").to_numpy()] = right.column("base").to_numpy()
        place = base[digit] + np.arange(len(digit)) - np.repeat(first, np.diff(np.append(first, len(digit))))
        moved = left.select(names).take(pa.array(order))
        return moved.append_column("place", pa.array(place))

    return run


def radix_ranks(rows: DataFrame, keys: list[tuple[Column, int]], out: str = "rank") -> DataFrame:
    """rows with a long column out: 1, 2, 3... by the keys ascending, the first one most significant.

    keys: columns of integers without null, and how many bits they have at most (62); none is negative. Rows with equal keys
    are ranked in the order in which they are read. Other columns are carried along, so they should be few.
    An empty table gives an empty result.
    """
    given = rows.columns
    words = _packed([(c, max(1, bits)) for c, bits in keys])
    named = [f"__word{i}" for i in range(len(words))]
    current = written(rows.select(*given, *[c.alias(n) for (c, _), n in zip(words, named)]))
    base = current
    current = current.withColumn("place", F.monotonically_increasing_id())
    tables = [base]
    for (_, bits), word in reversed(list(zip(words, named))):
        # Digits of equal width rather than a narrow last one.
        passes = -(-bits // DIGIT_BITS)
        width = -(-bits // passes)
        for shift in range(0, bits, width):
            mask = (1 << width) - 1
            digit = F.shiftrightunsigned(word, shift).bitwiseAND(F.lit(mask))
            placed = current.withColumn("block", F.shiftrightunsigned("place", BLOCK_BITS))
            counts = placed.groupBy("block", digit.alias("digit")).agg(F.count("*").alias("n"))
            upto = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
            within = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
            # One row for each of at most 2 ** DIGIT_BITS digits.
            totals = counts.groupBy("digit").agg(F.sum("n").alias("total"))
            smaller = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
            begins = totals.select("digit", F.coalesce(F.sum("total").over(smaller), F.lit(0)).alias("begin"))
            bases = within.join(F.broadcast(begins), "digit").select(F.col("block").alias("of"), "digit", (F.col("begin") + F.col("before")).alias("base"))
            names = [*given, *named]
            schema = placed.select(*names, "place").schema
            moved = placed.groupBy("block").cogroup(bases.groupBy("of")).applyInArrow(_move(shift, mask, word, names), schema)
            current = written(moved)
            tables.append(current)
            forget(tables.pop(0))
    return current.select(*given, (F.col("place") + 1).alias(out))
