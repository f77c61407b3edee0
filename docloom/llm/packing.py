"""Packing token sequences into fixed windows by non-negative least squares.

A document's ids are cut into full windows, a middle part of whole units, and a tail shorter than a unit; each
cut is made where the text is tokenized, so ids are never moved. What is left to decide depends on two bounded
histograms alone: middle parts by their number of units, and tails by their number of ids. For each, all
combinations of up to DEPTH lengths that fill a window (a unit, for tails) exactly are enumerated, non-negative
least squares finds how often each should be used, and the counts are rounded down to what the histogram holds.
Tails that fill a unit together form one more unit. The residual units are packed greedily, one after another,
cutting a part where a window ends; residual tails fill windows greedily, the longest first.

Pieces learn their place from their rank among pieces of their length. Ranks come from counts by bucket (a hash
of the document) and running sums of those counts, so no task sees more than a bucket.

Nulls: a null text is an empty one: the end id alone. A null id is kept as it is. Repeated rows are packed each.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import bpe
from docloom.llm import kernels as K
from docloom.sources.store import written

WINDOW, UNIT, DEPTH, END_ID = 2048, 64, 4, 1
BUCKET_DOCS = 2000
UNITS = WINDOW // UNIT


def combinations(total: int, depth: int) -> np.ndarray:
    """One row for each multiset of two to depth lengths below total with that sum: how often each length is used."""
    rows = []
    for k in range(1, depth):
        for head in combinations_with_replacement(range(1, total), k):
            last = total - sum(head)
            if last >= head[-1]:
                rows.append(np.bincount([*head, last], minlength=total))
    return np.array(rows)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: an active set grows by the steepest column and shrinks at the bounds."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        active[best] = True
        while True:
            z = np.zeros_like(x)
            z[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (z[active] > 0).all():
                x = z
                break
            low = active & (z <= 0)
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + step * (z - x)
            active &= x > 1e-12
            x[~active] = 0
            if not active.any():
                break
    return x


class Slots:
    """Where the pieces of a histogram go: (length, rank) -> (container, offset), or their place in the residual."""

    def __init__(self, histogram: np.ndarray, depth: int):
        size = len(histogram)
        uses = combinations(size, depth)
        counts = np.floor(nnls(uses.T.astype(float), histogram.astype(float)) + 1e-6).astype(np.int64)
        left = histogram.astype(np.int64).copy()
        self.slots: list[list[tuple[int, int, int]]] = [[] for _ in range(size)]  # (first rank, container, offset)
        self.containers = 0
        for p in np.argsort(-counts, kind="stable"):
            need = uses[p] > 0
            times = min(int(counts[p]), int((left[need] // uses[p][need]).min()))
            if times <= 0:
                continue
            offset = 0
            for length in np.flatnonzero(need):
                for _ in range(uses[p][length]):
                    self.slots[length].append((int(histogram[length] - left[length]), self.containers, offset))
                    left[length] -= times
                    offset += int(length)
            self.containers += times
        self.used, self.left = histogram - left, left

    def place(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Containers and offsets of ranks below used[length]."""
        first, container, offset = (np.array(c, np.int64) for c in zip(*self.slots[length]))
        k = np.searchsorted(first, ranks, side="right") - 1
        return container[k] + ranks - first[k], offset[k]


def greedy(left: np.ndarray, window: int) -> tuple[list[list[tuple[int, int, int, int]]], int]:
    """Slots (first rank, container, offset, pieces in a row) of each length and the number of containers.

    A container takes the longest lengths first, as many as fit; it is repeated while the histogram lasts, so the
    steps are as few as the lengths, whatever their counts.
    """
    total, left = left.copy(), left.copy()
    slots: list[list[tuple[int, int, int, int]]] = [[] for _ in left]
    containers = 0
    while left.any():
        room, uses = window, []
        for length in np.flatnonzero(left)[::-1]:
            run = int(min(left[length], room // length))
            if run:
                uses.append((length, window - room, run))
                room -= run * int(length)
        times = min(int(left[length]) // run for length, _, run in uses)
        for length, offset, run in uses:
            slots[length].append((int(total[length] - left[length]), containers, offset, run))
            left[length] -= times * run
        containers += times
    return slots, containers


class Plan:
    """The whole packing, from the number of full windows and the histograms of middle parts and tails."""

    def __init__(self, full: int, middles: np.ndarray, tails: np.ndarray):
        self.middle, self.tail = Slots(middles, DEPTH), Slots(tails, 3)
        self.middle_base = full
        self.stream_base = full + self.middle.containers
        units = self.middle.left * np.arange(UNITS)
        self.stream_at = np.cumsum(units) - units
        self.bins_at = int(units.sum())
        windows = -(-(self.bins_at + self.tail.containers) // UNITS)
        self.tails_base = self.stream_base + windows
        self.rest, _ = greedy(self.tail.left, WINDOW)


def describe(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Each document's id count and the checksums of its parts; of a middle part also those of its beginnings and ends."""
    memo = bpe.memo(path)
    for batch in batches:
        counts, full, heads, ends, tails = [], [], [], [], []
        for _, _, data, offsets in K.text_chunks(batch.column("text")):
            ids, at = memo.encode(data, offsets)
            ids = np.insert(ids, at[1:], END_ID).astype("<u4")
            at = at + np.arange(len(at))
            raw = memoryview(ids).cast("B")
            for lo, hi in zip(at[:-1] * 4, at[1:] * 4):
                n = (hi - lo) // 4
                counts.append(n)
                middle = lo + n // WINDOW * WINDOW * 4
                tail = lo + n // UNIT * UNIT * 4
                full.append(b"".join(zlib.crc32(raw[i : i + 4 * WINDOW]).to_bytes(4, "little") for i in range(lo, middle, 4 * WINDOW)))
                so_far, up = 0, []
                for i in range(middle, tail, 4 * UNIT):
                    so_far = zlib.crc32(raw[i : i + 4 * UNIT], so_far)
                    up.append(so_far)
                heads.append(np.array(up, "<u4").tobytes())
                ends.append(np.array([zlib.crc32(raw[i:tail]) for i in range(middle, tail, 4 * UNIT)], "<u4").tobytes())
                tails.append(zlib.crc32(raw[tail:hi]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("h"), pa.array(counts, pa.int64()), pa.array(full, pa.binary()), pa.array(heads, pa.binary()), pa.array(ends, pa.binary()), pa.array(tails, pa.int64())],
            names=["doc_id", "h", "n", "full", "heads", "ends", "tail"],
        )


def _ranks(kinds: np.ndarray, base: np.ndarray) -> np.ndarray:
    """base[kind] plus the number of earlier rows of the same kind."""
    order = np.argsort(kinds, kind="stable")
    ordered = kinds[order]
    first = np.searchsorted(ordered, ordered)
    out = np.empty(len(kinds), np.int64)
    out[order] = np.arange(len(kinds)) - first + base[ordered]
    return out


def _pieces(docs: pd.DataFrame, before: pd.DataFrame, plan: Plan) -> pd.DataFrame:
    """The pieces of a bucket's documents; before: how many pieces of each kind earlier buckets hold."""
    docs = docs.sort_values(["h", "n", "tail", "doc_id"], kind="stable", na_position="last")
    n = docs["n"].to_numpy()
    base = {k: np.zeros(UNIT, np.int64) for k in "fmt"}
    for kind, size, count in zip(before["kind"], before["size"], before["before"]):
        base[kind][size] = count
    full, middle, tail = n // WINDOW, n % WINDOW // UNIT, n % UNIT
    crc = lambda name: np.frombuffer(b"".join(docs[name]), "<u4")
    parts = []

    def emit(row, start, length, checks, sequence, offset):
        parts.append(np.stack(np.broadcast_arrays(row, start, length, checks.astype(np.int64), sequence, offset), axis=1))

    row = np.repeat(np.arange(len(n)), full)
    within = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
    emit(row, within * WINDOW, WINDOW, crc("full"), base["f"][0] + np.arange(len(row)), 0)

    heads, ends = crc("heads"), crc("ends")
    crc_at = np.cumsum(middle) - middle
    rank = _ranks(middle, base["m"])
    for size in np.unique(middle[middle > 0]):
        mine = np.flatnonzero(middle == size)
        placed = rank[mine] < plan.middle.used[size]
        if placed.any():
            rows = mine[placed]
            sequence, offset = plan.middle.place(size, rank[rows])
            emit(rows, full[rows] * WINDOW, size * UNIT, ends[crc_at[rows]], plan.middle_base + sequence, offset * UNIT)
        rows = mine[~placed]
        at = plan.stream_at[size] + (rank[rows] - plan.middle.used[size]) * size
        first = np.minimum(size, UNITS - at % UNITS)
        emit(rows, full[rows] * WINDOW, first * UNIT, heads[crc_at[rows] + first - 1], plan.stream_base + at // UNITS, at % UNITS * UNIT)
        cut = first < size
        rows, at, first = rows[cut], at[cut], first[cut]
        emit(rows, full[rows] * WINDOW + first * UNIT, (size - first) * UNIT, ends[crc_at[rows] + first], plan.stream_base + at // UNITS + 1, 0)

    rank, checks = _ranks(tail, base["t"]), docs["tail"].to_numpy()
    for size in np.unique(tail[tail > 0]):
        mine = np.flatnonzero(tail == size)
        placed = rank[mine] < plan.tail.used[size]
        if placed.any():
            rows = mine[placed]
            unit, offset = plan.tail.place(size, rank[rows])
            at = plan.bins_at + unit
            emit(rows, n[rows] - size, size, checks[rows], plan.stream_base + at // UNITS, at % UNITS * UNIT + offset)
        rows = mine[~placed]
        if len(rows):
            rest = rank[rows] - plan.tail.used[size]
            first, container, offset, run = (np.array(c, np.int64) for c in zip(*plan.rest[size]))
            k = np.searchsorted(first, rest, side="right") - 1
            beyond, within = np.divmod(rest - first[k], run[k])
            emit(rows, n[rows] - size, size, checks[rows], plan.tails_base + container[k] + beyond, offset[k] + within * size)
    out = np.concatenate(parts)
    table = pd.DataFrame(out[:, 1:], columns=["start", "length", "ids_crc32", "sequence_id", "offset"])
    table.insert(0, "doc_id", docs["doc_id"].to_numpy()[out[:, 0]])
    table["doc_tokens"] = n[out[:, 0]]
    return table


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, sequence_id, offset, doc_tokens) of all documents.

    path: a tokenizer file that executors can read. Every id lies in one piece, sequences have no gaps and hold at
    most WINDOW ids. Other columns of docs are ignored.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, h long, n long, full binary, heads binary, ends binary, tail long"
    described = written(keyed.mapInArrow(lambda batches: describe(batches, path), schema))
    n_docs = described.count()
    buckets = max(1, math.ceil(n_docs / BUCKET_DOCS))
    described = described.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    kinds = F.expr(
        f"explode(array(named_struct('kind', 'f', 'size', 0, 'n', n div {WINDOW}),"
        f" named_struct('kind', 'm', 'size', cast(n % {WINDOW} div {UNIT} AS int), 'n', 1L),"
        f" named_struct('kind', 't', 'size', cast(n % {UNIT} AS int), 'n', 1L)))"
    )
    counts = described.select("bucket", kinds.alias("k")).groupBy("bucket", "k.kind", "k.size").agg(F.sum("k.n").alias("n"))
    earlier = Window.partitionBy("kind", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = written(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long"))), min(3 * n_docs, buckets * (1 + UNITS + UNIT)))
    totals = {(r.kind, r.size): r.n for r in before.groupBy("kind", "size").agg(F.sum("n").alias("n")).collect()}  # one row a length
    histogram = lambda kind, size: np.array([0] + [totals.get((kind, i), 0) for i in range(1, size)], np.int64)
    plan = Plan(totals.get(("f", 0), 0), histogram("m", UNITS), histogram("t", UNIT))
    out = f"doc_id {id_type}, start long, length long, ids_crc32 long, sequence_id long, offset long, doc_tokens long"
    return (
        described.groupBy("bucket")
        .cogroup(before.groupBy("bucket"))
        .applyInPandas(lambda docs, before: _pieces(docs, before, plan), out)
    )
