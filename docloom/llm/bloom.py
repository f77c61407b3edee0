"""Which 64-bit keys of a table may occur twice, at a cost a key that does not depend on the table's size.

Each task gathers its keys with their rows, FLUSH at a time, and sorts them. Keys go to the owner of their segment,
a range of keys; there are as many segments as it takes for one to hold about SEGMENT_KEYS keys, so an owner's memory is
bounded whatever the input, if keys are spread evenly over 64 bits (callers mix those that are not). A key that a flush holds more than once is known to repeat: its owner gets one head for
all its rows, and the rows themselves are dealt out evenly, so no owner sees more of a hot key than a head a flush.
An owner adds its keys to a pair of Bloom filters sized by their number, one of keys seen once and one of keys seen
twice, and passes on the rows whose key is in the second. Nothing is broadcast and nothing comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from docloom.llm import kernels as K

FLUSH, SEGMENT_KEYS, ADDED = 1 << 19, 1 << 19, 1 << 16
BITS_PER_KEY, PROBES = 12, 4
SINGLE, HEAD, KNOWN = 0, 1, 2
#: Payload columns by kind of number: Arrow type and SQL type. A "near" number is sent as a distance if that fits.
TYPES = {"long": (pa.int64(), "long"), "near": (pa.int32(), "int"), "int": (pa.int32(), "int"), "tiny": (pa.int8(), "tinyint")}

Columns = list[np.ndarray]


class Filters:
    """Once-seen and twice-seen filters for about so many keys."""

    def __init__(self, keys: int):
        self.bits = max(1 << 10, keys * BITS_PER_KEY)
        self.once, self.twice = np.zeros(self.bits // 8 + 1, np.uint8), np.zeros(self.bits // 8 + 1, np.uint8)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        hashes = K.mix(keys)
        step = (hashes >> np.uint64(29)) | np.uint64(1)
        return np.stack([(hashes + np.uint64(i) * step) % np.uint64(self.bits) for i in range(PROBES)], axis=1).astype(np.int64)

    @staticmethod
    def _all_set(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)

    @staticmethod
    def _set(packed: np.ndarray, at: np.ndarray) -> None:
        at = at.ravel()
        np.bitwise_or.at(packed, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))

    def add(self, keys: np.ndarray, known: bool = False) -> None:
        """Adds keys; known ones count as seen twice."""
        for lo in range(0, len(keys), ADDED):
            own, counts = np.unique(keys[lo : lo + ADDED], return_counts=True)
            at = self._places(own)
            self._set(self.twice, at if known else at[(counts > 1) | self._all_set(self.once, at)])
            self._set(self.once, at)

    def repeats(self, keys: np.ndarray) -> np.ndarray:
        return self._all_set(self.twice, self._places(keys))


def _lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values.astype(kind.to_pandas_dtype())))


def dealt(
    rows: DataFrame,
    find: Callable[[pa.RecordBatch], Iterator[Columns]],
    payload: dict[str, str],
    keys: int,
    narrow: bool = False,
    head: Callable[[Columns, np.ndarray], Columns] | None = None,
) -> DataFrame:
    """Packed rows (deal, segment, kind, key, payload) at their owners, in runs of equal deal.

    find gives (uint64 keys, payload columns) for a batch; payload names the columns and their kinds of number; keys is about
    how many keys there are. narrow sends the low 32 bits of keys only. head makes the payload that stands for a run of equal
    keys from the sorted columns and the runs' starts; without it the first row's stands.
    """
    segments = max(1, math.ceil(keys / SEGMENT_KEYS))
    kinds = list(payload.values())
    names = ["deal", "segment", "kind", "key"] + [n + x for n, k in payload.items() for x in (["", "_base", "_wide"] if k == "near" else [""])]

    def packed(columns: Columns, kind: int, salt: int) -> pa.RecordBatch:
        segment = ((columns[0] >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(segment) else np.zeros(0, np.int64)
        cuts = np.append(starts, len(segment))
        own = segment[starts]
        deal = own if kind != KNOWN else -1 - (K.mix(own.astype(np.uint64) + np.uint64(salt)) >> np.uint64(1)).astype(np.int64)
        key = (columns[0] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) if narrow else columns[0].view(np.int64)
        out = [pa.array(deal), pa.array(own, pa.int32()), pa.array(np.full(len(own), kind), pa.int8()), _lists(key, cuts, pa.int32() if narrow else pa.int64())]
        for values, how in zip(columns[1:], kinds):
            if how != "near":
                out.append(_lists(values, cuts, TYPES[how][0]))
                continue
            base = int(values.min()) if len(values) else 0
            fits = not len(values) or int(values.max()) - base < 1 << 31
            none = pa.nulls(len(own), pa.list_(pa.int64() if fits else pa.int32()))
            sent = _lists(values - base if fits else values, cuts, pa.int32() if fits else pa.int64())
            out += [sent if fits else none, pa.array(np.full(len(own), base)), none if fits else sent]
        return pa.RecordBatch.from_arrays(out, names=names)

    def flush(held: list[Columns]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*held)]
        order = np.lexsort((columns[1], columns[0])) if kinds else np.argsort(columns[0], kind="stable")
        columns = [c[order] for c in columns]
        starts = np.flatnonzero(np.r_[True, columns[0][1:] != columns[0][:-1]])
        sizes = np.diff(np.append(starts, len(columns[0])))
        again = np.repeat(sizes > 1, sizes)
        heads = head(columns, starts) if head else [c[starts] for c in columns[1:]]
        salt = int(columns[0][0] ^ columns[0][-1])
        yield packed([c[~again] for c in columns], SINGLE, salt)
        yield packed([columns[0][starts][sizes > 1]] + [c[sizes > 1] for c in heads], HEAD, salt)
        yield packed([c[again] for c in columns], KNOWN, salt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for found in find(batch):
                held.append(found)
                n += len(found[0])
                if n >= FLUSH:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    schema = f"deal long, segment int, kind tinyint, key array<{'int' if narrow else 'long'}>"
    for name, how in payload.items():
        schema += f", {name} array<{TYPES[how][1]}>" + (f", {name}_base long, {name}_wide array<long>" if how == "near" else "")
    return rows.mapInArrow(run, schema).repartition("deal").sortWithinPartitions("deal")


def unpacked(group: pa.Table, payload: dict[str, str]) -> tuple[np.ndarray, Columns]:
    """(segment of each row, [key as stored, payload columns]) of packed rows."""
    flat = lambda name: pc.list_flatten(group.column(name)).to_numpy()
    lengths = pc.list_value_length(group.column("key")).to_numpy()
    out = [flat("key")]
    for name, how in payload.items():
        if how != "near":
            out.append(flat(name))
            continue
        wide = group.column(name + "_wide").is_valid().to_numpy()
        values = np.empty(int(lengths.sum()), np.int64)
        is_wide = np.repeat(wide, lengths)
        values[is_wide] = flat(name + "_wide")
        values[~is_wide] = flat(name) + np.repeat(group.column(name + "_base").to_numpy(), lengths)[~is_wide]
        out.append(values)
    return np.repeat(group.column("segment").to_numpy(), lengths), out


def suspects(rows: DataFrame, find: Callable[[pa.RecordBatch], Iterator[Columns]], payload: dict[str, str], keys: int) -> DataFrame:
    """The rows (key, payload) whose key repeats, and a few more."""
    names = ["key", *payload]
    types = {n: pa.int64() if k == "near" else TYPES[k][0] for n, k in payload.items()}

    def batch_of(columns: Columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[0])] + [pa.array(c, t) for c, t in zip(columns[1:], types.values())], names=names)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in K.grouped(batches, ["deal"]):
            kind = group.column("kind").to_numpy()
            parts = [unpacked(group.filter(pa.array(kind == k)), payload)[1] for k in (SINGLE, HEAD, KNOWN)]
            if len(parts[KNOWN][0]):
                yield batch_of(parts[KNOWN])
            keys = parts[SINGLE][0].view(np.uint64)
            if len(keys):
                filters = Filters(len(keys) + len(parts[HEAD][0]))
                filters.add(keys)
                filters.add(parts[HEAD][0].view(np.uint64), known=True)
                hit = filters.repeats(keys)
                yield batch_of([c[hit] for c in parts[SINGLE]])

    schema = "key long" + "".join(f", {n} {'long' if k == 'near' else TYPES[k][1]}" for n, k in payload.items())
    return dealt(rows, find, payload, keys).mapInArrow(own, schema)
