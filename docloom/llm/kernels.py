"""Vectorised word hashing used inside Arrow tasks.

A batch of texts is one byte buffer with row offsets. Words are hashed eight bytes at a time and n-grams by
doubling, all of a chunk together, with no Python loop over words. Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; UTF-8 never uses those bytes inside
a longer character, so splitting bytes equals splitting code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import secrets

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
#: Texts are hashed in chunks of about so many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply, three rounds)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Spans longer than this many bytes are hashed one by one.
LONG_SPAN = 4096


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of pairs, order counts."""
    return mix((left ^ U(0xA0761D6478BD642F)) * U(0xE7037ED1A0B428DB) + right)


def new_seed() -> int:
    """A seed that the driver draws for a job and hands to its tasks, so that nobody can write words whose hashes meet."""
    return secrets.randbits(64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of byte spans: eight bytes at a time, each step mixed before the next. For a known seed words can be made
    whose hashes meet; for one that was drawn at random they meet by chance alone."""
    left = ends - starts
    out = mix(left.astype(np.uint64) * U(0xD6E8FEB86659FD93) + mix(np.array([seed ^ 1], np.uint64)))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    rows = np.arange(len(starts))
    if left.max(initial=0) > LONG_SPAN:
        for i in np.flatnonzero(left > LONG_SPAN).tolist():
            out[i] ^= U(xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed))
        rows = np.flatnonzero(left <= LONG_SPAN)
    at, left = starts[rows], left[rows]
    while len(rows):
        value = lanes[at]
        tail = np.flatnonzero(left < 8)
        value[tail] &= (U(1) << (left[tail] << 3).astype(np.uint64)) - U(1)
        out[rows] = join_hashes(out[rows], value)
        more = np.flatnonzero(left > 8)
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return out


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows; null counts as the empty text."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = ~IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the offsets of each row's words among them; inside: which bytes words are made of."""
    solid = inside[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = solid
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before[:-1])
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = solid
    after[inner] = False
    ends = np.flatnonzero(solid & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of hashes[i:i+n] for every i with i + n <= len(hashes), by doubling; rows are told apart by the caller."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    have, width, out, done = hashes, 1, None, 0
    while True:
        if n & width:
            out = have if out is None else join_hashes(have[: len(have) - done], out[width:])
            done += width
        if done == n:
            return out[: len(hashes) - n + 1]
        have = join_hashes(have[:-width], have[width:])
        width *= 2


def grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the named columns, of batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        change = np.zeros(batch.num_rows, bool)
        for x in columns:
            change[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(x[lo] for x in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags over each row's range."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of values[s:s+n] over the spans."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return values[shift + np.arange(total)]
