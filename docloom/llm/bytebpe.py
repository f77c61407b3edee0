"""Byte-level BPE by a rank file: encoding with offsets, and decoding.

Pre-tokenisation runs over arrays, without a regular expression. Each code point gets a symbol from its class and its
neighbours: letter, number, other, an apostrophe before a contraction of two or of three characters, white space
inside a run, and the last blank or other white space of a run before something else. A symbol is a function on eight
states (what the open token is); functions compose associatively, and as only a few dozen different ones arise, a scan
works on their numbers with a table of compositions. Lanes of the text are scanned side by side, the lanes' totals by doubling, and
then the state before each code point tells whether a token begins there.

Pre-tokens are merged pair by pair, lowest rank first and leftmost first, and remembered by their bytes (see memo).

Nulls: a null text is empty and has no ids; null ids decode to null bytes. Repeated rows get equal answers. An empty table
gives an empty result. Other columns are kept, whatever their names; the added ones replace columns of the same names.
A text is worked on as a whole, at about 60 bytes for each of its bytes; a pre-token of n bytes takes n log n steps.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docloom.llm import kernels as K
from docloom.llm.memo import SpanMemo

LETTER, NUMBER, OTHER, BLANK, SPACE = range(5)
#: Symbols; those from ROW on are the same at the start of a text.
IN_LETTER, IN_NUMBER, IN_OTHER, TWO, THREE, IN_SPACE, LAST_BLANK, LAST_SPACE, ROW = range(9)
#: Texts are encoded in chunks of about so many bytes, ids decoded so many at a time; a longer text is a chunk of its own.
CHUNK_BYTES, CHUNK_IDS = 1 << 18, 1 << 17
#: States: between tokens, inside a run of one kind, after a blank that the next token takes in, and with characters of a contraction to come.
FRESH, LETTERS, NUMBERS, OTHERS, SPACES, TAKEN, ONE_MORE, TWO_MORE = range(8)


@functools.cache
def class_table() -> np.ndarray:
    """The class of every code point, by the Unicode tables of the library whose results are to be met."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        for lo in range(0, 0x110000, 0x800):
            if not 0xD800 <= lo < 0xE000:
                found = bytes(probe.encode_ordinary("".join(map(chr, range(lo, lo + 0x800)))))
                table[[ord(c) for c in found.decode()]] = kind
    table[0x20] = BLANK
    return table


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a symbol, and whether a token starts with it."""
    if symbol >= ROW:
        return step(FRESH, symbol - ROW)
    if symbol == IN_LETTER:
        if state in (ONE_MORE, TWO_MORE):
            return state - 1 if state == TWO_MORE else FRESH, False
        return LETTERS, state not in (LETTERS, TAKEN)
    if symbol == IN_NUMBER:
        return NUMBERS, state not in (NUMBERS, TAKEN)
    if symbol in (IN_OTHER, TWO, THREE):
        if state in (OTHERS, TAKEN):
            return OTHERS, False
        return {IN_OTHER: OTHERS, TWO: ONE_MORE, THREE: TWO_MORE}[symbol], True
    if symbol == IN_SPACE:
        return SPACES, state != SPACES
    return TAKEN if symbol == LAST_BLANK else FRESH, True


class Scanner:
    """The functions that arise from symbols, their compositions, and scans over them."""

    def __init__(self):
        symbols = range(2 * ROW)
        generators = [tuple(step(s, x)[0] for s in range(8)) for x in symbols]
        found = list(dict.fromkeys(generators))
        number = {f: i for i, f in enumerate(found)}
        for f in found:  # grows while it is read, until it is closed under composition
            for g in generators:
                both = tuple(g[s] for s in f)
                if both not in number:
                    number[both] = len(found)
                    found.append(both)
        self.apply = np.array(found, np.uint8)
        self.size = len(found)
        self.of_symbol = np.array([number[g] for g in generators], np.int64)
        self.compose = np.array([[number[tuple(g[s] for s in f)] for g in found] for f in found], np.int64).ravel()
        self.starts = np.array([[step(s, x)[1] for x in symbols] for s in range(8)])

    def after(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        return self.compose[first * self.size + then]

    def token_starts(self, symbols: np.ndarray) -> np.ndarray:
        """For each symbol whether a token starts with it."""
        n = len(symbols)
        if not n:
            return np.zeros(0, bool)
        deep = max(1, int(n**0.5))
        lanes = -(-n // deep)
        padded = np.full(lanes * deep, IN_SPACE, np.uint8)
        padded[:n] = symbols
        upto = np.ascontiguousarray(self.of_symbol[padded].reshape(lanes, deep).T)
        for k in range(1, deep):
            upto[k] = self.after(upto[k - 1], upto[k])
        total, have = upto[-1].copy(), 1
        while have < lanes:
            total[have:] = self.after(total[:-have], total[have:])
            have *= 2
        begin = np.full(lanes, FRESH, np.uint8)
        begin[1:] = self.apply[total[:-1], FRESH]
        before = np.empty((deep, lanes), np.uint8)
        before[0] = begin
        before[1:] = self.apply[upto[:-1], begin]
        return self.starts[before.T.ravel()[:n], symbols]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte places, code points) of UTF-8 text; a row always begins a code point."""
    if not len(data) or data.max() < 0x80:
        return np.arange(len(data)), data.astype(np.int32)
    lead = (data & 0xC0) != 0x80
    lead[offsets[offsets < len(data)]] = True
    at = np.flatnonzero(lead)
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    points = padded[at]
    for least, most, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        i = np.flatnonzero((data[at] >= least) & (data[at] < most))
        value = points[i] & mask
        for k in range(1, more + 1):
            value = value << 6 | padded[at[i] + k] & 0x3F
        points[i] = np.minimum(value, 0x10FFFF)
    return at, points


def symbols(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The symbols of code points; rows are the texts' offsets among them."""
    n = len(points)
    kind = class_table()[points]
    first = np.zeros(n + 2, bool)
    first[rows[rows < n]] = True
    first[n:] = True
    space = kind >= BLANK
    last = space.copy()
    last[:-1] &= ~space[1:] & ~first[1:n]
    last[-1:] = False
    out = np.where(space, IN_SPACE, kind)
    out[last] = np.where(kind[last] == BLANK, LAST_BLANK, LAST_SPACE)
    at = np.flatnonzero(points == ord("'"))
    padded = np.concatenate([points, np.zeros(2, points.dtype)])
    one, two = np.where(first[at + 1], 0, padded[at + 1]), np.where(first[at + 1] | first[at + 2], 0, padded[at + 2])
    out[at[np.isin(one, [ord(c) for c in "stmd"])]] = TWO
    pairs = [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")]
    out[at[(one < 128) & (two < 128) & np.isin(one << 8 | two, pairs)]] = THREE
    out[first[:n]] += ROW
    return out.astype(np.uint8)


class Coder:
    """A rank file's vocabulary with a memo of pre-tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    @functools.cached_property
    def scanner(self) -> Scanner:
        return Scanner()

    @functools.cached_property
    def memo(self) -> SpanMemo:
        return SpanMemo(self.merged)

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a pre-token: adjacent parts are merged by lowest rank, leftmost first, while any pair has one."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n))  # a part's end is the next part's start
        heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if middle < 0 or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, -1
            if stop < n:
                before[stop] = i
                further = end[stop]
                if (rank := ranks.get(piece[i:further])) is not None:
                    heapq.heappush(heap, (rank, i, further))
            if (p := before[i]) >= 0 and (rank := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (rank, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all rows, bytes before each id in its row, the rows' offsets among the ids)."""
        at, points = code_points(data, offsets)
        starts = at[self.scanner.token_starts(symbols(points, np.searchsorted(at, offsets)))]
        places, counts = self.memo.lookup(data, starts, np.append(starts[1:], len(data)))
        ids = K.ragged(self.memo.values, places, counts)
        sums = np.concatenate([[0], np.cumsum(counts)])
        rows = sums[np.searchsorted(starts, offsets)]
        sizes = self.lengths[ids]
        return ids, np.cumsum(sizes) - sizes - np.repeat(offsets[:-1], np.diff(rows)), rows

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids one after another, each id's number of bytes)."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.tokens) and self.lengths[ids].min() > 0):
            raise ValueError("ids that are not in the vocabulary")
        return K.ragged(self.bytes, self.begins[ids], self.lengths[ids]), self.lengths[ids]


@functools.cache
def coder(path: str) -> Coder:
    """This worker's coder for a rank file; later tasks of the worker go on with it."""
    return Coder(path)


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with ids (array of int) and offsets (array of int: the bytes of the text before each id).

    path: a rank file that executors can read, of lines with a token in base64 and its rank.
    """
    given = [c for c in docs.columns if c not in ("ids", "offsets")]
    schema = T.StructType(docs.select(*given).schema.fields).add("ids", T.ArrayType(T.IntegerType())).add("offsets", T.ArrayType(T.IntegerType()))
    at = given.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            for lo, hi, data, offsets in K.text_chunks(batch.column(at), CHUNK_BYTES):
                ids, places, rows = own.encode(data, offsets)
                lists = [pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(x.astype(np.int32))) for x in (ids, places)]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *lists], names=schema.names)

    return docs.select(*given).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the bytes of its ids in out_col (binary). Ids outside the vocabulary, and null ones, are errors."""
    given = [c for c in encoded.columns if c != out_col]
    schema = T.StructType(encoded.select(*given).schema.fields).add(out_col, "binary")
    at = given.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for whole in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(whole.column(at)), 0).to_numpy(zero_copy_only=False))
            row = 0
            while row < whole.num_rows:
                upto = (ends[row - 1] if row else 0) + CHUNK_IDS
                stop = max(row + 1, int(np.searchsorted(ends, upto, side="right")))
                batch = whole.slice(row, stop - row)
                row = stop
                column = batch.column(at)
                ids = column.flatten()
                if ids.null_count:
                    raise ValueError("ids that are null")
                data, sizes = own.decode(ids.to_numpy(zero_copy_only=False).astype(np.int64))
                counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                cuts = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
                buffers = [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
                out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), buffers).cast(pa.binary())
                out = pc.if_else(column.is_valid(), out, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([*batch.columns, out], names=schema.names)

    return encoded.select(*given).mapInArrow(run, schema)
