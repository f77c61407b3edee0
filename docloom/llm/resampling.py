"""Importance resampling towards a target distribution of words and word pairs.

Features are runs of one and of two consecutive words, hashed to BUCKETS buckets by CRC-32. Two arrays of bucket counts, one of all
documents and one of the target, give an array of gains; a document's weight is the floored mean of its features' gains, all
read from that array. The score adds Gumbel noise that depends on the id alone, so the documents with the highest scores are a draw
without replacement by weight, and reruns agree. Ranks come from a distributed radix sort by score and id (see radix).

Nulls: a null text has no words; a null id is hashed as the empty string and comes after all others. Rows that share an id
are documents of their own, with equal noise; rows with equal scores and ids are ranked in the order in which they are read. An
empty table gives an empty result, and an empty target equal weights up to the buckets' counts. Other columns do not matter,
whatever their names. A text is worked on as a whole, at about 150 bytes for each of its words. What goes to the driver
and to all tasks is BUCKETS numbers.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import kernels as K
from docloom.llm.radix import radix_ranks
from docloom.sources.store import written

BUCKETS = 10_000
#: Words longer than this many bytes are hashed one by one.
LONG_WORD = 64
#: Bytes of words once A-Z are in lower case: digits, letters and all bytes of characters outside ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@functools.cache
def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of byte spans, each as the continuation of a text with the CRC before."""
    table = crc_table()
    out = np.zeros(len(starts), np.uint32) if before is None else before.copy()
    left = ends - starts
    long = np.flatnonzero(left > LONG_WORD)
    for i in long.tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(out[i]))
    rows = np.flatnonzero((left > 0) & (left <= LONG_WORD))
    at, left, state = starts[rows], left[rows], ~out[rows]
    while len(rows):
        state = table[(state ^ data[at]) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
        more = left > 1
        if not more.all():
            out[rows[~more]] = ~state[~more]
            rows, at, left, state = rows[more], at[more], left[more], state[more]
        at, left = at + 1, left - 1
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words in each row, buckets of all words, buckets of all pairs, the rows' offsets among the pairs)."""
    data = K.LOWER[data]
    starts, ends, rows = K.words(data, offsets, INSIDE)
    single = crcs(data, starts, ends)
    inner = np.ones(len(starts), bool)  # words with a next one in their row
    inner[rows[1:][rows[1:] > rows[:-1]] - 1] = False
    first = np.flatnonzero(inner)
    table = crc_table()
    blank = ~single[first]
    blank = ~(table[(blank ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (blank >> np.uint32(8)))
    double = crcs(data, starts[first + 1], ends[first + 1], blank)
    buckets = np.uint32(BUCKETS)
    return np.diff(rows), (single % buckets).astype(np.int64), (double % buckets).astype(np.int64), np.searchsorted(first, rows)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often the features of all texts (column text) fall into each bucket. A task sends one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, offsets in K.text_chunks(batch.column(0)):
                _, single, double, _ = features(data, offsets)
                counts += np.bincount(single, minlength=BUCKETS) + np.bincount(double, minlength=BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])

    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the logarithm of smoothed shares, target against own."""
    own_all, target_all = float(own.sum()), float(target.sum())
    ratio = (target + 1.0) * (own_all + BUCKETS) / ((own + 1.0) * (target_all + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """Rows (id, n_words, n_features, weight) of docs (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros((3, 0), np.int64)]
            for _, _, data, offsets in K.text_chunks(batch.column(1)):
                n, single, double, pairs = features(data, offsets)
                words = np.concatenate([[0], np.cumsum(n)])
                total = n + np.diff(pairs)
                weight = K.per_row(gain[single], words) + K.per_row(gain[double], pairs)
                parts.append(np.stack([n, total, np.where(total > 0, weight // np.maximum(total, 1), 0)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, np.concatenate(parts, axis=1))], names=["id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, "id long, n_words long, n_features long, weight long")


def noise(id_column: Column, seed: int) -> Column:
    """Gumbel noise in floored thousandths, from the first 32 bits of SHA-256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0)))).cast("long")


def id_keys(low: int | None, high: int | None) -> list[tuple[Column, int]]:
    """Sort keys of column id between low and high, null last."""
    low, high = low or 0, high or 0
    if high - low < 1 << 61:
        return [(F.coalesce(F.col("id") - low, F.lit(high - low + 1)), (high - low + 1).bit_length())]
    upper = F.coalesce(F.shiftright("id", 32) + (1 << 31), F.lit(1 << 32))
    return [(upper, 33), (F.coalesce(F.col("id").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(0)), 32)]


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 25, min_words: int = 20, seed: int = 7) -> DataFrame:
    """Per document: id_col, n_words, n_features, weight, score and rank (long). Of the N documents with at least min_words words the
    floor(percent * N / 100) with the highest scores are drawn and ranked, ties to the smaller id; rank is null for all others.

    target: a table with a column text.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    gain = gains(bucket_counts(texts), bucket_counts(target))
    scored = written(weighed(texts, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    able = F.col("n_words") >= min_words
    n, top, bottom, low, high = scored.filter(able).agg(F.count("*"), F.max("score"), F.min("score"), F.min("id"), F.max("id")).first()
    falling = (F.lit(top or 0) - F.col("score"), ((top or 0) - (bottom or 0)).bit_length())
    ranked = radix_ranks(scored.filter(able), [falling, *id_keys(low, high)])
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).withColumnRenamed("id", id_col)
