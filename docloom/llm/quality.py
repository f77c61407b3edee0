"""Quality rules with adaptive thresholds.

Each document gets counts from one pass over its text. From them come five metrics, whose distribution in each
(language, source) group is summarised by a quantile sketch: logarithmic buckets of relative width GAMMA with
their counts. Sketches merge by adding counts, in any order and exactly, so the sketch of a language or of
everything is the sum of its groups' sketches. A group's sketch is blended with its language's, which weighs as much as
OF_LANGUAGE documents, and with everyone's, which weighs as much as OF_ALL: small groups lean on those, large ones stand alone,
and there is no size at which that changes at once. A metric's upper fence is the median plus REACH times the distance to the
80 % quantile, its lower fence the median minus REACH times that to the 20 % quantile; a fifth of a group may be junk before a
fence moves. The distances are at least a bucket's width. A document fails if a count is beyond what its fence allows for its length by more
than one and NOISE times that allowance's square root, the chance variation of a count, which matters in short texts only.

Nulls: a null text has no words and fails the base rules; null languages and sources are groups of their own. An
empty table gives an empty result. Repeated rows are judged alike. Ties at a quantile take the lower bucket. Other columns are
kept, whatever their names. A text is measured as a whole, at about 60 bytes for each of its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import kernels as K
from docloom.sources.store import written

GAMMA, REACH, NOISE, ZERO_BUCKET = 1.02, 6.0, 2.0, -(1 << 20)
OF_LANGUAGE, OF_ALL = 50, 10
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_top", "n_distinct", "n_stutters")
#: Metric -> (numerator, denominator, whether low values fail, whether high ones do). Marks are ASCII punctuation and symbols,
#: n_top is how often the most frequent word stands there.
METRICS = {
    "marks": ("n_marks", "word_chars", False, True),
    "common": ("n_top", "n_words", False, True),
    "distinct": ("n_distinct", "n_words", True, False),
    "stutter": ("n_stutters", "n_words", False, True),
    "word_length": ("word_chars", "n_words", True, True),
}
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def _first_seen(keys: np.ndarray) -> np.ndarray:
    """For each key whether it stands there for the first time."""
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    return first


def measure_chunk(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """MEASURES of each row of a chunk. Lines and windows are compared by 64-bit hashes, row by row."""
    rows = len(offsets) - 1
    salt = K.mix(np.arange(1, rows + 1, dtype=np.uint64))
    starts, ends, at = K.words(data, offsets)
    counts = np.diff(at)
    solid = ~K.IS_SPACE[data]
    chars = K.per_row(solid & (data & 0xC0 != 0x80), offsets)
    symbols = K.per_row(_IS_SYMBOL[data], offsets)

    row_of = np.repeat(np.arange(rows), counts)
    hashes = K.span_hashes(data, starts, ends, seed)
    _, first, times = np.unique(K.mix(hashes ^ salt[row_of]), return_index=True, return_counts=True)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row_of[1:] == row_of[:-1])
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, row_of[first], times)
    distinct = np.bincount(row_of[first], minlength=rows)
    windows = K.gram_hashes(hashes, REPEAT_WINDOW)
    own = np.flatnonzero(np.arange(len(windows)) + REPEAT_WINDOW <= at[1:][row_of[: len(windows)]])
    _, back, times = np.unique(K.mix(windows[own] ^ salt[row_of[own]]), return_inverse=True, return_counts=True)
    twice = own[times[back] > 1]
    edges = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + REPEAT_WINDOW, -1)
    repeats = K.per_row(np.cumsum(edges)[:-1] > 0, at)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    line_row = np.repeat(np.arange(rows), K.per_row(data == 10, offsets) + 1)
    filled = np.concatenate([[0], np.cumsum(solid)])
    filled = filled[line_ends] > filled[line_starts]
    keys = K.mix(K.span_hashes(data, line_starts[filled], line_ends[filled], seed) ^ salt[line_row[filled]])
    dups = np.bincount(line_row[filled][~_first_seen(keys)], minlength=rows)
    return [counts, chars, symbols, dups, repeats, K.per_row(_IS_MARK[data], offsets), top, distinct, K.per_row(same, at)]


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the MEASURES columns (long), which replace columns of the same names."""
    kept = [c for c in docs.columns if c not in MEASURES]
    schema = T.StructType(docs.select(*kept).schema.fields)
    for name in MEASURES:
        schema = schema.add(name, "long")
    at, seed = kept.index(text_col), K.new_seed()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure_chunk(data, offsets, seed) for _, _, data, offsets in K.text_chunks(batch.column(at))]
            found = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts)] or [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=schema.names)

    return docs.select(*kept).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def metric(name: str) -> Column:
    top, bottom, *_ = METRICS[name]
    return F.when(F.col(bottom) > 0, F.col(top).cast("double") / F.col(bottom)).otherwise(0.0)


def sketches(measured: DataFrame) -> DataFrame:
    """Rows (lang, source, metric, bucket, n) over the documents that pass the base rules."""
    pairs = F.explode(F.create_map(*[x for m in METRICS for x in (F.lit(m), metric(m))])).alias("metric", "x")
    rows = measured.filter(~base_failed()).select("lang", "source", pairs)
    bucket = F.when(F.col("x") > 0, F.ceil(F.ln("x") / math.log(GAMMA))).otherwise(ZERO_BUCKET)
    return rows.groupBy("lang", "source", "metric", bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def blended(sketch: DataFrame) -> DataFrame:
    """Rows (lang, source, metric, bucket, w): each group's sketch with its language's and everyone's. Weights are whole numbers,
    the blend times the documents of the language times all documents."""
    whole = lambda c: c.cast("decimal(38,0)")
    of = lambda keys, n: sketch.groupBy(*keys, "metric").agg(F.sum("n").alias(n))
    groups = sketch.select("lang", "source", "metric").distinct()
    groups = groups.join(of(["lang"], "n_lang").withColumnsRenamed({"lang": "l", "metric": "m"}), F.col("lang").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("m"))).drop("l", "m")
    groups = groups.join(of([], "n_all"), "metric").select(F.struct("lang", "source").alias("of"), "lang", "metric", whole(F.col("n_lang")).alias("n_lang"), whole(F.col("n_all")).alias("n_all"))
    by_lang = sketch.groupBy(F.col("lang").alias("l"), F.col("metric").alias("m"), "bucket").agg(F.sum("n").alias("n"))
    overall = sketch.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    own = sketch.select(F.struct("lang", "source").alias("o"), F.col("metric").alias("m"), "bucket", "n")
    n = whole(F.col("n"))
    parts = [
        groups.join(own, F.col("of").eqNullSafe(F.col("o")) & (F.col("metric") == F.col("m"))).select("of", "metric", "bucket", (n * F.col("n_lang") * F.col("n_all")).alias("w")),
        groups.join(by_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("m"))).select("of", "metric", "bucket", (n * F.lit(OF_LANGUAGE) * F.col("n_all")).alias("w")),
        groups.join(overall, "metric").select("of", "metric", "bucket", (n * F.lit(OF_ALL) * F.col("n_lang")).alias("w")),
    ]
    weights = parts[0].union(parts[1]).union(parts[2])
    return weights.groupBy("of", "metric", "bucket").agg(F.sum("w").alias("w"))


def fences(blend: DataFrame) -> DataFrame:
    """Rows (of, metric, low, high) from a blend's cumulated weights."""
    place = Window.partitionBy("of", "metric")
    upto = F.sum("w").over(place.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    placed = blend.withColumn("upto", upto).withColumn("total", F.sum("w").over(place))
    value = lambda b: F.when(b == ZERO_BUCKET, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), b) / (GAMMA + 1))
    quantile = lambda q: value(F.min(F.when(F.col("upto") * 10 >= F.col("total") * q, F.col("bucket"))))
    least = F.col("mid") * (GAMMA - 1)
    return (
        placed.groupBy("of", "metric")
        .agg(quantile(2).alias("under"), quantile(5).alias("mid"), quantile(8).alias("over"))
        .select("of", "metric", (F.col("mid") - REACH * F.greatest(F.col("mid") - F.col("under"), least)).alias("low"), (F.col("mid") + REACH * F.greatest(F.col("over") - F.col("mid"), least)).alias("high"))
    )


def thresholds(measured: DataFrame) -> DataFrame:
    """Rows (of, fences) for every (language, source) group that has a document; fences holds <metric>_low and <metric>_high."""
    wide = [F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{m}_{side}") for m in METRICS for side in ("low", "high")]
    sketch = written(sketches(measured), measured.count() * len(METRICS))
    limits = fences(blended(sketch)).groupBy("of").agg(*wide)
    return written(limits.select("of", F.struct(*[f"{m}_{side}" for m in METRICS for side in ("low", "high")]).alias("fences")), sketch.count())


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """measured with base_failed and kept, which replace columns of the same names."""
    beyond = F.lit(False)
    for m, (top, bottom, low, high) in METRICS.items():
        count, of = F.col(f"given.{top}"), F.col(f"given.{bottom}")
        most, least = F.col(f"fences.{m}_high") * of, F.greatest(F.col(f"fences.{m}_low") * of, F.lit(0.0))
        noise = lambda x: 1 + NOISE * F.sqrt(F.greatest(x, F.lit(1.0)))
        if high:
            beyond = beyond | F.coalesce(count > most + noise(most), F.lit(False))
        if low:
            beyond = beyond | F.coalesce(count < least - noise(least), F.lit(False))
    columns = [c for c in measured.columns if c not in ("base_failed", "kept")]
    rows = measured.select(F.struct(*columns).alias("given"), F.struct("lang", "source").alias("group"), base_failed().alias("base_failed"))
    joined = rows.join(limits, F.col("group").eqNullSafe(F.col("of")), "left")
    return joined.select("given.*", "base_failed", (~F.col("base_failed") & ~beyond).alias("kept"))
