"""Language identification of mixed text, by spans.

A word's script, that of its first letter, narrows the languages it can be in; its byte trigrams and
tetragrams, hashed into tables learned from labelled documents, score each of those; Viterbi with a penalty for
every switch labels the words, and runs of one label are spans. A document's language is the label of most of its
words that have letters, and its score their share. All documents of a chunk go through Viterbi together, a step
for each place in the longest.

The model is fitted on a sample of about SAMPLE_DOCS documents a language, chosen by a hash of the id; everything
else covers all documents. Only text and language are learned from.

Nulls: a null text, or one without a letter, is `und` with score 0, as is every text if there is nothing to learn
from. Rows without a language, a text or an id are not learned from. Repeated rows get equal answers. Languages that
tie go by the number of grams they were learned from, then by name. An empty table gives an empty result. Other columns are
kept, whatever their names. A text is scored as a whole, at about 60 bytes for each of its own.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import kernels as K

SAMPLE_DOCS, SLOTS, SWITCH, TEMPER, RARE_SCRIPT, RULED_OUT = 3000, 1 << 15, 6.0, 0.5, 0.002, -30.0
CHUNK_BYTES = 2 << 20
UNKNOWN = "und"
#: The first code point of each range and the script of its letters ("" where there are hardly any).
RANGES = [
    (0x00, ""), (0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xAA, "latin"), (0xAB, ""), (0xB5, "latin"),
    (0xB6, ""), (0xBA, "latin"), (0xBB, ""), (0xC0, "latin"), (0xD7, ""), (0xD8, "latin"), (0xF7, ""), (0xF8, "latin"),
    (0x2B0, "other"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"),
    (0x700, "other"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "indic"), (0xE00, "thai"), (0xE80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""),
    (0x2C00, "other"), (0x3000, ""), (0x3005, "han"), (0x3007, ""), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, ""), (0xF900, "han"), (0xFB00, "other"),
    (0xFE00, ""), (0xFE70, "arabic"), (0xFF00, ""), (0xFF21, "latin"), (0xFF5B, ""), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, ""), (0x10000, "other"),
]
SCRIPTS = sorted({s for _, s in RANGES})
NO_SCRIPT = SCRIPTS.index("")
#: The script of each code point. What is no letter, such as marks, digits and emoji inside a range, has none.
_SCRIPT_OF = np.repeat(np.array([SCRIPTS.index(s or "other") for _, s in RANGES], np.int8), np.diff([a for a, _ in RANGES] + [sys.maxunicode + 1]))
_SCRIPT_OF[~np.fromiter(map(str.isalpha, map(chr, range(sys.maxunicode + 1))), bool)] = NO_SCRIPT


def code_points(data: np.ndarray) -> np.ndarray:
    """The code point that starts at each byte, or -1 at continuation bytes."""
    b = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    first, low = b[:-3], [b[k : len(data) + k] & 0x3F for k in (1, 2, 3)]
    two = (first & 0x1F) << 6 | low[0]
    three = (first & 0x0F) << 12 | low[0] << 6 | low[1]
    four = (first & 0x07) << 18 | low[0] << 12 | low[1] << 6 | low[2]
    return np.select([first < 0x80, first < 0xC0, first < 0xE0, first < 0xF0], [first, -1, two, three], four)


class Scored:
    """Words of a chunk: their scripts and the table slots of their byte n-grams."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.at = K.words(data, offsets)
        lower = K.LOWER[data]
        script = np.full(len(data), NO_SCRIPT, np.int8)
        points = code_points(data)
        real = points >= 0
        script[real] = _SCRIPT_OF[points[real]]
        letters = np.append(np.flatnonzero(script != NO_SCRIPT), len(data))
        first = letters[np.searchsorted(letters, self.starts)]
        self.script = np.where(first < self.ends, script[np.minimum(first, max(len(data) - 1, 0))] if len(data) else NO_SCRIPT, NO_SCRIPT)
        # Each word between blanks: position p of word w in the text is p + 2w + 1 in the padded bytes.
        lengths = self.ends - self.starts
        self.offsets = np.concatenate([[0], np.cumsum(lengths + 2)])
        padded = np.full(int(self.offsets[-1]) + 3, 0x20, np.uint32)
        word = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(int(lengths.sum())) + 2 * word + 1
        padded[place] = K.ragged(lower, self.starts, lengths)
        b = [padded[k : len(padded) - 3 + k] for k in range(4)]
        three = b[0] << np.uint32(16) ^ b[1] << np.uint32(8) ^ b[2]
        self.grams = [(x * np.uint32(0x9E3779B1) >> np.uint32(17)).astype(np.int32) for x in (three, three * np.uint32(0x85EBCA6B) + b[3])]
        # A gram counts if it starts in a word's own padding or letters and does not run past the closing blank.
        left = self.offsets[1:][np.repeat(np.arange(len(lengths)), lengths + 2)] - np.arange(int(self.offsets[-1]))
        self.inside = [left >= 3, left >= 4]

    def word_scores(self, tables: list[np.ndarray]) -> np.ndarray:
        """Sums of table rows over each word's grams."""
        out = np.zeros((len(self.starts), tables[0].shape[1]), np.float32)
        if len(out):
            for slots, inside, table in zip(self.grams, self.inside, tables):
                rows = table[np.where(inside, slots, SLOTS)]
                out += np.add.reduceat(rows, self.offsets[:-1], axis=0)
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each language its gram counts and script counts in this task's documents, as one packed array."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lang in set(langs):
            own = pa.array(np.flatnonzero([x == lang for x in langs]))
            sums = totals.setdefault(lang, np.zeros(2 * SLOTS + len(SCRIPTS), np.int64))
            for _, _, data, offsets in K.text_chunks(batch.column("text").take(own)):
                scored = Scored(data, offsets)
                for k in (0, 1):
                    sums[k * SLOTS : (k + 1) * SLOTS] += np.bincount(scored.grams[k][scored.inside[k]], minlength=SLOTS)
                sums[2 * SLOTS :] += np.bincount(scored.script, minlength=len(SCRIPTS))
    if totals:
        yield pa.RecordBatch.from_pydict({"lang": list(totals), "counts": [zlib.compress(x.tobytes(), 1) for x in totals.values()]})


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, packed in zip(*(c.to_pylist() for c in batch.columns)):
            counts = np.frombuffer(zlib.decompress(packed), np.int64)
            totals[lang] = totals[lang] + counts if lang in totals else counts
    for lang, counts in totals.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang], "counts": [zlib.compress(counts.tobytes(), 1)]})


class Model:
    """Log-likelihood tables of the learned languages, the most frequent first."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts, key=lambda x: (-counts[x].sum(), x))
        if not self.langs:
            return
        sums = np.stack([counts[x] for x in self.langs], axis=1).astype(np.float64)
        self.tables = []
        for k in (0, 1):
            c = sums[k * SLOTS : (k + 1) * SLOTS] + 0.1
            log = np.log(c / c.sum(axis=0))
            log -= log.mean(axis=1, keepdims=True)
            self.tables.append((TEMPER * np.vstack([log, np.zeros((1, log.shape[1]))])).astype(np.float32))
        scripts = sums[2 * SLOTS :]
        allowed = scripts >= RARE_SCRIPT * scripts.sum(axis=0)
        allowed[NO_SCRIPT] = True
        allowed[~allowed.any(axis=1)] = True
        self.by_script = np.where(allowed, 0.0, RULED_OUT).astype(np.float32)

    def scores(self, scored: Scored) -> np.ndarray:
        out = scored.word_scores(self.tables)
        out[scored.script == NO_SCRIPT] = 0
        return out + self.by_script[scored.script]


def viterbi(scores: np.ndarray, at: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word; rows are the word ranges given by at, all rows step by step together."""
    lengths = np.diff(at)
    order = np.argsort(-lengths, kind="stable")
    first, lengths = at[:-1][order], lengths[order]
    steps = int(lengths.max(initial=0))
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    n = scores.shape[1]
    from_best = np.zeros(len(scores), np.int32)
    switched = np.zeros((len(scores), n), bool)
    best = np.zeros((len(lengths), n), np.float64)
    for t in range(steps):
        k = active[t]
        place = first[:k] + t
        now = best[:k]
        if t:
            top = now.argmax(axis=1)
            floor = now[np.arange(k), top][:, None] - switch
            from_best[place] = top
            switched[place] = now < floor
            now = np.maximum(now, floor)
        best[:k] = now + scores[place]
    labels = np.zeros(len(scores), np.int32)
    state = best.argmax(axis=1) if len(best) else np.zeros(0, np.int64)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        place = first[:k] + t
        labels[place] = state[:k]
        state[:k] = np.where(switched[place, state[:k]], from_best[place], state[:k])
    return labels


def in_training(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4 != 2


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learns from documents that in_training picks; about sample_docs of each language, whole texts."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    rows = rows.filter(in_training("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row a language
    if not counts:
        return Model({})
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, sample_docs / r.n)])
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("id")), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.filter(draw < share[F.col("lang")]).select("lang", "text")
    sums = sample.mapInArrow(_count, "lang string, counts binary").repartition("lang").mapInArrow(_add, "lang string, counts binary")
    return Model({r.lang: np.frombuffer(zlib.decompress(bytes(r.counts)), np.int64) for r in sums.collect()})  # a row a language


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))


def identify(docs: DataFrame, model: Model, text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """docs with lang_pred, score and spans (start, end in words, lang), which replace columns of the same names."""
    given = [c for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    schema = T.StructType(docs.select(*given).schema.fields).add("lang_pred", "string").add("score", "double").add("spans", SPANS)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = given.index(text_col)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def label(data: np.ndarray, offsets: np.ndarray) -> tuple[list, list, list]:
        model = sent.value
        scored = Scored(data, offsets)
        labels = viterbi(model.scores(scored), scored.at, switch)
        lettered = scored.script != NO_SCRIPT
        rows, n = len(offsets) - 1, len(model.langs)
        row = np.repeat(np.arange(rows), np.diff(scored.at))
        votes = np.bincount(row[lettered] * n + labels[lettered], minlength=rows * n).reshape(rows, n)
        langs, shares, spans = [], [], []
        change = np.flatnonzero(np.diff(labels)) + 1
        for i in range(rows):
            total = int(votes[i].sum())
            a, b = int(scored.at[i]), int(scored.at[i + 1])
            if not total:
                langs.append(UNKNOWN)
                shares.append(0.0)
                spans.append([])
                continue
            top = int(votes[i].argmax())
            langs.append(model.langs[top])
            shares.append(float(votes[i][top]) / total)
            cuts = [a, *change[np.searchsorted(change, a, "right") : np.searchsorted(change, b, "left")].tolist(), b]
            spans.append([{"start": x - a, "end": y - a, "lang": model.langs[labels[x]]} for x, y in zip(cuts, cuts[1:])])
        return langs, shares, spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, shares, spans = [], [], []
            if not sent.value.langs:
                langs, shares, spans = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows, [[]] * batch.num_rows
            else:
                for _, _, data, offsets in K.text_chunks(batch.column(at), CHUNK_BYTES):
                    for total, part in zip((langs, shares, spans), label(data, offsets)):
                        total += part
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, span_type)], names=schema.names)

    return docs.select(*given).mapInArrow(run, schema)
