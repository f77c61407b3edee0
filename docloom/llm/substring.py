"""Substring dedup with suffix automata of reference shards.

A window is `window` consecutive words. To compare windows everywhere without shuffling them all, each window has
an anchor: the leftmost smallest hash among its GRAM-word grams. Equal windows have equal anchors at equal places,
and neighbouring windows share theirs, so a document has one anchor for many windows: the anchor's context is all
words of the windows that share it. Anchors that may repeat are found by the owners of their segments (see bloom);
contexts are then compared anchor by anchor, which is how the corpus is cut into reference shards.

Where an anchor has one context only, that context repeats as a whole. Otherwise its different contexts, each
with how often it occurs, are built into one suffix automaton, which is sent to the task that streams the
contexts through it: for each end of a prefix, matching statistics give the longest suffix that occurs twice, and
where it is at least a window long its words are covered. Anchors with more than MOST_CONTEXTS different contexts
would make automata without bound; those of their windows that may repeat are counted by hash instead,
pre-aggregated.

Words and windows are compared by 64-bit hashes with a seed that is drawn for each job. Nulls: a null text has no words; null ids are kept. Rows that
share an id are documents of their own, told apart by a 64-bit hash of their texts; equal rows count as occurrences of
their own. An empty table gives an empty result. Other columns are kept, whatever their names. A text is hashed as a
whole, at about 100 bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import kernels as K
from docloom.llm.bloom import suspects
from docloom.sources.store import written

GRAM, MOST_CONTEXTS = 8, 400
LAST_ID = (1 << 63) - 1
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the first place of the smallest of values[i:i+width]."""
    best = np.arange(len(values))
    have = 1
    while have < width:
        step = min(have, width - have)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        have += step
    return best


class Words:
    """Word hashes of a chunk of texts and the offsets of its rows among them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seed: int = 0):
        self.starts, self.ends, self.at = K.words(data, offsets)
        self.hashes = K.span_hashes(data, self.starts, self.ends, seed)


def anchors(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """(row, first window start in the row, number of windows, anchor hash, context hash) of each anchor."""
    at, hashes = words.at, words.hashes
    if len(hashes) < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    grams = K.gram_hashes(hashes, GRAM)
    best = sliding_argmin(grams, window - GRAM + 1)
    row_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    start = np.flatnonzero(np.arange(len(best)) + window <= at[1:][row_of[: len(best)]])
    place = best[start]
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (row_of[start[1:]] != row_of[start[:-1]])
    cut = np.flatnonzero(new)
    first, place = start[cut], place[cut]
    run = np.diff(np.append(cut, len(start)))
    # A context is shorter than two windows, so its first and its last one hold all its words.
    windows = K.gram_hashes(hashes, window)
    context = K.join_hashes(K.join_hashes(windows[first], windows[first + run - 1]), (run * window + place - first).astype(np.uint64))
    row = row_of[first]
    # Smallest hashes crowd at the low end of the range, whose owner would hold most of them: mixed, they are even again.
    return row, first - at[row], run, K.mix(grams[place]), context


class Automaton:
    """A suffix automaton of several sequences with the number of occurrences of each state's sequences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of exactly p's longest sequence followed by c, where p has a move c."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def add(self, sequence: list[int], times: int) -> list[int]:
        """Adds a sequence that occurs so often; the states of its prefixes."""
        last, path = 0, []
        for c in sequence:
            if c in self.next[last]:
                last = self._split(last, c)
            else:
                new = self._state(self.length[last] + 1, {}, 0)
                p = last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, c)
                last = new
            self.count[last] += times
            path.append(last)
        return path

    def finish(self) -> None:
        """Occurrences of longer sequences are occurrences of their suffixes."""
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.count[self.link[state]] += self.count[state]

    def longest_twice(self, sequence: list[int]) -> list[int]:
        """Matching statistics: for each prefix of a sequence that was added, the longest suffix that occurs twice."""
        state, out = 0, []
        for n, c in enumerate(sequence, 1):
            while c not in self.next[state]:
                state = self.link[state]
            state = self.next[state][c]
            s = state
            while s > 0 and self.count[s] < 2:
                s = self.link[s]
            out.append(min(self.length[s], n))
        return out


def repeated_spans(contexts: list[list[int]], times: list[int], window: int) -> list[list[int]]:
    """For each context its covered words as flat [start, end, start, end, ...]: maximal spans of repeated windows."""
    automaton = Automaton()
    for sequence, n in zip(contexts, times):
        automaton.add(sequence, n)
    automaton.finish()
    out = []
    for sequence in contexts:
        spans: list[int] = []
        for end, length in enumerate(automaton.longest_twice(sequence), 1):
            if length >= window:
                if spans and end - length <= spans[-1]:
                    spans[-2:] = [min(spans[-2], end - length), end]
                else:
                    spans += [end - length, end]
        out.append(spans)
    return out


def _shard(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in K.grouped(batches, ["m"]):
            contexts = [np.frombuffer(x, np.int64).tolist() for x in group.column("words").to_pylist()]
            spans = repeated_spans(contexts, group.column("n").to_pylist(), window)
            yield pa.RecordBatch.from_arrays(
                [group.column("m").combine_chunks(), group.column("context").combine_chunks(), pa.array(spans, pa.list_(pa.int32()))],
                names=["m", "context", "spans"],
            )

    return run


def repeated_words(docs: DataFrame, window: int, n_words: int) -> DataFrame:
    """Rows (doc, h, spans) for the documents (doc, h, text) with repeats; spans: array of (start, end) in words."""
    seed = K.new_seed()

    def find(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        for lo, hi, data, offsets in K.text_chunks(batch.column("text")):
            row, first, run, m, context = anchors(Words(data, offsets, seed), window)
            doc, h = (batch.column(c).slice(lo, hi - lo).to_numpy()[row] for c in ("doc", "h"))
            yield [m, doc, h, first, run, context.view(np.int64)]

    payload = {"doc": "near", "h": "long", "first": "int", "run": "int", "context": "long"}
    found = written(suspects(docs, find, payload, int(n_words * 2 / (window - GRAM + 2))).withColumnRenamed("key", "m"))
    seen = found.groupBy("m").agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high"))
    seen = written(seen.filter("n > 1").select("m", (F.col("low") == F.col("high")).alias("alike")))
    repeats = written(found.join(seen, "m"))
    whole = F.struct(F.col("first").alias("start"), (F.col("first") + F.col("run") + window - 1).alias("end"))
    alike = repeats.filter("alike").select("doc", "h", whole.alias("span"))

    differ = repeats.filter("NOT alike")
    contexts = written(differ.groupBy("m", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc", "h", "first", "run")).alias("at")))
    sizes = written(contexts.groupBy("m").agg(F.count("*").alias("contexts")))
    wanted = contexts.join(sizes, "m").select("m", "context", "n", "at.*", (F.col("contexts") > MOST_CONTEXTS).alias("many"))
    by_doc = wanted.groupBy("doc", "h").agg(F.collect_list(F.struct("m", "context", "n", "first", "run", "many")).alias("wanted"))
    texts = docs.join(by_doc, ["doc", "h"]).select("text", "wanted")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted")
            for lo, hi, data, offsets in K.text_chunks(batch.column("text")):
                words = Words(data, offsets, seed)
                part = wanted.slice(lo, hi - lo)
                items = part.flatten()
                m, context, n, first, run, many = (items.field(k) for k in range(6))
                row = np.repeat(np.arange(hi - lo), np.diff(part.offsets.to_numpy()))
                start = words.at[row] + first.to_numpy()
                lengths = run.to_numpy() + window - 1
                hashes = words.hashes.view(np.int64)
                blobs = [hashes[s : s + k].tobytes() for s, k in zip(start, lengths)]
                grams = K.gram_hashes(words.hashes, window).view(np.int64)
                hot = many.to_numpy(zero_copy_only=False)
                windows = [grams[s : s + k] if x else None for s, k, x in zip(start, run.to_numpy(), hot)]
                yield pa.RecordBatch.from_arrays(
                    [m, context, n, pa.array([None if x else b for b, x in zip(blobs, hot)], pa.binary()), pa.array(windows, pa.list_(pa.int64()))],
                    names=["m", "context", "n", "words", "windows"],
                )

    # Rows with equal ids and texts are all read; what they bring is the same.
    contexts_read = texts.mapInArrow(read, "m long, context long, n long, words binary, windows array<long>")
    read_back = written(contexts_read.dropDuplicates(["m", "context"]))
    shards = read_back.filter("words IS NOT NULL").select("m", "context", "n", "words").repartition("m").sortWithinPartitions("m")
    spans = shards.mapInArrow(_shard(window), "m long, context long, spans array<int>")
    pairs = "transform(sequence(0, size(spans) div 2 - 1), k -> named_struct('start', spans[2 * k], 'end', spans[2 * k + 1]))"
    spans = spans.filter("size(spans) > 0").select("m", "context", F.expr(pairs).alias("spans"))
    hot = read_back.filter("windows IS NOT NULL").select("m", "context", "n", "windows")
    n_windows = hot.agg(F.sum(F.size("windows"))).first()[0] or 0

    def each_window(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        sizes = np.diff(batch.column("windows").offsets.to_numpy())
        values = batch.column("windows").flatten().to_numpy().view(np.uint64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        columns = [values, *(batch.column(c).to_numpy()[row] for c in ("m", "context", "n")), place]
        yield columns
        # A context that occurs twice brings each of its windows twice.
        again = columns[3] > 1
        yield [c[again] for c in columns[:4]] + [np.full(int(again.sum()), -1)]

    kinds = {"m": "long", "context": "long", "n": "long", "k": "int"}
    single = written(suspects(hot, each_window, kinds, n_windows).filter("k >= 0").withColumnRenamed("key", "w"))
    twice = written(single.groupBy("m", "w").agg(F.sum("n").alias("times")).filter("times > 1").select("m", "w"))
    by_hash = single.join(twice, ["m", "w"]).groupBy("m", "context").agg(F.collect_list(F.struct(F.col("k").alias("start"), (F.col("k") + window).alias("end"))).alias("spans"))
    covered = written(spans.union(by_hash))
    shifted = F.transform("spans", lambda s: F.struct((s["start"] + F.col("first")).alias("start"), (s["end"] + F.col("first")).alias("end")))
    places = differ.select("m", "context", "doc", "h", "first").distinct()
    unlike = places.join(covered, ["m", "context"]).select("doc", "h", F.explode(shifted).alias("span"))
    return alike.union(unlike).groupBy("doc", "h").agg(F.collect_set("span").alias("spans"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """docs with text reduced to the words that stay, joined by single blanks, and n_words (before), n_removed and
    removed_spans (start, end in words); these replace columns of the same names. Words that a repeated window
    covers go, in all their occurrences."""
    given = [c for c in docs.columns if c not in ("n_words", "n_removed", "removed_spans")]
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"), F.struct(*given).alias("given"))
    chars = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spans = repeated_words(keyed.select("doc", "h", "text"), window, chars // 5)
    joined = keyed.drop("text").join(spans.hint("shuffle_hash"), ["doc", "h"], "left").select("given.*", F.col("spans").alias("removed_spans"))
    schema = docs.select(*given).schema.add("n_words", "long").add("n_removed", "long").add("removed_spans", SPANS)
    at = given.index(text_col)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, gone, out = [], [], [], []
            for lo, hi, data, offsets in K.text_chunks(batch.column(at)):
                starts, ends, word_at = K.words(data, offsets)
                raw = data.tobytes()
                for i, spans in enumerate(batch.column("removed_spans").slice(lo, hi - lo).to_pylist()):
                    a, b = word_at[i], word_at[i + 1]
                    edges = np.zeros(b - a + 1, np.int64)
                    for s in spans or ():
                        edges[s["start"]] += 1
                        edges[s["end"]] -= 1
                    cut = np.cumsum(edges) > 0
                    kept = np.flatnonzero(~cut[:-1]) + a
                    change = np.flatnonzero(np.diff(np.concatenate([[False], cut])))
                    gone.append([{"start": int(s), "end": int(e)} for s, e in change.reshape(-1, 2)])
                    counts.append(b - a)
                    removed.append(b - a - len(kept))
                    out.append(b" ".join([raw[s:e] for s, e in zip(starts[kept].tolist(), ends[kept].tolist())]))
            columns = [batch.column(i) for i in range(len(given))]
            columns[at] = pa.array(out, pa.large_binary()).cast(pa.large_string()).cast(columns[at].type)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(gone, span_type)], names=schema.names
            )

    return joined.mapInArrow(rewrite, schema)
