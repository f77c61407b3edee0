"""Greedy longest-match piece counts in linear time.

The vocabulary is a trie. Where a word leaves it, a node's failure link tells the node of what is left after the
longest-match pieces inside the node's string have been taken, and the node's pop count how many those are; both
are computed once. So a word is read once, letter by letter, and only counts are added: no piece is ever built.
Words are read as a blank and their bytes, as byte-level vocabularies mark the beginnings of words.

Nulls: a null text has no words. A word that cannot be split counts as one unknown piece. Repeated rows get equal
answers. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docloom.llm import kernels as K
from docloom.llm.bpe import byte_letters
from docloom.llm.memo import SpanMemo


class Automaton:
    """next: (node * 256 + byte) -> node; fail and pops by node, fail -1 where no pieces fit."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.next: dict[int, int] = {}
        parents, letters, whole = [-1], [-1], [False]
        for token in vocabulary:
            node = 0
            for byte in token:
                step = node * 256 + byte
                if step not in self.next:
                    self.next[step] = len(parents)
                    parents.append(node)
                    letters.append(byte)
                    whole.append(False)
                node = self.next[step]
            whole[node] = node != 0
        depth = np.zeros(len(parents), np.int64)
        for node in range(1, len(parents)):  # a parent's number is always below its children's
            depth[node] = depth[parents[node]] + 1
        self.fail, self.pops = [-1] * len(parents), [0] * len(parents)
        for node in np.argsort(depth, kind="stable")[1:].tolist():
            if whole[node]:
                self.fail[node], self.pops[node] = 0, 1
                continue
            at, popped = self.fail[parents[node]], self.pops[parents[node]]
            while at >= 0 and at * 256 + letters[node] not in self.next:
                popped += self.pops[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[node], self.pops[node] = self.next[at * 256 + letters[node]], popped

    def count(self, word: bytes) -> int:
        """The number of greedy longest-match pieces of a word, or -1 if it cannot be split."""
        node = popped = 0
        for byte in word:
            while (to := self.next.get(node * 256 + byte)) is None:
                if self.fail[node] < 0:
                    return -1
                popped += self.pops[node]
                node = self.fail[node]
            node = to
        while node > 0:
            popped += self.pops[node]
            node = self.fail[node]
        return popped if node == 0 else -1


def vocabulary(path: str) -> list[bytes]:
    """The byte strings of a byte-level tokenizer file's vocabulary, without its special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"] for x in spec.get("added_tokens", ()) if x.get("special")}
    back = {letter: byte for byte, letter in byte_letters().items()}
    return [bytes(back[c] for c in token) for token in spec["model"]["vocab"] if token not in special]


class Counter:
    """An automaton and a memo of the words counted so far."""

    def __init__(self, path: str):
        automaton = Automaton(vocabulary(path))
        self.memo = SpanMemo(lambda word: (automaton.count(b" " + word),))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        places, _ = self.memo.lookup(data, starts, ends)
        return self.memo.values[places]


_counters: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    """This worker's counter for a tokenizer file; later tasks of the worker go on with it."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_pieces(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_pieces and n_unknown (long), which replace columns of the same names.

    path: a byte-level tokenizer file that executors can read.
    """
    added = ("n_words", "n_pieces", "n_unknown")
    given = [c for c in docs.columns if c not in added]
    schema = T.StructType(docs.select(*given).schema.fields)
    for name in added:
        schema = schema.add(name, "long")
    at = given.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            parts = [np.zeros((3, 0), np.int64)]
            for _, _, data, offsets in K.text_chunks(batch.column(at)):
                starts, ends, rows = K.words(data, offsets)
                counts = counter(data, starts, ends)
                unknown = counts < 0
                parts.append(np.stack([np.diff(rows), K.per_row(np.where(unknown, 1, counts), rows), K.per_row(unknown, rows)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, np.concatenate(parts, axis=1))], names=schema.names)

    return docs.select(*given).mapInArrow(run, schema)
