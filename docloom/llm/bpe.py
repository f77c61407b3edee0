"""Token ids of whole texts with a byte-level BPE tokenizer file, memoised by word.

A byte-level pre-tokenizer always splits before a lone blank or line feed that stands between two characters that
are not white space, so texts are cut there and each distinct chunk is encoded once while a worker remembers it (see
memo; chunks are compared by all their bytes).
"""

from __future__ import annotations

import os

import numpy as np

from docloom.llm import kernels as K
from docloom.llm.memo import SpanMemo

MEMO_STEMS = 100_000
_MARKS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
#: First bytes of the UTF-8 forms of white space outside ASCII, with two and with three bytes.
_SPACE_2, _SPACE_3 = 0xC2, (0xE1, 0xE2, 0xE3)


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks start: rows' starts, and blanks and line feeds with plain neighbours."""
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[(at >= 1) & (at + 1 < len(data))]
    row = np.searchsorted(offsets, at, side="right") - 1
    at = at[(at > offsets[row]) & (at + 1 < offsets[row + 1])]
    before, after = data[at - 1], data[at + 1]
    two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    plain_after = (after > 0x20) & (after != 0x7F) & (after != _SPACE_2) & ~np.isin(after, _SPACE_3)
    plain_before = (before > 0x20) & (before != 0x7F) & ((before < 0x80) | ((two != _SPACE_2) & ~np.isin(three, _SPACE_3)))
    return np.sort(np.concatenate([offsets[:-1][offsets[:-1] < offsets[1:]], at[plain_before & plain_after]]), kind="stable")


def byte_letters() -> dict[int, str]:
    """A byte-level vocabulary's letter for each byte: itself if it prints, else the next unused one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordMemo:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.stems: dict[str, list[int]] = {}
        self.memo = SpanMemo(lambda chunk: self._chunk(chunk.decode("utf-8", "replace")))

    def _piece(self, text: str) -> list[int]:
        """Ids of one pre-token, straight from the tokenizer's model."""
        found = self.stems.get(text)
        if found is None:
            if len(self.stems) >= MEMO_STEMS:
                self.stems.clear()
            found = self.stems[text] = [x.id for x in self.model.tokenize(text.encode().decode("latin-1").translate(self.letters))]
        return found

    def _chunk(self, text: str) -> list[int]:
        """Ids of a chunk. A word, with or without a blank before it and marks after it, is one or two pre-tokens."""
        end = len(text)
        while end and text[end - 1] in _MARKS:
            end -= 1
        head = text[1:end] if text[:1] == " " else text[:end]
        if head.isalpha():
            return self._piece(text) if end == len(text) else self._piece(text[:end]) + self._piece(text[end:])
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids one after another, and the rows' offsets among them."""
        begins = chunk_starts(data, offsets)
        starts, lengths = self.memo.lookup(data, begins, np.append(begins[1:], len(data)))
        ids = K.ragged(self.memo.values, starts, lengths).view(np.uint32)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        return ids, sums[np.searchsorted(begins, offsets)]


_memos: dict[str, WordMemo] = {}


def memo(path: str) -> WordMemo:
    """This worker's memo for a tokenizer file; later tasks of the worker go on with it."""
    if path not in _memos:
        _memos[path] = WordMemo(path)
    return _memos[path]
