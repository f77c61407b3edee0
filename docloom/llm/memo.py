"""Short lists of numbers by byte string, remembered in a worker across batches, exact on every hit."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from docloom.llm import kernels as K

#: Byte strings up to this length are kept in the table whole, as two 64-bit lanes; longer ones in a dictionary.
SHORT = 16
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class SpanMemo:
    """make(byte string) -> numbers, called once for each distinct byte string while it is remembered.

    A hit compares all bytes and the length, so strings whose hashes meet never share an entry. The table has a fixed
    number of places, two for each string; a string that finds both taken is made anew each time. A full
    store of numbers or of long strings starts anew. None of this changes a result.
    """

    def __init__(self, make: Callable[[bytes], Sequence[int]], places: int = 1 << 20, most_values: int = 1 << 23, most_long: int = 1 << 17):
        self.make, self.places, self.most_values, self.most_long = make, places, most_values, most_long
        self._reset()

    def _reset(self) -> None:
        self.low, self.high = np.zeros(self.places, np.uint64), np.zeros(self.places, np.uint64)
        self.size = np.full(self.places, -1, np.int8)
        self.at, self.count = np.zeros(self.places, np.int32), np.zeros(self.places, np.int32)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.values, self.used = np.zeros(1 << 16, np.int32), 0

    def _store(self, found: list[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Places and lengths of new lists in the store."""
        sizes = np.array([len(x) for x in found], np.int64)
        new = np.fromiter((i for x in found for i in x), np.int32, int(sizes.sum()))
        if self.used + len(new) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros(max(len(self.values), len(new)), np.int32)])
        self.values[self.used : self.used + len(new)] = new
        places = self.used + np.cumsum(sizes) - sizes
        self.used += len(new)
        return places, sizes

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and lengths, in self.values, of the lists of all byte spans."""
        if self.used > self.most_values or len(self.long) > self.most_long:
            self._reset()
        lengths = ends - starts
        lanes = np.ndarray(len(data) + SHORT - 7, "<u8", np.concatenate([data, np.zeros(SHORT, np.uint8)]), strides=(1,))
        low = lanes[starts] & _MASKS[np.minimum(lengths, 8)]
        high = lanes[np.minimum(starts + 8, len(data))] & _MASKS[np.clip(lengths - 8, 0, 8)]
        hashes = K.mix(low ^ K.mix(high + lengths.astype(np.uint64)))
        slots = [(hashes & K.U(self.places - 1)).astype(np.int64), (hashes >> K.U(40)).astype(np.int64) & (self.places - 1)]
        match = lambda at, i=slice(None): (self.low[at] == low[i]) & (self.high[at] == high[i]) & (self.size[at] == lengths[i])
        slot = np.where(match(slots[0]), slots[0], slots[1])
        known = match(slot)
        at, count = self.at[slot].astype(np.int64), self.count[slot].astype(np.int64)
        if known.all():
            return at, count
        raw = data.tobytes()
        missing = np.flatnonzero(~known)
        left = missing[lengths[missing] > SHORT]
        short = missing[lengths[missing] <= SHORT]
        if len(short):
            _, first, back = np.unique(hashes[short], return_index=True, return_inverse=True)
            one = short[first]
            same = (low[short] == low[one][back]) & (high[short] == high[one][back]) & (lengths[short] == lengths[one][back])
            left, short, back = np.concatenate([left, short[~same]]), short[same], back[same]
            places, sizes = self._store([self.make(raw[starts[i] : ends[i]]) for i in one.tolist()])
            at[short], count[short] = places[back], sizes[back]
            for place in slots:
                free = np.flatnonzero(self.size[place[one]] < 0)
                to = place[one[free]]
                self.low[to], self.high[to], self.size[to] = low[one[free]], high[one[free]], lengths[one[free]]
                self.at[to], self.count[to] = places[free], sizes[free]
                # Two new strings may want one place: the last one written has it, the others try the next.
                rest = ~match(place[one], one)
                one, places, sizes = one[rest], places[rest], sizes[rest]
        for i in left.tolist():
            key = raw[starts[i] : ends[i]]
            entry = self.long.get(key)
            if entry is None:
                places, sizes = self._store([self.make(key)])
                entry = self.long[key] = int(places[0]), int(sizes[0])
            at[i], count[i] = entry
        return at, count
