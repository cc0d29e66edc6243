"""A run-length index of a collection of byte strings, and matching statistics streamed from it.

The Burrows-Wheeler transform of the collection is kept as runs. At each run's start the index has
a sample: the place of that suffix, the place of the suffix before it, which is the end of the run
before, and how far the two match (and likewise at run ends, with the suffix after). The suffix
order itself goes once the runs are found. All else follows from the samples: where the transform
goes on with the same byte, the place before in the text has the place before that suffix for a
neighbour, and matches it by one byte more. So the samples are streamed in text order to give, at
each place, its neighbour and the longest match, which is the longest match with any other suffix.
Memory beside the text is some 32-bit numbers a byte while the index is built, and samples after.
"""

from __future__ import annotations

import numpy as np

_FIRST = 7


class RunIndex:
    """Index of ``strings`` (under 2^31 bytes in all); places are offsets in their concatenation."""

    def __init__(self, strings: list[bytes]):
        self.text = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.fromiter(map(len, strings), np.int32, len(strings))
        self.ends = np.cumsum(self.sizes, dtype=np.int32)
        n, room = len(self.text), self.room
        order, levels = self._sort(room, int(self.sizes.max(initial=0)))
        at_start = room[order] == np.repeat(self.sizes, self.sizes)[order]
        # Each string's start has a mark of its own before it.
        before = np.where(at_start, -1 - np.repeat(np.arange(len(strings), dtype=np.int32), self.sizes)[order], self.text[order - 1].astype(np.int32))
        opens = np.ones(n, bool)
        opens[1:] = before[1:] != before[:-1]
        heads = np.flatnonzero(opens)
        tails = np.append(heads[1:], n)[: len(heads)] - 1
        self.run_bytes, self.run_sizes = before[heads], np.diff(np.append(heads, n))
        self.head_at, self.tail_at = order[heads], order[tails]
        none = np.zeros(min(n, 1), np.int32)
        self.head_match = np.concatenate([none, _common(self.text, room, levels, self.head_at[1:], self.tail_at[:-1])])
        self.tail_match = np.concatenate([self.head_match[1:], none])

    @property
    def room(self) -> np.ndarray:
        """Bytes from each place to the end of its string."""
        return np.repeat(self.ends, self.sizes) - np.arange(len(self.text), dtype=np.int32)

    @property
    def owner(self) -> np.ndarray:
        """The string of each place."""
        return np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)

    def _sort(self, room: np.ndarray, longest: int) -> tuple[np.ndarray, list]:
        """Places by the suffix of their string, equal suffixes by string; and the ranks of the prefixes that were doubled."""
        n = len(self.text)
        key = np.zeros(n, np.uint64)
        for j in range(_FIRST):
            sym = np.zeros(n, np.uint64)
            sym[: max(0, n - j)] = self.text[j:].astype(np.uint64) + np.uint64(1)
            sym[room <= j] = 0
            key = key << np.uint64(9) | sym
        span, levels = _FIRST, []
        while True:
            order = np.argsort(key, kind="stable").astype(np.int32)
            new = np.ones(n, np.int32)
            new[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(new, dtype=np.int32)
            if span >= longest or new.all():
                return order, levels
            levels.append((span, rank))
            then = np.zeros(n, np.uint64)
            then[: max(0, n - span)] = rank[span:]
            then[room <= span] = 0
            key = rank.astype(np.uint64) << np.uint64(32) | then
            span *= 2

    def _stream(self, at: np.ndarray, *samples: np.ndarray) -> list[np.ndarray]:
        """For each place the sample at or before it, less (a match) or more (a place) the way from there."""
        n = len(self.text)
        last = np.zeros(n, np.int32)
        last[at] = at
        last = np.maximum.accumulate(last)
        way, out = np.arange(n, dtype=np.int32) - last, []
        for k, sample in enumerate(samples):
            value = np.zeros(n, np.int32)
            value[at] = sample
            out.append(value[last] + way if k else value[last] - way)
        return out

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """At each place: the longest match with the suffix before it in suffix order, and that suffix."""
        before, neighbour = self._stream(self.head_at, self.head_match, np.concatenate([self.head_at[:1], self.tail_at[:-1]]))
        return before, neighbour

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """At each place, the longest match with the suffix before it in suffix order, and with any other suffix."""
        before, _ = self.neighbours()
        return before, np.maximum(before, *self._stream(self.tail_at, self.tail_match))

    def repeated(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a string of ``width`` bytes starts that starts elsewhere too, and for each the class of its string."""
        if not len(self.text):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        before, neighbour = self.neighbours()
        best = np.maximum(before, *self._stream(self.tail_at, self.tail_match))
        # Equal windows are neighbours of neighbours; each goes by the first of them.
        head = np.where(before >= width, neighbour, np.arange(len(before), dtype=np.int32))
        while ((further := head[head]) != head).any():
            head = further
        at = np.flatnonzero((best >= width) & (self.room >= width)).astype(np.int32)
        return at, head[at]


def _common(text: np.ndarray, room: np.ndarray, levels: list, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of pairs of suffixes within their strings."""
    least = np.minimum(room[a], room[b])
    size = np.zeros(len(a), np.int32)
    steps = levels[::-1]
    for span, rank in [*steps[:1], *steps]:  # the widest twice: doubling stopped below twice its span
        fits = np.flatnonzero(size + span <= least)
        fits = fits[rank[a[fits] + size[fits]] == rank[b[fits] + size[fits]]]
        size[fits] += span
    going = np.flatnonzero(size < least)
    while len(going):
        going = going[text[a[going] + size[going]] == text[b[going] + size[going]]]
        size[going] += 1
        going = going[size[going] < least[going]]
    return size
