"""Byte-level BPE over whole texts, with each distinct piece encoded once.

The pre-tokenizer of a byte-level BPE vocabulary cuts a text into pieces that are encoded
independently. Here numpy finds the pieces of a whole batch of texts, each distinct piece goes
through the ``tokenizers`` library once in a Python worker, and the ids of the texts are gathered
from these results. A piece is looked up by hash and then held against the known piece, code point
by code point; a text with a piece that only shares a hash goes through the library whole. Texts
are cut at ``CHUNK`` code points, where a blank between letters opens a piece in any case, so memory
doesn't follow a text's size. The result equals ``Tokenizer.encode`` on the whole text. Where the
vocabulary's pre-tokenizer isn't the known one, texts go through the library whole.

Strings of special tokens in a text are ordinary text, as the vocabulary's own notes have it
(``encode_special_tokens``); with ``special=True`` they are their tokens, as in a plain call.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import json
import sys
from array import array

import numpy as np
import pandas as pd

#: The pre-tokenization pattern this module cuts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3
#: The byte-level alphabet: printable bytes stand for themselves, the others, in order, for the code points from 256.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = np.arange(256, dtype=np.uint32)
_ALPHABET[np.setdiff1d(np.arange(256), _PRINTABLE)] = 256 + np.arange(256 - len(_PRINTABLE))
#: Distinct pieces, and their code points, kept by a worker; beyond either the cache starts anew.
CACHE_PIECES, CACHE_CODES = 1_500_000, 12_000_000
#: Code points cut at once, about; bounds a worker's memory for long texts and large batches.
CHUNK = 200_000


@functools.cache
def _classes() -> np.ndarray:
    """The class of each code point, by the regex library's Unicode tables."""
    import regex

    out = np.full(0x110000, _OTHER, np.uint8)
    for lo in range(0, 0x110000, 0x800):
        if 0xD800 <= lo < 0xE000:
            continue
        some = np.arange(lo, lo + 0x800, dtype="<u4").tobytes().decode("utf-32-le")
        for cls, what in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
            for m in regex.finditer(f"{what}+", some):
                out[lo + m.start() : lo + m.end()] = cls
    return out


def relieve() -> None:
    """Give memory that a task no longer needs back to the system: workers stay for the tasks after."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def cut(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the pieces of texts that lie one after the other in ``codes``; ``bounds`` has each text's start and the end."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    cls = _classes()[codes]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    start = first[:n].copy()
    start[1:] |= cls[1:] != cls[:-1]
    # White space: the last of a run that a text goes on after stands alone or, if a blank, opens the next piece.
    space = cls == _SPACE
    ends_run = space.copy()
    ends_run[:-1] &= ~space[1:] & ~first[1:n]
    ends_run[-1] = False
    start |= ends_run
    opens = np.zeros(n, bool)
    opens[1:] = (ends_run & (codes == 32))[:-1]
    start &= ~opens
    # Contractions: an apostrophe that opens a piece, then one of the endings.
    at = np.flatnonzero((codes == 39) & start)
    if len(at):
        start = _contractions(codes, cls, first, start, at)
    return np.flatnonzero(start)


def _contractions(codes, cls, first, start, at):
    start = start.copy()
    n = len(codes)
    for i in at.tolist():
        tail = ""
        for j in range(i + 1, min(i + 3, n)):
            if first[j]:
                break
            tail += chr(codes[j])
        size = 2 if tail[:1] in ("s", "t", "m", "d") and tail else 3 if tail in ("re", "ve", "ll") else 0
        if not size or not start[i]:
            continue
        start[i + 1 : i + size] = False
        if i + size < n and not first[i + size]:
            # What follows opens a piece of its own.
            start[i + size] = True
    return start


class HashSlots:
    """An open-addressing table from 64-bit hashes to slots, looked up by whole arrays."""

    def __init__(self, bits: int = 17):
        self.bits, self.used = bits, 0
        self.key, self.slot = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(keys), -1, np.int32), np.arange(len(keys))
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            slot = self.slot[at]
            hit = (self.key[at] == keys) & (slot >= 0)
            out[todo[hit]] = slot[hit]
            more = ~hit & (slot >= 0)
            todo, keys, at = todo[more], keys[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out

    def put(self, keys: np.ndarray, slots: np.ndarray) -> None:
        """Adds distinct keys that aren't there yet."""
        self.used += len(keys)
        if self.used * 2 > 1 << self.bits:
            old = self.slot >= 0
            keys, slots = np.concatenate([self.key[old], keys]), np.concatenate([self.slot[old], slots])
            bits = self.bits
            while len(keys) * 2 > 1 << bits:
                bits += 1
            self.__init__(bits)
            self.used = len(keys)
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(keys):
            free = self.slot[at] < 0
            self.slot[at[free]] = slots[free]
            won = self.slot[at] == slots
            self.key[at[won]] = keys[won]
            keys, slots, at = keys[~won], slots[~won], (at[~won] + 1) & ((1 << self.bits) - 1)


def _parts(text: str, size: int) -> list[str]:
    """A text in parts of about ``size`` code points; each later part opens with a blank between two letters, which opens a piece."""
    out, lo = [], 0
    while len(text) - lo > size:
        at = text.find(" ", lo + size)
        while 0 < at and not (text[at - 1].isalpha() and text[at + 1 : at + 2].isalpha()):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        out.append(text[lo:at])
        lo = at
    out.append(text[lo:])
    return out


class PieceEncoder:
    """Encodes batches of texts; one lives in each Python worker."""

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        pre = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        self.by_piece = self.tokenizer.normalizer is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not (self.tokenizer.truncation or self.tokenizer.padding)
        self._reset()
        relieve()

    def _reset(self):
        self.known = HashSlots()
        self.flat, self.codes = array("I"), array("I")
        self.at, self.code_at = array("q", [0]), array("q", [0])

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for row in ids for x in row), np.uint32, int(sizes.sum()))
        return flat, sizes

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and each text's number of ids; null is the empty text."""
        texts = [t or "" for t in texts]
        if not self.by_piece:
            return self.whole(texts)
        odd = [i for i, t in enumerate(texts) if any(x in t for x in self.special)]
        if odd:
            return self._replaced(texts, odd, *self(["" if i in set(odd) else t for i, t in enumerate(texts)]))
        parts, owner = [], []
        for i, t in enumerate(texts):
            own = _parts(t, CHUNK) if len(t) > CHUNK else [t]
            parts += own
            owner += [i] * len(own)
        flats, sizes, held, size = [], [], [], 0
        for t in [*parts, None]:
            if t is None or (held and size + len(t) > 2 * CHUNK):
                a, b = self._chunk(held)
                flats.append(a), sizes.append(b)
                held, size = [], 0
            held.append(t)
            size += len(t or "")
        total = np.bincount(np.array(owner, np.int64), np.concatenate(sizes), len(texts)).astype(np.int64) if parts else np.zeros(0, np.int64)
        return np.concatenate(flats), total

    def _replaced(self, texts, at, ids, sizes):
        """The ids with those of some texts, which the library encodes whole, put in."""
        ends = np.cumsum(sizes)
        own, n = self.whole([texts[i] for i in at])
        out, x, y = [], 0, 0
        for i, k in zip(at, n.tolist(), strict=True):
            out += [ids[x : ends[i] - sizes[i]], own[y : y + k]]
            x, y = ends[i], y + k
        sizes = sizes.copy()
        sizes[at] = n
        return np.concatenate([*out, ids[x:]]), sizes

    def _chunk(self, texts):
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        starts = cut(codes, bounds)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        length = np.diff(np.append(starts, len(codes)))
        keys = _hashes(codes, starts, length)
        back, distinct = pd.factorize(keys)
        where = np.empty(len(distinct), np.int64)
        where[back[::-1]] = np.arange(len(keys) - 1, -1, -1)
        slot = self.known.find(distinct)
        if (slot < 0).any():
            if (len(self.at) + int((slot < 0).sum()) > CACHE_PIECES or len(self.codes) + len(codes) > CACHE_CODES) and len(self.at) > 1:
                self._reset()
                slot[:] = -1
            fresh = np.flatnonzero(slot < 0)
            self._learn(joined, codes, starts[where[fresh]], length[where[fresh]])
            slot[fresh] = len(self.at) - 1 - len(fresh) + np.arange(len(fresh))
            self.known.put(distinct[fresh], slot[fresh])
        at, flat = np.frombuffer(self.at, np.int64), np.frombuffer(self.flat, np.uint32)
        begin = at[slot]
        count = (at[slot + 1] - begin)[back]
        ends = np.cumsum(count)
        place = np.repeat((begin[back] - (ends - count)).astype(np.int32), count)
        place += np.arange(ends[-1], dtype=np.int32)
        ids = flat[place]
        total = np.concatenate([[0], ends])
        sizes = np.diff(total[np.searchsorted(starts, bounds)])
        differ = self._differ(codes, starts, length, slot[back])
        if len(differ):
            return self._replaced(texts, np.unique(np.searchsorted(bounds, starts[differ], "right") - 1).tolist(), ids, sizes)
        return ids, sizes

    def _learn(self, joined, codes, starts, length):
        a, b = starts.tolist(), (starts + length).tolist()
        raw = [joined[x:y].encode("utf-8", "replace") for x, y in zip(a, b, strict=True)]
        shown = _ALPHABET[np.frombuffer(b"".join(raw), np.uint8)].tobytes().decode("utf-32-le")
        tokenize, extend, mark, x = self.tokenizer.model.tokenize, self.flat.extend, self.at.append, 0
        for piece in raw:
            y = x + len(piece)
            extend([k.id for k in tokenize(shown[x:y])])
            mark(len(self.flat))
            x = y
        ends = np.cumsum(length)
        self.code_at.frombytes((self.code_at[-1] + ends).astype(np.int64).tobytes())
        self.codes.frombytes(codes[np.arange(ends[-1]) + np.repeat(starts - (ends - length), length)].tobytes())

    def _differ(self, codes, starts, length, slot) -> np.ndarray:
        """Pieces that aren't the known piece of their hash."""
        at, known = np.frombuffer(self.code_at, np.int64), np.frombuffer(self.codes, np.uint32)
        begin = at[slot]
        same = at[slot + 1] - begin == length
        if not same.all():
            begin = np.where(same, begin, 0)  # any place that has as many code points will do
            known = np.concatenate([known, np.zeros(int(length.max()), np.uint32)])
        place = np.repeat((begin - starts).astype(np.int32), length)
        place += np.arange(len(codes), dtype=np.int32)
        equal = known[place] == codes
        if same.all() and equal.all():
            return np.zeros(0, np.int64)
        return np.flatnonzero(~(same & np.logical_and.reduceat(equal, starts)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(codes: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece; what it finds is held against the piece."""
    x = np.arange(len(codes), dtype=np.uint64)
    x -= np.repeat(starts.astype(np.uint64), length)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= codes
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return _mix(np.add.reduceat(x, starts) + length.astype(np.uint64))


@functools.lru_cache(maxsize=4)
def encoder(path: str, special: bool = False) -> PieceEncoder:
    return PieceEncoder(path, special)


def sliced(batch, column: int = 1, size: int = 4 << 20):
    """A record batch in slices of about ``size`` bytes of the text in ``column``; a row of more is one of its own."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff((ends - 1).clip(0) // size)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(lo, hi - lo)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


if sys.byteorder != "little":
    raise ImportError("ids are stored as little-endian integers")
