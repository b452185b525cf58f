"""Word scanning over Arrow text columns, without making a Python object per word.

Both word definitions of this package separate words at single ASCII bytes, so they can be found in the UTF-8 bytes:
no byte of a multi-byte character is below 0x80. A column of texts is cut into slices of whole texts of about
``SLICE_BYTES``; each slice is handled as one byte array, so the memory of a task does not follow its rows.
Null texts count as empty; texts of any length are handled whole.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1_000_000
_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What `make` gives, kept in this worker for later tasks. Anything else that was kept is let go first."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """Forget what is kept. A worker outlives a stage, and would hold one operator's tables beside another's rows."""
    _kept.clear()


def trim() -> None:
    """Give free memory back to the system: a worker waits between tasks while its executor joins and sorts."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def tidy(run: Callable, forget: bool = True) -> Callable:
    """`run`, a function over a task's batches, without others' tables when it begins and without free memory when it has ended."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if forget:
            let_go()
        yield from run(batches)
        trim()

    return task


def _byte_class(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: Words of [^\x20\x09-\x0D]+.
SPACED = _byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, for text whose A-Z are lower-cased first.
ALNUM = _byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


@dataclass
class Words:
    """Words of the texts of one slice; word i is data[start[i]:end[i]], text d has words first[d] to first[d + 1] - 1."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    is_word: np.ndarray

    @property
    def n_texts(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def window_starts(self, n: int) -> np.ndarray:
        """Indexes of the words at which a window of n words of one text starts."""
        if len(self.start) < n:
            return np.zeros(0, dtype=np.int64)
        last = np.repeat(self.first[1:], self.counts)
        at = np.arange(len(self.start))
        return at[at + n <= last]

    def joined(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the kept words of each text joined by one space, and the byte offsets of the texts in them."""
        chosen = np.arange(len(self.start)) if keep is None else np.flatnonzero(keep)
        owner = np.searchsorted(self.first, chosen, side="right") - 1
        edge = np.zeros(len(self.data) + 1, dtype=np.int8)
        edge[self.start[chosen]] += 1
        np.subtract.at(edge, self.end[chosen], 1)
        kept = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        followed = chosen[:-1][owner[:-1] == owner[1:]]
        kept[self.end[followed]] = True
        data = np.where(self.is_word, self.data, np.uint8(32))
        total = np.concatenate([[0], np.cumsum(kept)])
        return data[kept], total[self.offsets]


def texts_of(column: pa.Array) -> pa.Array:
    """The column as strings, null texts empty."""
    return pc.fill_null(column.cast(pa.string()) if not pa.types.is_string(column.type) else column, "")


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes, of one text at least."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + texts.offset + 1)[texts.offset :] if len(texts) else [0]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + most, side="right")) - 1)
        to = min(to, len(texts))
        yield at, to
        at = to


def scan(texts: pa.Array, byte_class: np.ndarray, lower: bool = False) -> Words:
    """The words of a slice of texts without nulls. lower: A-Z count as a-z."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=n + texts.offset + 1)[texts.offset :].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    is_word = byte_class[data]
    starts, ends = is_word.copy(), is_word.copy()
    starts[1:] &= ~is_word[:-1]
    ends[:-1] &= ~is_word[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts] = is_word[cuts]
    ends[cuts - 1] = is_word[cuts - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets), is_word)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8, key=b"words").digest() for b in range(256)), dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(which: str, base: np.uint64, n: int) -> np.ndarray:
    if which not in _powers or len(_powers[which]) < n:
        made = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        made[0] = 1
        np.multiply.accumulate(made, out=made)
        if n > 4 * SLICE_BYTES:  # for one very long text; not kept
            return made[:n]
        _powers[which] = made
    return _powers[which][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes: polynomial prefix sums, so the cost follows the bytes and not the words."""
    n = len(words.data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[words.data] * _power("up", _BASE, n), out=sums[1:])
    value = (sums[words.end] - sums[words.start]) * _power("down", _INVERSE, n + 1)[words.start]
    return mix(value ^ (words.end - words.start).astype(np.uint64))


def hash_windows(word_hashes: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the n words from each of the words `at` on."""
    value = np.zeros(max(0, len(word_hashes) - n + 1), dtype=np.uint64)
    for k in range(n):
        value = value * np.uint64(0xD1342543DE82EF95) + word_hashes[k : k + len(value)]
    return mix(value[at])


def cover(n_words: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of n_words words lie in any of the given windows."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.asarray(starts) + lengths, -1)
    return np.cumsum(edge[:-1]) > 0
