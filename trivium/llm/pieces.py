"""Texts of an Arrow batch cut in short pieces that are encoded once each.

Words repeat, so an encoder needs to see a batch's distinct pieces only. Pieces are cut where no token can reach across:

* cut_words drops runs of ASCII white space, for vocabularies whose tokens hold none;
* cut_spaced cuts before a space that stands before a character that is surely not white space, for byte-level
  vocabularies whose pre-tokens are a word with at most one space before it.

All steps over the bytes are numpy's or Arrow's; what is kept between batches is bounded (Memory).
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces that a worker remembers, the longest of them in bytes, and bytes of text handled at a time.
MEMORY, REMEMBERED, SLICE = 600_000, 64, 4_000_000

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: First bytes of characters that aren't white space: visible ASCII, and UTF-8 lead bytes of rows without any.
VISIBLE = np.zeros(256, bool)
VISIBLE[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True


def trim() -> None:
    """Give memory that this Python worker no longer uses back to the machine: workers live on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a string array without nulls."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return offsets - offsets[0], raw


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about so many bytes of text; a longer text is a range of its own."""
    offsets, start = buffers(texts)[0], 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield start, stop
        start = stop


def split_at(starts: np.ndarray, raw: np.ndarray) -> pa.Array:
    """The pieces of raw that begin at starts, the last one at its end."""
    offsets = np.append(starts, len(raw)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pieces, number of pieces before each row and after the last)."""
    offsets, raw = buffers(texts)
    seen = ~_WHITE[raw]
    first = seen.copy()
    first[1:] &= ~seen[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    first[begins] = seen[begins]
    at = np.flatnonzero(first)
    before = np.concatenate([[0], np.cumsum(seen)])
    return split_at(before[at], raw[seen]), np.searchsorted(at, offsets)


def cut_spaced(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pieces, number of pieces before each row and after the last)."""
    offsets, raw = buffers(texts)
    first = np.zeros(len(raw), bool)
    first[:-1] = (raw[:-1] == 0x20) & VISIBLE[raw[1:]]
    # a space that ends its row isn't before the next row's text
    ends, begins = offsets[1:][np.diff(offsets) > 0] - 1, offsets[:-1][np.diff(offsets) > 0]
    first[ends] = False
    first[begins] = True
    at = np.flatnonzero(first)
    return split_at(at, raw), np.searchsorted(at, offsets)


class Memory:
    """Pieces and their ids, for the short ones that came last, in flat arrays; encode_many gets the pieces that aren't known.

    encode_many: from an array of different pieces to (number of ids of each, all their ids).
    """

    def __init__(self, encode_many: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], most: int = MEMORY):
        self.encode_many, self.most = encode_many, most
        self.keys, self.sizes, self.flat = pa.array([], pa.large_binary()), np.empty(0, np.int64), np.empty(0, np.int32)

    def find(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(each piece's place in sizes, sizes, all ids one place after the other)."""
        at = pc.index_in(pieces, value_set=self.keys)
        lacking = at.is_null().to_numpy(zero_copy_only=False)
        which = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if not lacking.any():
            return which, self.sizes, self.flat
        new = pieces.filter(pa.array(lacking)).dictionary_encode()
        which[lacking] = new.indices.to_numpy(zero_copy_only=False) + len(self.sizes)
        sizes, ids = self.encode_many(new.dictionary)
        found = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, ids])
        short = pc.binary_length(new.dictionary).to_numpy(zero_copy_only=False) <= REMEMBERED
        self.keys = pa.concat_arrays([self.keys, new.dictionary.filter(pa.array(short))])
        self.flat = np.concatenate([self.flat, ids[np.repeat(short, sizes)]])
        self.sizes = np.concatenate([self.sizes, sizes[short]])
        if len(self.sizes) > self.most:  # the later half stays
            cut = len(self.sizes) - self.most // 2
            self.flat = self.flat[self.sizes[:cut].sum() :].copy()
            self.sizes, self.keys = self.sizes[cut:].copy(), pa.concat_arrays([self.keys[cut:]])
        return which, *found


def encode(texts: pa.Array, cut: Callable, memory: Memory) -> tuple[np.ndarray, np.ndarray]:
    """(row offsets, ids) of a string array without nulls."""
    pieces, rows = cut(texts)
    which, sizes, flat = memory.find(pieces)
    starts = np.cumsum(sizes) - sizes
    own = sizes[which]
    stops = np.concatenate([[0], np.cumsum(own)])
    # position in flat: the piece's start there, and how far in the piece we are
    ids = flat[np.repeat(starts[which] - stops[:-1], own) + np.arange(stops[-1])]
    return stops[rows], ids
