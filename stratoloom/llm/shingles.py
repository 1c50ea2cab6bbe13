"""Word shingles of Arrow text columns as sets of 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text worked on at once, unless a single text is longer.
CHUNK = 1 << 21

_space = np.zeros(256, bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of each 64-bit value (a bijection)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_place = mix(np.arange(1, 65, dtype=U) * U(0xD1342543DE82EF95)) | U(1)
_seed, _step = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)
#: Masks that keep the first 0 to 8 bytes of a block.
_mask = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each text begins (nulls are empty)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z as a-z, and the first word of each text.

    A word is read in blocks of eight bytes.  Each block is mixed, mixed again with
    its place in the word, and the sum is mixed with the word's length: no step
    is linear in the bytes, so that regular words don't cancel out.
    """
    part = data[at[0] : at[-1]]
    at = at - at[0]
    solid = ~_space[part]
    cut = np.zeros(len(part) + 1, bool)
    cut[at] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | cut[1:-1]
    ends[:-1] &= ~solid[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    words = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, U), words
    lengths = np.flatnonzero(ends) + 1 - starts
    blocks = (lengths + 7) >> 3
    first = np.cumsum(blocks) - blocks
    place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    padded = np.zeros(len(part) + 8, np.uint8)
    padded[: len(part)] = _lower[part]
    # every eight bytes in a row as one number, without a copy
    eight = np.ndarray((len(part) + 1,), "<u8", padded.data, strides=(1,))
    values = eight[np.repeat(starts, blocks) + 8 * place] & _mask[np.minimum(np.repeat(lengths, blocks) - 8 * place, 8)]
    mixed = mix(mix(values + _seed) + place.astype(U) * _step)
    return mix(np.add.reduceat(mixed, first) + lengths.astype(U)), words


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of ``size`` words of each text, in order.

    A text of fewer words is one shingle; without words, or null, none.
    """
    data, at = text_bytes(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(at, at[low] + CHUNK, "right")) - 1)
        words, first = word_hashes(data, at[low : high + 1])
        many = max(0, len(words) - size + 1)
        grams = np.zeros(many, U)
        for i in range(size):
            grams += words[i : i + many] * _place[i]
        grams = mix(grams)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:
                yield mix(np.sum(words[a:b] * _place[: b - a], keepdims=True) + U(b - a))
            else:
                yield grams[:0]
        low = high
