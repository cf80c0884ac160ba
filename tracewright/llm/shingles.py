"""Sets of hashed word shingles of whole texts.

Words are hashed by keyed SipHash over their bytes, each different word of a slice once, and a
shingle's hash mixes its words' hashes in order; both have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import bounded, text_bytes

#: Words are runs of anything but the six ASCII blanks; A-Z count as a-z.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A batch is hashed in slices of this many bytes, and so is a longer text.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    from pandas.util import hash_array

    low = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data]))
    split = pc.ascii_split_whitespace(low)
    coded = split.flatten().dictionary_encode()
    known = hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False).astype(np.uint64)
    of = coded.indices.to_numpy(zero_copy_only=False)
    real = (pc.binary_length(coded.dictionary).to_numpy() > 0)[of]  # a blank at either end of a text leaves an empty word
    ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
    counts = np.diff(np.concatenate([[0], np.cumsum(real)])[ends], prepend=0)
    return known[of[real]], counts


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many words each text has; a null has none."""
    data, offsets = text_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    if len(data) <= SLICE_BYTES:
        return _hashes(data, offsets)
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while a < b:  # a long text is cut at blanks
            end = min(b, a + SLICE_BYTES)
            while end < b and not (blank := np.flatnonzero(_BLANK[data[end : min(b, end + SLICE_BYTES)]])).size:
                end = min(b, end + SLICE_BYTES)
            end = end if end >= b else end + int(blank[0])
            some, n = _hashes(data[a:end], np.array([0, end - a], np.int64))
            hashes.append(some)
            counts[i] += n[0]
            a = end
    return np.concatenate(hashes), counts


def _distinct(x: np.ndarray) -> np.ndarray:
    """The different values of ``x``, sorted; ``x`` itself is sorted meanwhile."""
    x.sort()
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def shingle_sets(texts: pa.Array, width: int = 4) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text with fewer than ``width`` words has one shingle, its whole sequence; one without words has none.
    """
    return [s for sets in each_shingle_sets(texts, width) for s in sets]


def each_shingle_sets(texts: pa.Array, width: int) -> Iterator[list[np.ndarray]]:
    """``shingle_sets`` in lists for slices of the texts."""
    batch = pa.RecordBatch.from_arrays([texts], names=["t"])
    for part in bounded(batch, 0, SLICE_BYTES):
        yield _shingle_sets(part.column(0), width)


def _shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    begins = ends - counts
    out: list[np.ndarray] = []
    grams = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(0, len(grams), SLICE_BYTES):
        some = np.zeros(min(SLICE_BYTES, len(grams) - i), np.uint64)
        for k in range(width):
            some = mix(some + words[i + k : i + k + len(some)])
        grams[i : i + len(some)] = some
    short = np.flatnonzero((counts > 0) & (counts < width))
    whole = {}
    for i in short.tolist():
        x = np.array([counts[i]], np.uint64)
        for k in range(begins[i], ends[i]):
            x = mix(x + words[k : k + 1])
        whole[i] = x
    del words
    for i, (a, b) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
        out.append(_distinct(grams[a : b - width + 1]) if b - a >= width else whole.get(i, np.zeros(0, np.uint64)))
    return out
