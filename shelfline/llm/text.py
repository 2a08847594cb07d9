"""Word hashing for whole Arrow batches, without a Python loop over words.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``, with A-Z lower-cased.
Its 64-bit hash comes from prefix sums of a polynomial over random byte values
modulo 2**64, so one cumulative sum hashes every word of a batch of texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_draw = np.random.Generator(np.random.PCG64(20))
_BYTE = _draw.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_ODD = _draw.integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(4) + np.uint64(1)
_BASE = int(_ODD[0])
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Text that one pass of numpy takes, in bytes; temporaries are about 40 times as large.
PASS_BYTES = 2 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


_UP = powers(_BASE, 1 << 16)
_DOWN = powers(_INVERSE, 1 << 16)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if n > len(_UP):
        n = 1 << (n - 1).bit_length()
        _UP, _DOWN = powers(_BASE, n), powers(_INVERSE, n)
    return _UP, _DOWN


def passes(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about PASS_BYTES of ``column``, a long text alone."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = 0
    while start < len(sizes):
        run = np.cumsum(sizes[start:start + 4096], dtype=np.int64)
        n = max(1, int(np.searchsorted(run, PASS_BYTES, side="right")))
        yield batch.slice(start, n)
        start += n


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and the n+1 offsets into them; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, for each text the index of its first word; n+1 entries)."""
    hashes, _, at = sized_words(data, offsets)
    return hashes, at


def sized_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_hashes, with the words' bytes between."""
    starts, stops = _bounds(data, offsets)
    return _hashed(data, starts, stops), stops - starts, np.searchsorted(starts, offsets).astype(np.int64)


def edged_words(data: np.ndarray, offsets: np.ndarray, edges: bytes) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes, of the words without the bytes ``edges`` around them; an empty one has the hash 0."""
    starts, stops = _bounds(data, offsets)
    at = np.searchsorted(starts, offsets).astype(np.int64)
    edge = np.zeros(256, dtype=bool)
    edge[list(edges)] = True
    inner = np.append(np.flatnonzero(~edge[data]), len(data))
    starts = np.minimum(inner[np.searchsorted(inner, starts)], stops)
    stops = np.maximum(inner[np.searchsorted(inner, stops) - 1] + 1, starts)
    return _hashed(data, starts, stops), at


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _ODD[2] + second * _ODD[3] + _ODD[4])


def _bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words start and end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cuts = offsets[(offsets < n)]
    first[cuts] = solid[cuts]  # words end with their text
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = cuts[cuts > 0] - 1
    last[ends] = solid[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hashed(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    n = len(data)
    up, down = _grown(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    return mix((total[stops] - total[starts]) * down[starts] + _ODD[1] * (stops - starts).astype(np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A text with fewer words has its whole sequence as one shingle, without
    words none.
    """
    words, at = word_hashes(data, offsets)
    full = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        full += words[k:k + len(full)] * _ODD[2 + k]
    full = mix(full)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(full[a:b - width + 1])
        elif b > a:
            yield mix((words[a:b] * _ODD[2:2 + b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


#: Bytes of one text that are split into words at a time.
RUN_BYTES = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def word_runs(text: bytes) -> Iterator[list[bytes]]:
    """The words of ``text``, A-Z lower-cased, in lists of bounded size."""
    return (run.lower().split() for run in runs(text))


def runs(text: bytes) -> Iterator[bytes]:
    """``text`` in pieces of bounded size, cut between words."""
    if len(text) <= RUN_BYTES:
        yield text
        return
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + RUN_BYTES)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
