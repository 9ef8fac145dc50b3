"""Vectorised word hashing for Arrow tasks.

Word rule: a word is a maximal run of characters other than space, tab, newline,
vertical tab, form feed and carriage return. All six are single ASCII bytes, so
the rule (and lower-casing of A-Z) works on UTF-8 bytes.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 20                      # bytes hashed at a time in a task
_BASE = 0x9E3779B97F4A7C15           # odd multiplier of the rolling word hash


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_multipliers(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK) + 1
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= 4 * CHUNK:
            _POWERS[0] = have
    return have


def word_spans(buf: np.ndarray, doc_starts: np.ndarray, doc_ends: np.ndarray):
    """Start and end byte of every word of a buffer; no word crosses a document's end."""
    is_word = _IS_WORD[buf]
    before = np.empty_like(is_word)
    before[:1] = False
    before[1:] = is_word[:-1]
    before[doc_starts[doc_starts < len(buf)]] = False
    after = np.empty_like(is_word)
    after[-1:] = False
    after[:-1] = is_word[1:]
    after[doc_ends[doc_ends > 0] - 1] = False
    return np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1


def _hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    up, down = _powers(len(buf))
    sums = np.empty(len(buf) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[buf] * up[:len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def doc_words(buf: np.ndarray, offsets: np.ndarray, lower: bool):
    """Yield (first document, word hashes, words of each document) over groups of
    documents of about CHUNK bytes; a longer document forms a group of its own and
    is hashed piece by piece, cut at white space."""
    n = len(offsets) - 1
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1
        j = min(max(j, i + 1), n)
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= CHUNK or j > i + 1:
            part = buf[lo:hi]
            starts, ends = word_spans(part, offsets[i:j] - lo, offsets[i + 1:j + 1] - lo)
            counts = np.diff(np.searchsorted(starts, offsets[i:j + 1] - lo))
            yield i, _hash_words(part, starts, ends, lower) if len(part) else np.empty(0, np.uint64), counts
        else:
            pieces, at = [], lo
            while at < hi:
                cut = min(at + CHUNK, hi)
                while cut < hi and _IS_WORD[buf[cut]]:
                    run = np.flatnonzero(~_IS_WORD[buf[cut:cut + CHUNK]])
                    cut = cut + int(run[0]) if len(run) else min(cut + CHUNK, hi)
                part = buf[at:cut]
                starts, ends = word_spans(part, np.array([0]), np.array([len(part)]))
                pieces.append(_hash_words(part, starts, ends, lower))
                at = cut
            h = np.concatenate(pieces)
            yield i, h, np.array([len(h)])
        i = j


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column (nulls count as empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, offsets


def shingle_hashes(h: np.ndarray, counts: np.ndarray, size: int):
    """Hashes of the runs of ``size`` words in each document and their number; a
    document with fewer words has its whole sequence as one, without words none."""
    total = len(h)
    per_doc = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    q = np.uint64(0xC2B2AE3D27D4EB4F)
    roll = np.zeros(max(total - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        if len(roll):
            roll = roll * q + h[k:k + len(roll)]
    out = np.empty(int(per_doc.sum()), dtype=np.uint64)
    ends = np.cumsum(per_doc)
    begin = ends - per_doc
    full = counts >= size
    if len(out):
        keep = np.arange(len(out)) - np.repeat(begin, per_doc) + np.repeat(first, per_doc)
        is_full = np.repeat(full, per_doc)
        out[is_full] = mix64(roll[keep[is_full]])
    for length in range(1, size):               # short documents: one shingle of the whole
        short = np.flatnonzero(counts == length)
        x = np.full(len(short), length, dtype=np.uint64)
        for k in range(length):
            x = x * q + h[first[short] + k]
        out[begin[short]] = mix64(x ^ np.uint64(0x5851F42D4C957F2D))
    return out, per_doc
