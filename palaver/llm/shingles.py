"""Word shingles of whole texts, in numpy over the Arrow buffers.

Words are runs of bytes other than ASCII white space, with A-Z folded. A word's hash mixes its bytes eight at a time; a
shingle's hash mixes the hashes of its words. Bytes are looked at in steps cut at white space, so a text of any length
needs memory for its word hashes only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from palaver.llm.common import byte_slices, filled, mix64

WORDS = 5
BITS = 54  # of a shingle's hash; the ten bits above number the texts of a slice while they are sorted
K = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], dtype=np.uint64)


def _white(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw - np.uint8(9)) < 5)


def _hashed(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word in raw bytes; a word also ends at each of ``cuts``."""
    n = len(raw)
    buf = np.full(n + 16, 32, dtype=np.uint8)
    buf[:n] = raw + ((raw - np.uint8(65)) < 26) * np.uint8(32)
    inside = ~_white(buf)
    first, last = inside.copy(), inside[:-1] & ~inside[1:]
    first[1:] &= ~inside[:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    start = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - start
    eight = np.ndarray(shape=(n + 9,), dtype="<u8", buffer=buf, strides=(1,))
    h = mix64((eight[start] & _MASK[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * K))
    at, k = np.flatnonzero(size > 8), 8
    while len(at):
        h[at] = mix64(h[at] * K + (eight[start[at] + k] & _MASK[np.minimum(size[at] - k, 8)]))
        k += 8
        at = at[size[at] > k]
    return h, start


def word_hashes(texts: pa.Array, step: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each text)."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    hashes, starts, at = [], [], 0
    while at < len(raw):
        to = at + step
        while to < len(raw) and not _white(raw[to : to + 1])[0]:  # a step ends at white space
            found = np.flatnonzero(_white(raw[to : to + 4096]))
            to += int(found[0]) if len(found) else 4096
        to = min(to, len(raw))
        h, start = _hashed(raw[at:to], offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at)
        hashes.append(h)
        starts.append(start + at)
        at = to
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), offsets))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes (BITS wide) of at most 1024 texts, joined, and the offsets of each text's set."""
    h, count = word_hashes(texts)
    row = np.repeat(np.arange(len(texts)), count)
    parts, rows = [], []
    if len(h) >= WORDS:
        own = row[: len(h) - WORDS + 1] == row[WORDS - 1 :]
        g = h[: len(h) - WORDS + 1]
        for i in range(1, WORDS):
            g = mix64(g * K + h[i : len(h) - WORDS + 1 + i])
        parts.append(g[own])
        rows.append(row[: len(h) - WORDS + 1][own])
    first = np.cumsum(count) - count
    for n in range(1, WORDS):  # fewer words: the whole sequence is one shingle
        short = np.flatnonzero(count == n)
        if len(short):
            g = mix64(np.full(len(short), n, dtype=np.uint64))
            for i in range(n):
                g = mix64(g * K + h[first[short] + i])
            parts.append(g)
            rows.append(short)
    if not parts:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    z = np.sort((np.concatenate(rows).astype(np.uint64) << np.uint64(BITS)) | (np.concatenate(parts) >> np.uint64(64 - BITS)))
    z = z[np.concatenate([[True], z[1:] != z[:-1]])]
    return z & np.uint64((1 << BITS) - 1), np.searchsorted(z >> np.uint64(BITS), np.arange(len(texts) + 1, dtype=np.uint64))


def slices(b: pa.RecordBatch, column: int, most: int = 2_000_000, rows: int = 1024) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of a batch of at most ``rows`` rows and about ``most`` bytes of text, with the texts (null as empty)."""
    texts = filled(b.column(column))
    for at, to in byte_slices(texts, most):
        for k in range(at, to, rows):
            yield b.slice(k, min(rows, to - k)), texts.slice(k, min(rows, to - k))


def contents(g: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A 64-bit number of each set's content."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(g), dtype=np.uint64)])
    return mix64((sums[cut[1:]] - sums[cut[:-1]]) * K + np.diff(cut).astype(np.uint64)).view(np.int64)
