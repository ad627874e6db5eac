"""Spans of a byte buffer, interned in an open-addressed NumPy table.

Whole arrays of spans are hashed (XXH64) and sent to the table at once: each round looks
at one place of every span still under way.  A free place is claimed; a place that holds
the same hash, size, group and, byte for byte, the same content ends the search; any
other sends the span to the next place.  The table is at most half full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are worked on at once; a longer text is on its own.
CHUNK = 4 << 20
#: Spans that share a table.
BLOCK = 1 << 20
#: Primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def chunks(column: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows, their UTF-8 bytes (null: none) and offsets into them, ``chunk`` bytes or one text at a time."""
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.cast(pa.large_string()).buffers()
    n = len(column)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + chunk, side="right")) - 1)
        yield slice(first, last), data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def padded(buf: np.ndarray) -> np.ndarray:
    """The buffer with room to read eight bytes at any of its places."""
    return np.concatenate((buf, np.zeros(8, np.uint8)))


def _lanes(buf: np.ndarray, kind: str) -> np.ndarray:
    """One little-endian number at every byte of a padded buffer."""
    return np.ndarray(len(buf) - 7, kind, buf, strides=(1,))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hash_spans(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each span of a padded buffer."""
    eights, fours = _lanes(buf, "<u8"), _lanes(buf, "<u4")
    h = P5 + sizes.astype(np.uint64)
    for k in range(3):
        at = np.flatnonzero(sizes >= 8 * (k + 1))
        if not len(at):
            break
        lane = _turn(eights[starts[at] + 8 * k] * P2, 31) * P1
        h[at] = _turn(h[at] ^ lane, 27) * P1 + P4
    done = sizes & ~7
    at = np.flatnonzero(sizes & 4)
    h[at] = _turn(h[at] ^ (fours[starts[at] + done[at]].astype(np.uint64) * P1), 23) * P2 + P3
    done = sizes & ~3
    for k in range(3):
        at = np.flatnonzero((sizes & 3) > k)
        h[at] = _turn(h[at] ^ (buf[starts[at] + done[at] + k].astype(np.uint64) * P5), 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(sizes >= 32):  # few words are so long
        h[i] = xxhash.xxh64_intdigest(buf[starts[i] : starts[i] + sizes[i]])
    return h


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the spans at ``a`` and ``b``, of equal sizes, hold the same bytes."""
    eights, same = _lanes(buf, "<u8"), np.ones(len(a), bool)
    for k in range(0, 64, 8):
        at = np.flatnonzero(sizes > k)
        if not len(at):
            return same
        left = np.uint64(8) * np.maximum(0, 8 - (sizes[at] - k)).astype(np.uint64)
        same[at] &= ((eights[a[at] + k] ^ eights[b[at] + k]) << left) == 0
    for i in np.flatnonzero(sizes > 64):
        same[i] &= bool(np.array_equal(buf[a[i] : a[i] + sizes[i]], buf[b[i] : b[i] + sizes[i]]))
    return same


def intern(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each span, and of each slot the span that claimed it; spans of different groups never share a slot."""
    n = len(starts)
    hashes = hash_spans(buf, starts, sizes)
    if group is not None:
        hashes = hashes ^ _turn(group.astype(np.uint64) * P2, 31) * P1
    mask = (1 << max(4, (2 * n).bit_length())) - 1
    holder = np.full(mask + 1, -1, np.int64)
    at = (hashes & np.uint64(mask)).astype(np.int64)
    held_by, left = np.empty(n, np.int64), np.arange(n)
    while len(left):
        place = at[left]
        free = holder[place] < 0
        holder[place[free]] = left[free]  # of several claims one holds; the others compare with it below
        held = holder[place]
        same = (hashes[held] == hashes[left]) & (sizes[held] == sizes[left])
        if group is not None:
            same &= group[held] == group[left]
        look = np.flatnonzero(same & (held != left))
        same[look] = same_bytes(buf, starts[held[look]], starts[left[look]], sizes[left[look]])
        held_by[left[same]] = held[same]
        left = left[~same]
        at[left] = (at[left] + 1) & mask
    claims = np.flatnonzero(held_by == np.arange(n))
    number = np.empty(n, np.int64)
    number[claims] = np.arange(len(claims))
    return number[held_by], claims
