"""Vectorised word kernels over Arrow string columns: word places, word hashes and shingle hashes without a loop a word.

Everything works on the UTF-8 bytes of many documents at once. A word is [^\\x20\\x09-\\x0D]+; those six separators are
single bytes below 0x80, so words of bytes and words of code points are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer document is handled alone.
CHUNK = 1 << 20
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of a stretch that are hashed eight at a time for all stretches at once; longer ones have a digest each.
_LONG = 256
_FRONT = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
_ODD = U64(0x9E3779B97F4A7C15)


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, with zeros behind the end."""
    data = np.zeros(len(buf) + 8, np.uint8)
    data[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", data, strides=(1,))


def chunks(ids: pa.Array, texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, first row, rows) of runs of documents with about most bytes; null texts are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)  # the bytes stay where they are
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        b = min(b, n)
        yield buf[off[a] : off[b]], off[a : b + 1] - off[a], a, b - a
        a = b


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each document the index of its first word (and the number of all)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~SPACE[buf]
    cut = np.ones(n + 1, bool)
    cut[1:n] = ~solid[:-1]
    cut[off] = True
    starts = np.flatnonzero(solid & cut[:n])
    cut[: n - 1] = ~solid[1:]
    cut[n - 1] = True
    inner = off[1:]
    cut[inner[inner > 0] - 1] = True
    ends = np.flatnonzero(solid & cut[:n]) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each stretch; fold: A-Z count as a-z.

    The length and then eight bytes after eight go through a mixer, so a byte's place counts in a way that no arithmetic
    relation between texts can cancel; stretches of up to eight bytes never collide with others of their length.
    """
    if not len(starts):
        return np.zeros(0, U64)
    if fold:
        buf = _LOWER[buf]
    eights, size = _eights(buf), ends - starts
    with np.errstate(over="ignore"):
        h = mix64(size.astype(U64) * _ODD + U64(1))
        live, at, left = np.flatnonzero(size <= _LONG), starts, size
        at, left = at[live], left[live]
        while len(live):
            h[live] = mix64(h[live] ^ (eights[at] & _FRONT[np.minimum(left, 8)]))
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(np.ascontiguousarray(buf[starts[i] : ends[i]]), digest_size=8).digest(), "little")
    return h


def gram_hashes(buf: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size bytes (8 at most), at the run's first byte; the last size - 1 bytes start none."""
    n = max(0, len(buf) - size + 1)
    with np.errstate(over="ignore"):
        return mix64((_eights(buf)[:n] & _FRONT[size]) * _ODD + U64(size))


def digests(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers of a 128-bit digest of each document's values h[first[i]:first[i + 1]], in their order."""
    h = np.ascontiguousarray(h, "<u8")
    raw = b"".join(hashlib.blake2b(h[a:b], digest_size=16).digest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
    return np.frombuffer(raw, "<u8").reshape(-1, 2).T


def window_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of k values, at the run's first index; the last k - 1 values start none.

    Runs of doubling width are made of their halves, through a mixer at each step.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        part, width = mix64(h + U64(salt) * _ODD), 1
        total, done = None, 0
        while True:
            if k & width:
                piece = part[done : done + n]
                total = piece if total is None else mix64(total * _ODD + piece)
                done += width
            if width * 2 > k:
                return total
            part = mix64(part[:-width] * _ODD + part[width:])
            width *= 2


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Whether a word starts a run of k words inside its document. first: as words() gives it."""
    n = int(first[-1])
    ok = np.ones(n, bool)
    for back in range(k - 1):
        at = first[1:] - 1 - back
        ok[at[at >= first[:-1]]] = False
    return ok


def owner(first: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
