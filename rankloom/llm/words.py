"""Vectorised word and shingle hashing over UTF-8 buffers, shared by several operators.

All functions take lists of UTF-8 byte strings and work on whole texts.  A word
is a maximal run of non-separator bytes; every byte of a multi-byte code point
is a word byte, so byte-wise and code-point-wise splitting agree.

Short strings are named by a running polynomial modulo 2**64.  Such a hash maps Thue-Morse
strings of 1,024 bytes to one value whatever its base, so strings of LONG bytes or more
are named by a cryptographic hash instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Strings of so many bytes are named by BLAKE2b.
LONG = 64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_SHINGLE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: 1 for a word byte: anything but space and \t..\r.
SPACED = bytes(0 if b == 0x20 or 0x09 <= b <= 0x0D else 1 for b in range(256))
#: 1 for a word byte: 0-9, a-z (upper case is lowered first) and all non-ASCII.
ALNUM = bytes(1 if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0 for b in range(256))

_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        for k, b in enumerate((_BASE, _BASE_INV)):
            p, have = np.ones(m, U64), 1
            while have < m:
                step = min(have, m - have)
                p[have : have + step] = p[:step] * U64(pow(b, have, 1 << 64))
                have += step
            _powers[k] = p
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hash(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums H and inverse powers I: (H[e] - H[s]) * I[s] names buf[s:e]."""
    power, inverse = _power(len(buf) + 1)
    h = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=h[1:])
    return h, inverse


def names(joined: bytes, prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit name of each joined[start:end]; ``prefix``: prefix_hash of the buffer."""
    h, inverse = prefix
    size = end - start
    out = mix((h[end] - h[start]) * inverse[start] + size.astype(U64))
    long = np.flatnonzero(size >= LONG)
    if len(long):
        digests = [hashlib.blake2b(joined[a:b], digest_size=8).digest() for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
        out[long] = np.frombuffer(b"".join(digests), U64)
    return out


def words(texts: list[bytes], kind: bytes = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Of lower-cased texts: word hashes, word starts, word ends, first word of each text (n + 1 entries), the joined buffer."""
    joined = (b" ".join(texts) + b" ").translate(LOWER)
    buf = np.frombuffer(joined, np.uint8)
    inside = np.frombuffer(b"\0" + joined.translate(kind), np.int8)
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = names(joined, prefix_hash(buf), starts, ends)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return hashes, starts, ends, np.searchsorted(starts, bounds), joined


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive hashes."""
    if len(hashes) < n:
        return np.empty(0, U64)
    out = hashes[: len(hashes) - n + 1] * _SHINGLE[0]
    for j in range(1, n):
        out += hashes[j : len(hashes) - n + 1 + j] * _SHINGLE[j]
    return mix(out + U64(n))


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each text; with fewer words the whole sequence is one; none without words."""
    w, _, _, first, _ = words(texts)
    every = windows(w, n)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            s = np.sort(every[a : b - n + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        else:
            out.append(windows(w[a:b], b - a) if b > a else np.empty(0, U64))
    return out


def chunks(column: pa.Array | pa.ChunkedArray, size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) of runs of rows of about ``size`` bytes, at least one row each; null is empty."""
    column = column.cast(pa.binary())
    start, held, total = 0, [], 0
    for k in range(len(column)):
        x = column[k].as_py() or b""
        if held and total + len(x) > size:
            yield start, held
            start, held, total = k, [], 0
        held.append(x)
        total += len(x)
    if held:
        yield start, held
