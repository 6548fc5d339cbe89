"""Seeded uniform numbers that do not depend on how rows are partitioned."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _bits(*key: Column | str | int, digits: int = 8) -> Column:
    parts = [F.lit(k).cast("string") if isinstance(k, int) else (F.col(k) if isinstance(k, str) else k).cast("string") for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, digits), 16, 10)


def uniform(*key: Column | str | int) -> Column:
    """A number in [0, 1) of the key: column names, columns or integers."""
    return _bits(*key).cast("double") / F.lit(4294967296.0)


def uniform_int(n: int, *key: Column | str | int) -> Column:
    """An integer in 0 ... n - 1 of the key."""
    return (_bits(*key).cast("long") % n).cast("int")


def uniform_fine(*key: Column | str | int) -> Column:
    """As :func:`uniform`, in steps of 2 ** -52: for draws among very many."""
    return _bits(*key, digits=13).cast("double") / F.lit(4503599627370496.0)


def uniforms(prefix: str, n: int) -> list[float]:
    """The numbers of :func:`uniform` for the keys ``prefix:0`` ... ``prefix:(n - 1)``, outside of Spark."""
    return [int(hashlib.md5(b"%s:%d" % (prefix.encode(), i)).hexdigest()[:8], 16) / 4294967296.0 for i in range(n)]


#: Keys that are hashed together: their words stay in the cache.
_BATCH = 1 << 14
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(np.sin(i + 1)) * 2**32)) for i in range(64)]
_PLACES = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
#: Bytes of the longest message that MD5 takes in one block.
_ONE_BLOCK = 55


def _md5_starts(words: np.ndarray) -> np.ndarray:
    """The first four bytes, as a number, of the MD5 of messages of one padded block each; ``words``: 16 rows of uint32."""
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, high = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _SINES[i]
        f += words[_PLACES[i]]
        shift = _SHIFTS[i // 16][i % 4]
        np.left_shift(f, np.uint32(shift), out=high)
        f >>= np.uint32(32 - shift)
        f |= high
        f += b
        # the array of a is free: it holds the next round's f
        a, b, c, d, f = d, f, b, c, a
    return (a + np.uint32(0x67452301)).byteswap()


def uniforms_of(prefixes: Sequence[str], counts: Sequence[int]) -> np.ndarray:
    """:func:`uniforms` of each prefix and its number, one after the other, hashed together."""
    heads = [b"%s:" % p.encode() for p in prefixes]
    counts = np.asarray(counts, np.int64)
    longest = max((len(h) for h in heads), default=0) + len(str(int(counts.max(initial=1)) - 1))
    if longest > _ONE_BLOCK:
        return np.concatenate([uniforms(p, n) for p, n in zip(prefixes, counts.tolist())])
    head = np.frombuffer(b"".join(h.ljust(64, b"\0") for h in heads), np.uint8).reshape(-1, 64)
    size = np.array([len(h) for h in heads], np.int64)
    owner = np.repeat(np.arange(len(heads)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.empty(len(owner))
    for start in range(0, len(owner), _BATCH):
        own, n = owner[start : start + _BATCH], number[start : start + _BATCH]
        message, end = head[own], size[own]
        flat = message.reshape(-1)
        end += np.arange(len(own)) * 64
        for digit in range(len(str(int(n.max()))) - 1, -1, -1):
            has = np.flatnonzero(n >= 10**digit) if digit else slice(None)
            flat[end[has]] = n[has] // 10**digit % 10 + 48
            end[has] += 1
        flat[end] = 0x80
        words = message.view("<u4")
        words[:, 14] = 8 * (end - np.arange(len(own)) * 64)
        out[start : start + _BATCH] = _md5_starts(np.ascontiguousarray(words.T).astype(np.uint32, copy=False)) / 4294967296.0
    return out
