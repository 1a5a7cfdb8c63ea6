"""MD5 of many short texts at once, in arrays: the same digests as any engine's, for draws that are keyed by text."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes of a message that fit one block with its mark and length.
ONE_BLOCK = 55
_K = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
_TURN = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_WORD = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]


def prefixes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as their bytes and ``offsets`` into them -> a row of at least 64 bytes for each, and their lengths."""
    n = np.diff(offsets)
    rows = np.zeros((len(n), max(64, int(n.max(initial=0)))), np.uint8)
    at = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], n) + np.repeat(np.arange(len(n)) * rows.shape[1], n)
    rows.ravel()[at] = data[offsets[0] : offsets[-1]]
    return rows, n


def first_words(rows: np.ndarray, n: np.ndarray, suffix: bytes) -> np.ndarray:
    """The first 32 bits of the MD5 of each row's first ``n`` bytes and ``suffix``: its first eight hex digits as a number."""
    if n.max(initial=0) + len(suffix) > ONE_BLOCK:
        return np.array([int(hashlib.md5(r[:k].tobytes() + suffix).hexdigest()[:8], 16) for r, k in zip(rows, n)], np.uint32)
    block, each = rows[:, :64].copy(), np.arange(len(n)) * 64 + n
    for i, c in enumerate(suffix + b"\x80"):
        block.ravel()[each + i] = c
    words = np.ascontiguousarray(block.view("<u4").T)
    words[14] = (n + len(suffix)) * 8
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(len(n), x, np.uint32) for x in start)
    f = np.empty_like(a)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += f
        a += words[_WORD[kind](i)]
        a += _K[i]
        turn = _TURN[kind][i % 4]
        np.right_shift(a, 32 - turn, out=f)
        a <<= turn
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return (a + start[0]).byteswap()
