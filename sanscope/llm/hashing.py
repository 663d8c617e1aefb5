"""Vectorised 64-bit hashes of words and word shingles (numpy, used inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Words are hashed in pieces of about so many bytes, cut at white space, to bound memory.
PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply, twice): a bijection that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(33)
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def constants(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit numbers, the same on every machine."""
    return mix(np.arange(1, n + 1, dtype=U) + U(salt << 32)) | U(1)


_BYTE = constants(256, 1)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BASE = U(0x9E3779B97F4A7C15)


def inverse(a: int) -> int:
    return pow(int(a), -1, 1 << 64)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown when a piece needs more."""

    def __init__(self, base: int):
        self.base, self.n = int(base), 0
        self.up = self.down = np.zeros(0, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            one = np.ones(n, U)
            one[1:] = U(self.base)
            back = np.ones(n, U)
            back[1:] = U(inverse(self.base))
            up, down = np.cumprod(one), np.cumprod(back)
            if n > 4 * PIECE:  # a rare giant word: not kept
                return up, down
            self.n, self.up, self.down = n, up, down
        return self.up, self.down


_POWERS = Powers(int(_BASE))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word of ``data``; words are runs of bytes other than white space."""
    hashes, starts, at, n = [], [], 0, len(data)
    whole = np.frombuffer(data, np.uint8)
    while at < n:
        end = min(n, at + PIECE)
        while end < n:  # cut at white space; a longer word makes a longer piece
            gap = np.flatnonzero(_SPACE[whole[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
                break
            end = min(n, end + PIECE)
        piece = whole[at:end]
        space = _SPACE[piece]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
        first, last = edge[0::2], edge[1::2]
        if len(first):
            up, down = _POWERS.to(len(piece) + 1)
            total = np.zeros(len(piece) + 1, U)
            np.cumsum(_BYTE[piece] * up[: len(piece)], out=total[1:])
            hashes.append(mix((total[last] - total[first]) * down[first]))
            starts.append(first + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, U), np.zeros(0, np.int64))


def document_words(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, word hashes, word bounds per document) for runs of documents of bounded size."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= 2 * PIECE):
            size += len(texts[end])
            end += 1
        part = texts[at:end]
        h, first = word_hashes(b"\n".join(part))
        begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
        yield at, h, np.searchsorted(first, begin)
        at = end


def shingle_sets(texts: list[bytes], words: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Fewer words than ``words``: the whole
    sequence as one; no words: none. Texts must be lower-cased already."""
    salt = constants(words, 2)
    for _, h, bound in document_words(texts):
        n = len(h) - words + 1
        if n > 0:
            full = h[:n] * salt[0]
            for k in range(1, words):
                full += h[k : k + n] * salt[k]
            full = mix(full)
        for d in range(len(bound) - 1):
            a, b = int(bound[d]), int(bound[d + 1])
            if b - a >= words:
                yield np.unique(full[a : b - words + 1])
            elif b > a:
                yield mix((h[a:b] * salt[: b - a]).sum(keepdims=True, dtype=U) + U(b - a))
            else:
                yield np.zeros(0, U)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, nulls as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]
