"""Words of whole texts as 64-bit hashes, computed by numpy over Arrow buffers.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased text. Its hash
is a polynomial over its UTF-8 bytes, mixed. Nothing is computed row by row: one block of about half a megabyte of
text is a handful of array operations. A text longer than a block is cut between words, so memory beyond its word
hashes does not grow with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a block, and rows that are lower-cased and copied at once.
BLOCK, ROWS = 1 << 19, 1024
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_Q = 0xD1342543DE82EF95
_QINV = pow(_Q, -1, 1 << 64)

_WORD = np.zeros(256, dtype=bool)
for _r in ((48, 58), (97, 123), (128, 256)):
    _WORD[_r[0] : _r[1]] = True

_pows: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    have = _pows.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n).bit_length())
        step = np.full(size, base, dtype=np.uint64)
        step[0] = 1
        have = _pows[base] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n + 1 row offsets into them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def _words(seg: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word in ``seg`` and its hash; no word crosses a break."""
    w = _WORD[seg]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    b = breaks[(breaks > 0) & (breaks < len(seg))]
    first[b] = w[b]
    last[b - 1] = w[b - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    c = np.zeros(len(seg) + 1, dtype=np.uint64)
    np.cumsum(seg * powers(_P, len(seg)), out=c[1:])
    return s, mix((c[e + 1] - c[s]) * powers(_PINV, len(seg))[s])


def word_blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, offsets of each row's words) for blocks that cover all rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for first in range(0, len(texts), ROWS):
        for lo, hi, h, off in _row_blocks(*text_bytes(texts.slice(first, ROWS))):
            yield first + lo, first + hi, h, off


def _row_blocks(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK, side="right")) - 1)
        seg, rel = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        if len(seg) <= 2 * BLOCK:
            s, h = _words(seg, rel)
            yield lo, hi, h, np.searchsorted(s, rel)
        else:  # one long text
            parts, at = [], 0
            while at < len(seg):
                end = min(at + BLOCK, len(seg))
                gaps = np.flatnonzero(~_WORD[seg[at:end]])
                if end < len(seg):
                    if len(gaps):
                        end = at + int(gaps[-1]) + 1
                    else:  # a word longer than a block is kept whole
                        while end < len(seg) and _WORD[seg[end]]:
                            end += 1
                parts.append(_words(seg[at:end], np.zeros(0, np.int64))[1])
                at = end
            h = np.concatenate(parts)
            yield lo, hi, h, np.array([0, len(h)])
        lo = hi


def spans(h: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp: the hash of h[i : i + size] for every i, each from one subtraction of prefix sums."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    c = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * powers(_Q, len(h)), out=c[1:])
    return mix((c[size:] - c[:n]) * powers(_QINV, n))


def within(offsets: np.ndarray, size: int) -> np.ndarray:
    """For every word, whether ``size`` words from it on lie in its own row."""
    n = int(offsets[-1])
    ends = np.repeat(offsets[1:], np.diff(offsets))
    return np.arange(n) + size <= ends


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
