"""Vectorised word and n-gram hashing over a batch of texts laid end to end as bytes.

Words are runs of bytes outside 0x20 and 0x09-0x0D, as in ``[^\\x20\\x09-\\x0D]+`` on the text. Hashes are 64 bits wide:
a polynomial over the bytes modulo 2**64 with an odd base (so that it can be read off prefix sums), then a finaliser.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**i for i < n, rounded up to a power of two so that few tables are made."""
    return _powers(1 << max(12, (n + 1).bit_length()), int(BASE_INVERSE if inverse else BASE))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(len(buf))[: len(buf)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes in each [start, end)."""
    raw = (prefix[ends] - prefix[starts]) * powers(len(prefix), inverse=True)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(buf: np.ndarray, offs: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of bytes not ``outside``), and for each text (and one past the last) the index of its first word."""
    word = ~outside[buf]
    start, end = word.copy(), word.copy()
    if len(buf) > 1:
        start[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
    edges = offs[(offs > 0) & (offs < len(buf))]  # words never cross texts
    start[edges] = word[edges]
    end[edges - 1] = word[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the index of each text's first word."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    starts, ends, first = word_spans(buf, offs)
    return span_hashes(prefix_hashes(buf), starts, ends), first


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of each pair of hashes; order matters."""
    return mix(first * np.uint64(0x8CB92BA72F3D8DD7) + np.bitwise_xor(second, np.uint64(0x5851F42D4C957F2D)))


def blake_keys(kind: str, n: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same in every process."""
    from hashlib import blake2b

    return np.array([int.from_bytes(blake2b(f"{kind}:{i}".encode(), digest_size=8).digest(), "little") | 1 for i in range(n)], np.uint64)
