"""Words, shingles and rolling hashes shared by the word-based operators.

A word is `[^\\x20\\x09-\\x0D]+`: exactly what `bytes.split()` yields on UTF-8 text.

Word hashes are made for a block of text at once: every byte's random value times a power of an odd base,
summed from the block's start; a word's hash is the difference of the sums at its ends, taken back to
power zero and mixed. Words over `LONG_WORD` bytes are hashed alone. Nothing is remembered.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

#: Odd multipliers; any fixed odd values do.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
LONG_WORD = 256
#: Bytes of text hashed at once.
BLOCK = 1 << 16
_SPACE = np.zeros(256, np.bool_)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def blocks(text: bytes, size: int = 1 << 20):
    """Lists of the text's words, about `size` bytes of text each, so that few words are objects at once."""
    return map(bytes.split, _cuts(text, size))


def _cuts(text: bytes, size: int):
    """The text in parts of about `size` bytes that end at white space."""
    if len(text) <= size:
        yield text
        return
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        while end < len(text) and text[end] not in b"\t\n\v\f\r ":
            end += 1
        yield text[at:end]
        at = end


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value of each byte, powers of the base, powers of its inverse) for a block."""
    n, base = 2 * BLOCK + 1, int(MULTIPLIERS[1])
    up = np.ones(n, np.uint64)
    down = np.ones(n, np.uint64)
    up[1:], down[1:] = base, pow(base, -1, 1 << 64)
    return mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIERS[0]), np.cumprod(up), np.cumprod(down)


def _hash_block(text: bytes) -> np.ndarray:
    if len(text) > 2 * BLOCK:  # the last word is a long one
        cut = max(text.rfind(x, 0, BLOCK) for x in (b"\t", b"\n", b"\v", b"\f", b"\r", b" ")) + 1
        last = text[cut:].split()
        return np.concatenate([_hash_block(text[:cut]), np.fromiter(map(xxhash.xxh3_64_intdigest, last), np.uint64, len(last))])
    points = np.frombuffer(text, np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[points], prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    value, up, down = _powers()
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(value[points] * up[: len(points)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * MULTIPLIERS[2])
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[start[i] : end[i]])
    return h


def text_hashes(text: bytes) -> np.ndarray:
    """The hash of each word of a text."""
    got = [_hash_block(part) for part in _cuts(text, BLOCK)]
    return got[0] if len(got) == 1 else np.concatenate(got) if got else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k-word window, in order; h has at least k words."""
    n = len(h) - k + 1
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = mix(acc * MULTIPLIERS[0] + h[j : j + n] * MULTIPLIERS[1] + np.uint64(j))
    return acc


def fast_windows(h: np.ndarray, k: int) -> np.ndarray:
    """As `windows`, by a polynomial of the word hashes and one finaliser."""
    n = len(h) - k + 1
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= MULTIPLIERS[0]
        acc += h[j : j + n]
    return mix(acc)
