"""Word and shingle hashing over whole Arrow batches, with numpy.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D); on valid UTF-8 that
equals splitting the text on those characters.  A word's hash is a polynomial over its bytes
modulo 2**64 with a random table of coefficients, then a finaliser, so that one cumulative sum over
a batch's bytes serves all its words.  All constants are derived from fixed seeds: every worker and
every retry computes the same values.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np

U64 = np.uint64
#: Texts are hashed in groups of about this many bytes, which bounds the working memory.
BLOCK_BYTES = 1 << 18


@functools.cache
def constant(name: str) -> np.uint64:
    """An odd 64-bit constant derived from a name."""
    return U64(int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "little") | 1)


_TABLE = np.array([constant(f"byte {i}") for i in range(256)], dtype=U64)
_BASE = constant("base")
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(32))
        x = x * U64(0xD6E8FEB86659FD93)
        x = x ^ (x >> U64(32))
        x = x * U64(0xD6E8FEB86659FD93)
        return x ^ (x >> U64(32))


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for the positions of a block."""
    with np.errstate(over="ignore"):
        up = np.full(BLOCK_BYTES, _BASE, dtype=U64)
        down = np.full(BLOCK_BYTES, _INVERSE, dtype=U64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
    return up, down


def is_space(buf: np.ndarray) -> np.ndarray:
    """Which bytes are ASCII white space."""
    return _SPACE[buf]


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of a byte array."""
    inside = np.empty(len(buf) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_SPACE[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the given byte ranges, which are in order and do not overlap.

    The bytes are taken in pieces of BLOCK_BYTES that end with a range; of a range longer than that the
    pieces are hashed, then the sequence of their hashes.
    """
    if len(starts) == 0:
        return np.empty(0, dtype=U64)
    out = np.empty(len(starts), dtype=U64)
    up, down = _powers()
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + BLOCK_BYTES, side="right"))
        if j <= i:  # one huge word
            cuts = np.arange(base, int(ends[i]), BLOCK_BYTES)
            parts = hash_spans(buf, cuts, np.minimum(cuts + BLOCK_BYTES, ends[i]), lower)
            out[i] = shingles(parts, len(parts))[0]
            i += 1
            continue
        piece = buf[base : int(ends[j - 1])]
        with np.errstate(over="ignore"):
            sums = np.zeros(len(piece) + 1, dtype=U64)
            np.cumsum(_TABLE[_LOWER[piece] if lower else piece] * up[: len(piece)], out=sums[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))
        i = j
    return out


def blocks(texts: list[bytes]) -> list[tuple[int, int]]:
    """Index ranges of consecutive texts of about BLOCK_BYTES each (a longer text is alone)."""
    out, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_BYTES:
            out.append((begin, i))
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        out.append((begin, len(texts)))
    return out


def words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of some texts: bytes joined by spaces, starts, ends, hashes, and the index of each
    text's first word with the total at the end (len(texts) + 1 values)."""
    joined = b" ".join(texts) + b" "
    buf = np.frombuffer(joined, dtype=np.uint8)
    starts, ends = spans(buf)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    first = np.searchsorted(starts, offsets)
    return buf, starts, ends, hash_spans(buf, starts, ends, lower), first


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each position; the last n - 1 positions are left out."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, dtype=U64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, dtype=U64)
        for k in range(n):
            out += hashes[k : k + m] * constant(f"shingle {k}")
        return mix(out)
