"""Vectorised kernels over UTF-8 bytes that the operators of this subpackage share.

Texts are laid end to end in one byte array (a *slab*) of bounded size, so that every
kernel is a handful of numpy passes over memory that fits a core's cache, whatever the
length of the single documents. Hashes are polynomial in the bytes of a range, modulo
2**64 with an odd base, which makes the hash of any range two look-ups in a prefix sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
_MASK = (1 << 64) - 1
#: Odd base of the polynomial, and its inverse modulo 2**64.
BASE = 0x9E6C63D0876A9A63 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes beyond which a word is named by a cryptographic hash.
LONG = 64
#: Bytes of text that one slab holds (one longer document makes a longer slab).
SLAB = 1 << 20


def splitmix(seed: int, n: int) -> np.ndarray:
    """n well mixed 64-bit numbers by a rule, the same everywhere."""
    z = (np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) + U(seed & _MASK)
    return mix(z)


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


_BYTE = splitmix(11, 256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_pow: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n at least, kept between calls."""
    if not _pow or len(_pow["p"]) < n:
        m = max(n, SLAB + (1 << 16))
        for name, base in (("p", BASE), ("q", BASE_INV)):
            a = np.full(m, U(base), dtype=U)
            a[0] = U(1)
            _pow[name] = np.multiply.accumulate(a)
    return _pow["p"], _pow["q"]


def prefix_sums(b: np.ndarray) -> np.ndarray:
    p, _ = powers(len(b) + 1)
    s = np.empty(len(b) + 1, dtype=U)
    s[0] = 0
    np.cumsum(_BYTE[b] * p[: len(b)], out=s[1:])
    return s


def range_hashes(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the byte ranges [start, end) under prefix sums s."""
    _, q = powers(len(s))
    return mix((s[end] - s[start]) * q[start] + (end - start).astype(U))


def gram_hashes(s: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of every k-byte window."""
    _, q = powers(len(s))
    n = len(s) - k
    if n <= 0:
        return np.empty(0, dtype=U)
    return mix((s[k:] - s[:n]) * q[:n])


def slabs(texts: Iterable[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets): rows of at most SLAB bytes together."""
    buf: list[bytes] = []
    first, size, i = 0, 0, -1
    for i, t in enumerate(texts):
        raw = b"" if t is None else t.encode("utf-8", "surrogatepass")
        if buf and size + len(raw) > SLAB:
            yield first, i, *_laid(buf)
            buf, first, size = [], i, 0
        buf.append(raw)
        size += len(raw)
    if buf:
        yield first, i + 1, *_laid(buf)


def _laid(buf: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    off = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in buf], out=off[1:])
    return np.frombuffer(b"".join(buf), dtype=np.uint8), off


def lowered(b: np.ndarray) -> np.ndarray:
    """A-Z to lower case, all other bytes as they are."""
    return _LOWER[b]


def words(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs without ASCII white space, and per document the
    index of its first word (one more entry at the end). Words never cross documents."""
    word = np.zeros(len(b) + 2, dtype=bool)
    word[1:-1] = ~_SPACE[b]
    cut = np.zeros(len(b) + 1, dtype=bool)
    cut[off] = True
    now, before = word[1:], word[:-1]
    starts = np.flatnonzero(now & (~before | cut))
    ends = np.flatnonzero(before & (~now | cut))
    return starts, ends, np.searchsorted(starts, off)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, in log2(w) passes."""
    if len(x) < w:
        return np.empty(0, dtype=x.dtype)
    have, m = 1, x
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = w - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def shingle_hashes(b: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle of `width` words and the document row it belongs to. A
    document with fewer words, yet one at least, has its whole sequence as one shingle."""
    starts, ends, at = words(b, off)
    if not len(starts):
        return np.empty(0, dtype=U), np.empty(0, dtype=np.int64)
    h = range_hashes(prefix_sums(b), starts, ends)
    # modulo 2**64 long words made on purpose can share a polynomial, whatever its base
    for i in np.flatnonzero(ends - starts > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(b[starts[i] : ends[i]], digest_size=8).digest(), "little")
    n = len(h)
    mul = splitmix(23, width) | U(1)
    acc = np.zeros(n, dtype=U)
    count = np.diff(at)
    row = np.repeat(np.arange(len(count)), count)
    left = at[row + 1] - np.arange(n)
    for j in range(width):
        term = np.zeros(n, dtype=U)
        term[: max(0, n - j)] = h[j:] * mul[j] if j else h * mul[0]
        short = left <= j
        term[short] = 0
        acc += mix(term + U(j)) if j else term
    keep = (left >= width) | ((count[row] < width) & (np.arange(n) == at[row]))
    return mix(acc[keep] + np.minimum(count[row], width).astype(U)[keep]), row[keep]
