"""Word shingles and MinHash signatures of one text, in numpy.

Words are the runs of bytes other than 0x20 and 0x09-0x0D of the text in
UTF-8 with A-Z in lower case; a shingle is five consecutive words, or the
whole sequence of a text that has fewer.  Shingles are 64-bit hashes; a
wrong "equal" needs two different shingles of the compared texts to meet in
64 bits (under 1e-9 for texts of 100,000 words).
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

_U = np.uint64
_MAX_TABLE = 4096  # longer words are hashed one by one


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, element by element."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=None)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    letters = rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
    powers = np.full(_MAX_TABLE, 0x9E3779B97F4A7C15, dtype=np.uint64)
    powers[0] = 1
    return letters, np.multiply.accumulate(powers)


@lru_cache(maxsize=None)
def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(977)
    a = rng.integers(1, 2**63, k, dtype=np.uint64) * _U(2) + _U(1)
    b = rng.integers(0, 2**63, k, dtype=np.uint64)
    return a[:, None], b[:, None]


def split(text: str) -> list[bytes]:
    """The words of a text."""
    return text.encode("utf-8", "replace").lower().split()


def _hash_words(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.empty(0, np.uint64)
    letters, powers = _tables()
    lens = np.fromiter(map(len, words), np.int64, len(words))
    digests = None
    long = np.flatnonzero(lens > _MAX_TABLE)
    if len(long):
        digests = [int.from_bytes(hashlib.blake2b(words[i], digest_size=8).digest(), "big")
                   for i in long]
        words = list(words)
        for i in long:
            words[i] = b"\0"
            lens[i] = 1
    starts = np.zeros(len(words), np.int64)
    np.cumsum(lens[:-1], out=starts[1:])
    raw = np.frombuffer(b"".join(words), np.uint8)
    at = np.arange(len(raw)) - np.repeat(starts, lens)
    h = _mix(np.add.reduceat(letters[raw] * powers[at], starts) + lens.astype(np.uint64))
    if digests:
        h[long] = digests
    return h


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of a text, and their starts and ends (exclusive)
    in code points."""
    data = text.encode("utf-8", "replace").lower()
    raw = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(~_SPACE[raw], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    lens = ends - starts
    if len(lens) and lens.max() > _MAX_TABLE:
        h = _hash_words(data.split())
    elif len(lens):
        letters, powers = _tables()
        first = np.zeros(len(lens), np.int64)
        np.cumsum(lens[:-1], out=first[1:])
        inside = raw[~_SPACE[raw]]
        at = np.arange(len(inside)) - np.repeat(first, lens)
        h = _mix(np.add.reduceat(letters[inside] * powers[at], first) + lens.astype(np.uint64))
    else:
        h = np.empty(0, np.uint64)
    if len(raw) != len(text):  # bytes that continue a character do not count
        chars = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=chars[1:])
        starts, ends = chars[starts], chars[ends]
    return h, starts, ends


def _distinct(x: np.ndarray) -> np.ndarray:
    """``np.unique`` of a non-empty array, with less to do for few values."""
    x = np.sort(x)
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def _windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in order."""
    last = len(h) - width + 1
    acc = np.full(last, width, np.uint64)
    for i in range(width):
        acc = acc * _U(0xD6E8FEB86659FD93) + h[i:i + last]
        acc ^= acc >> _U(32)
    return _mix(acc)


_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 2**64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_ODD, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in order, at a cost that does
    not depend on ``width``: differences of running sums, shifted to the front."""
    if len(h) < width:
        return h[:0]
    size = 1 << max(12, (len(h) - 1).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:len(h)], out=sums[1:])
    last = len(h) - width + 1
    return _mix((sums[width:] - sums[:last]) * down[:last])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Distinct shingle hashes in ascending order; empty for no words."""
    h = _hash_words(split(text or ""))
    return np.unique(_windows(h, min(n, len(h)))) if len(h) else h


def shingles_of(lines: list[list[bytes]], n: int = 5) -> list[np.ndarray]:
    """``shingles`` of several lines of words at once."""
    if not lines:
        return []
    h = _hash_words([w for line in lines for w in line])
    all_windows = _windows(h, n) if len(h) >= n else h
    out, at = [], 0
    for line in lines:
        if len(line) >= n:
            out.append(_distinct(all_windows[at:at + len(line) - n + 1]))
        else:
            out.append(_windows(h[at:at + len(line)], len(line)) if line else h[:0])
        at += len(line)
    return out


def minima(hashes: np.ndarray, k: int) -> np.ndarray:
    """k MinHash minima of a non-empty set of shingle hashes."""
    return minima_of([hashes], k)[0]


def minima_of(sets: list[np.ndarray], k: int, block: int = 1024) -> np.ndarray:
    """k minima of each of several non-empty sets, one row per set."""
    a, b = _permutations(k)
    best = np.full((len(sets), k), np.iinfo(np.uint64).max, np.uint64)
    if not sets:
        return best
    flat = np.concatenate(sets)
    ends = np.cumsum([len(s) for s in sets])
    for i in range(0, len(flat), block):
        x = flat[None, i:i + block] * a
        x += b
        first, last = np.searchsorted(ends, (i, min(i + block, len(flat)) - 1), "right")
        cuts = np.maximum(ends[first:last + 1] - np.array(
            [len(s) for s in sets[first:last + 1]]), i) - i
        rows = best[first:last + 1]
        np.minimum(rows, np.minimum.reduceat(x, cuts, axis=1).T, out=rows)
    return best


def band_keys(mins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` minima, the band's number in
    it; the minima are the last axis."""
    part = _mix(mins[..., :bands * rows].reshape(*mins.shape[:-1], bands, rows))
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), part.shape[:-1])
    for i in range(rows):
        acc = _mix(acc * _U(0x9FB21C651E98DF25) + part[..., i])
    return acc.view(np.int64)


def pack_low_bits(mins: np.ndarray, bits: int) -> np.ndarray:
    """The low ``bits`` bits of the minima (last axis), packed into int64 words.

    The minima are mixed first: a minimum's own low bits are uniform, but
    mixing also makes them independent of the permutation's multiplier.
    """
    low = (_mix(mins) & _U((1 << bits) - 1)).reshape(
        *mins.shape[:-1], mins.shape[-1] * bits // 64, 64 // bits)
    shift = np.arange(64 // bits, dtype=np.uint64) * _U(bits)
    return np.bitwise_or.reduce(low << shift, axis=-1).view(np.int64)


def fingerprint(hashes: np.ndarray) -> bytes:
    """128 bits that name a set: equal sets, equal bytes."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def tune_bands(threshold: float, recall: float, rows: int) -> int:
    """Fewest bands of ``rows`` minima that find a pair at ``threshold``
    with probability ``recall``."""
    miss = 1 - threshold ** rows
    bands = 1
    while miss ** bands > 1 - recall:
        bands += 1
    return bands
