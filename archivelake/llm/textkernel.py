"""Vectorised word and n-gram hashing over whole Arrow batches of texts.

All functions work on the UTF-8 bytes of many texts at once.  A byte range is read
in pieces of eight bytes, each scrambled with its place, and the results are added:
no choice of letters makes two ranges collide by arithmetic alone.  Consecutive words
are hashed by a rolling polynomial modulo the prime 2**61 - 1, as the difference of
two prefix sums scaled back by a power of the inverse base, so every window costs the
same whatever its length.  ``salt`` gives hashes that are independent of each other.
Where a decision must not rest on hashes, ``same_ranges`` and ``same_words`` compare bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and multiply, twice)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: The modulus of rolling hashes, a prime.
PRIME = (1 << 61) - 1
_P = _U(PRIME)
_LOW32 = _U((1 << 32) - 1)
_LOW30 = _U((1 << 30) - 1)
#: What is kept of eight bytes when only the first n count.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _reduced(x: np.ndarray) -> np.ndarray:
    """64-bit integers modulo ``PRIME``."""
    x = (x & _P) + (x >> _U(61))
    return np.minimum(x, x - _P)  # wraps round where x is below


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo ``PRIME`` of integers below it, by halves of 32 bits."""
    ah, al, bh, bl = a >> _U(32), a & _LOW32, b >> _U(32), b & _LOW32
    middle = ah * bl + al * bh  # times 2**32
    low = al * bl
    total = ((ah * bh) << _U(3)) + (middle >> _U(29)) + ((middle & _U((1 << 29) - 1)) << _U(32)) + (low & _P) + (low >> _U(61))
    return _reduced(total)


class _Powers:
    """Powers of a base and of its inverse modulo ``PRIME``, extended on demand."""

    def __init__(self, base: int) -> None:
        self.bases = base, pow(base, -1, PRIME)
        self.powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.powers[0]) < n:
            size = len(self.powers[0])
            self.powers = [np.concatenate([p, _times(p, _U(pow(b, size, PRIME)))]) for p, b in zip(self.powers, self.bases, strict=True)]
        return self.powers[0][:n], self.powers[1][:n]


_POWERS = [_Powers(0x9E3779B97F4A7C15 % PRIME), _Powers(0xC2B2AE3D27D4EB4F % PRIME)]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``most`` text bytes each (one row at least)."""
    at = batch.schema.get_field_index(column)
    _, offsets = texts_of(batch.column(at))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


class Words:
    """The words of the texts of a column: maximal runs without ASCII white space.

    start, end: byte positions in ``raw``; doc: index of the text of each word;
    first: index of the first word of each text, one entry more than texts.
    """

    def __init__(self, column: pa.Array, lower: bool = False) -> None:
        self.raw, self.offsets = texts_of(column)
        if lower:
            self.raw = LOWER[self.raw]
        n = len(self.raw)
        dark = ~IS_SPACE[self.raw]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = dark[:-1]
        self.start = np.flatnonzero(dark & (~before | edge[:n]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = dark[1:]
        self.end = np.flatnonzero(dark & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, salt: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return ranges(self.raw, self.start, self.end, salt)

    def chars(self) -> np.ndarray:
        """Code points of each word."""
        heads = np.concatenate([[0], np.cumsum((self.raw & 0xC0) != 0x80)])
        return heads[self.end] - heads[self.start]

    def windows(self, n: int) -> np.ndarray:
        """Indexes of the first words of all windows of ``n`` words inside one text."""
        at = np.arange(max(0, len(self) - n + 1))
        return at[at + n <= self.first[1:][self.doc[at]]]


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``raw`` on, zeros beyond its end, as little-endian integers."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray(len(raw) + 1, "<u8", padded.data, strides=(1,))


def _pieces(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(range, place in it in bytes, first piece of each range) of the pieces of ranges of ``size`` bytes."""
    many = (size + 7) >> 3
    first = np.concatenate([[0], np.cumsum(many)])
    owner = np.repeat(np.arange(len(size)), many)
    return owner, (np.arange(first[-1]) - first[owner]) << 3, first[:-1]


def ranges(raw: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range of ``raw``."""
    with np.errstate(over="ignore"):
        key = _U(salt) * _U(0xD6E8FEB86659FD93)
        eights, size = _eights(raw), np.asarray(end - start)
        out = mix((eights[start] & _KEEP[np.minimum(size, 8)]) ^ mix(key + _BASE))
        long = np.flatnonzero(size > 8)
        if len(long):
            owner, place, first = _pieces(size[long])
            left = np.minimum(size[long][owner] - place, 8)
            terms = mix((eights[start[long][owner] + place] & _KEEP[left]) ^ mix(key + (place + 1).astype(np.uint64) * _BASE))
            out[long] = np.add.reduceat(terms, first)
        return mix(out ^ mix(size.astype(np.uint64) + key + _U(1)))


def same_ranges(raw: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether byte ranges are equal, byte by byte, to other ones."""
    size = end - start
    out = size == other_end - other
    at = np.flatnonzero(out & (size > 0))
    if len(at):
        eights = _eights(raw)
        owner, place, first = _pieces(size[at])
        left = np.minimum(size[at][owner] - place, 8)
        differ = (eights[start[at][owner] + place] ^ eights[other[at][owner] + place]) & _KEEP[left]
        out[at] = np.bitwise_or.reduceat(differ, first) == 0
    return out


def same_words(words: Words, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Whether the ``n`` words from each of ``a`` on equal those from ``b`` on, byte by byte."""
    out = np.ones(len(a), bool)
    for i in range(n):
        x, y = a + i, b + i
        out &= same_ranges(words.raw, words.start[x], words.end[x], words.start[y], words.end[y])
    return out


class Rolling:
    """Hashes of consecutive entries of ``hashes``, for windows of any number."""

    def __init__(self, hashes: np.ndarray, salt: int = 0) -> None:
        up, self.down = _POWERS[salt].get(len(hashes) + 1)
        terms = _times(_reduced(hashes), up[: len(hashes)])
        # Two sums, of the upper and the lower bits, so that neither runs over.
        upper, lower = (np.concatenate([[_U(0)], np.cumsum(x, dtype=np.uint64)]) for x in (terms >> _U(30), terms & _LOW30))
        upper = _reduced(upper)
        self.total = _reduced((upper >> _U(31)) + ((upper & _U((1 << 31) - 1)) << _U(30)) + _reduced(lower))

    def windows(self, at: np.ndarray, n: int) -> np.ndarray:
        """A 64-bit hash of the ``n`` entries from each of ``at``."""
        between = _reduced(self.total[at + n] + _P - self.total[at])
        with np.errstate(over="ignore"):
            return mix(_times(between, self.down[at]) + _U(n) * _U(0xD1B54A32D192ED03))


def window_hashes(hashes: np.ndarray, at: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``n`` consecutive entries of ``hashes`` from each of ``at``."""
    return Rolling(hashes, salt).windows(at, n)


def covered(size: int, at: np.ndarray, n: int) -> np.ndarray:
    """Which of ``size`` positions lie in a window of ``n`` from one of ``at``."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + n, -1)
    return np.cumsum(change)[:size] > 0


def twins(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of entries with one hash in one text: k - 1 pairs, which connect them, for k entries."""
    with np.errstate(over="ignore"):
        key = mix(hashes + mix(doc.astype(np.uint64) * _BASE + _U(7)))
    order = np.argsort(key)
    ranked = key[order]
    at = np.flatnonzero(ranked[1:] == ranked[:-1])
    a, b = order[at], order[at + 1]
    same = (doc[a] == doc[b]) & (hashes[a] == hashes[b])
    return a[same], b[same]
