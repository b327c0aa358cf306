"""Vectorised work on the UTF-8 bytes of Arrow text columns: cutting words and hashing ranges without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_MARK = np.ones(256, bool)
_MARK[48:58] = _MARK[65:91] = _MARK[97:123] = _MARK[128:] = False
#: Range hashes are polynomials modulo this prime, at one of these bases; no text pattern collides at every base.
PRIME = (1 << 61) - 1
BASES = (0x0F3C1D59E2A7B684 % PRIME, 0x1B56C4E9D38F2A71 % PRIME)
_P, _P32, _P29 = U64(PRIME), U64((1 << 32) - 1), U64((1 << 29) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_SYMBOLS = mixed(np.arange(1, 257, dtype=np.uint64) * U64(0xA0761D6478BD642F))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about `limit` bytes; a longer text is a run of its own."""
    if not len(column):
        return
    data, offsets = column_bytes(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words of a run: between ASCII blanks, or if plain between all but letters, digits and non-ASCII."""
    inside = ~(_MARK if plain else _BLANK)[data]
    size = len(data)
    before = np.empty(size, bool)
    after = np.empty(size, bool)
    if size:
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edge = offsets[(offsets > 0) & (offsets < size)]
        before[edge] = False
        after[edge - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def pieces(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """As chunks(), but a text longer than `limit` comes in several runs of one row, cut after a blank; last: whether the row ends with the run.

    Only a single word of more than `limit` bytes makes a longer run.
    """
    for first, end, data, offsets in chunks(column, limit):
        if end - first > 1 or len(data) <= 2 * limit:
            yield first, end, data, offsets, True
            continue
        at = 0
        while at < len(data):
            stop = min(at + limit, len(data))
            while stop < len(data):
                blank = np.flatnonzero(_BLANK[data[stop : stop + limit]])
                if len(blank):
                    stop += int(blank[0])
                    break
                stop = min(stop + limit, len(data))
            yield first, end, data[at:stop], np.array([0, stop - at]), stop == len(data)
            at = stop


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & _P) + (x >> U64(61))
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for factors below it, by halves of 32 bits."""
    a1, a0, b1, b0 = a >> U64(32), a & _P32, b >> U64(32), b & _P32
    low, cross, high = a0 * b0, a1 * b0 + a0 * b1, a1 * b1
    cross = _reduced(cross)  # 2**32 of it, that is its upper 32 of 61 bits and its lower 29 bits moved up
    return _reduced(_reduced(low) + ((cross & _P29) << U64(32)) + (cross >> U64(29)) + _reduced(high << U64(3)))


class _Powers:
    """Powers of a base modulo the prime (upper and lower 32 bits) and of its inverse, grown as needed up to a run of usual length."""

    kept: dict[int, tuple[np.ndarray, ...]] = {}

    @staticmethod
    def made(base: int, size: int) -> np.ndarray:
        p = np.ones(1, U64)
        while len(p) < size:
            p = np.append(p, _times(p, np.full(1, pow(base, len(p), PRIME), U64)))
        return p[:size]

    @classmethod
    def of(cls, which: int, size: int) -> tuple[np.ndarray, ...]:
        have = cls.kept.get(which)
        if have is None or len(have[0]) < size:
            power, inverse = (cls.made(b, max(size, CHUNK_BYTES + (1 << 18))) for b in (BASES[which], pow(BASES[which], -1, PRIME)))
            have = (power >> U64(32), power & _P32, inverse)
            if size <= 1 << 22:
                cls.kept[which] = have
        return have


def prefix(data: np.ndarray, which: int = 0) -> np.ndarray:
    """(2, size + 1) prefix sums, by halves of the powers, from which range_hash() takes the hash of any range.

    A sum holds 2**22 terms of 41 bits without a carry; longer runs wrap modulo 2**64, which differences of ranges below that length undo.
    """
    upper, lower, _ = _Powers.of(which, len(data) + 1)
    out = np.zeros((2, len(data) + 1), U64)
    symbol = data.astype(U64) + U64(1)
    np.cumsum(symbol * upper[: len(data)], out=out[0, 1:])
    np.cumsum(symbol * lower[: len(data)], out=out[1, 1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of data[start:end] for arrays of ranges of less than 2**22 bytes; equal bytes have equal hashes wherever they stand.

    Longer ranges are hashed by parts of 2**21 bytes, part after part.
    """
    inverse = _Powers.of(which, sums.shape[1])[2]
    length = (end - start).astype(np.int64)

    def value(a, b):
        upper, lower = _reduced(sums[0, b] - sums[0, a]), _reduced(sums[1, b] - sums[1, a])
        upper = ((upper & _P29) << U64(32)) + (upper >> U64(29))
        return _times(_reduced(upper + lower), inverse[a])

    if len(length) == 0 or length.max() < 1 << 21:
        return mixed(value(start, end) + length.astype(U64) * U64(0xE7037ED1A0B428DB))
    out, at = length.astype(U64), start.copy()
    while (open_ := np.flatnonzero((at < end) | (length == 0))).size:
        stop = np.minimum(at[open_] + (1 << 21), end[open_])
        part = mixed(value(at[open_], stop) + (stop - at[open_]).astype(U64) * U64(0xE7037ED1A0B428DB))
        out[open_] = np.where(length[open_] < 1 << 21, part, mixed(out[open_] + part))
        at[open_] = stop
        length = np.where(length == 0, -1, length)
    return out


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the `size` bytes at each place, modulo 2**64: for choosing places, and for grams far shorter than any pattern that collides."""
    n = len(data)
    power = np.full(n + 1, U64(0x9E3779B97F4A7C15))
    power[0] = 1
    inverse = np.full(n + 1, U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
    inverse[0] = 1
    power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_SYMBOLS[data] * power[:n], out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * inverse[: n - size + 1])


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of characters that start before each byte, and in all."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
