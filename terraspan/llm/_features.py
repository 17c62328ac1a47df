"""Vectorised text features: joined buffers, characters, word hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multipliers for hashing.
_BASE = U64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
#: Bytes of text handled at once; longer texts are handled alone.
STEP = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(33))
    h *= _MIX1
    h ^= h >> U64(33)
    h *= _MIX2
    h ^= h >> U64(33)
    return h


def _all_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    back = pow(int(_BASE), -1, 1 << 64)
    return tuple(np.concatenate([np.ones(1, U64), np.multiply.accumulate(np.full(n, x, U64))]) for x in (_BASE, U64(back)))


@lru_cache(1)
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _all_powers(2 * STEP)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; those for usual
    runs of rows are kept (8 MB), longer ones go after use."""
    return _usual_powers() if n <= 2 * STEP else _all_powers(n)


def joined(texts: pa.Array, step: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, buffer, offsets) for runs of rows of about ``step`` bytes.

    Every text in the buffer is followed by one space, so no text is empty
    there and words never cross texts; null counts as empty.
    """
    col = pc.fill_null(texts.cast(pa.large_binary()), b"")
    sizes = pc.binary_length(col).to_numpy(zero_copy_only=False)
    first = 0
    while first < len(col):
        last, total = first, 0
        while last < len(col) and (last == first or total + sizes[last] < step):
            total += sizes[last] + 1
            last += 1
        run = pc.binary_join_element_wise(col.slice(first, last - first), pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary()))
        bufs = run.buffers()
        offsets = np.frombuffer(bufs[1], np.int64)[run.offset : run.offset + len(run) + 1]
        data = np.frombuffer(bufs[2], np.uint8)[offsets[0] : offsets[-1]]
        yield first, last, data, offsets - offsets[0]
        first = last


def characters(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of joined texts, and the offsets in these."""
    texts = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def is_space(buf: np.ndarray) -> np.ndarray:
    return (buf == 32) | ((buf >= 9) & (buf <= 13))


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)


def words(buf: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; the buffer ends with white space."""
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes (or characters)."""
    up, down = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * up[: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(U64) * _MIX2)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets; an empty segment sums to 0."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]
