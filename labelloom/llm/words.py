"""Words of many texts at once, as spans and 64-bit hashes over one byte or code point array."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = U(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A value for each byte, so that zero bytes count and sums do not cancel.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))


class Powers:
    """Powers of the base and of its inverse, made longer as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.concatenate(([U(1)], np.full(size - 1, _BASE))), dtype=U)
            self.down = np.cumprod(np.concatenate(([U(1)], np.full(size - 1, _BASE_INVERSE))), dtype=U)
        return self.up[:n], self.down[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of each span of ``values`` (uint64), the same wherever the span lies."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and where each begins (one more at the end); null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@dataclass
class Words:
    """Words of several texts: spans in ``data`` and the first word of each text (one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_text())


def find_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of positions for which ``inside`` is true; a run ends with its text."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(last) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))
