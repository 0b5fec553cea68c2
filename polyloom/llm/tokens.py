"""Words of many texts at once, hashed in numpy straight from Arrow's buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i below n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have, top = np.ones(1, np.uint64), np.uint64(base)
        with np.errstate(over="ignore"):
            while len(have) < n:
                have = np.concatenate([have, have * top])
                top = top * top
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8), offsets


def portions(texts: pa.Array, most: int = 1_500_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) in runs of whole rows of about ``most`` bytes, so that work arrays stay small."""
    data, offsets = buffers(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Words:
    """The words of a portion: maximal runs of ASCII letters and digits and of any non-ASCII bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        inside = _WORD[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[:-1][offsets[:-1] < n]
        before[edges] = False
        edges = offsets[1:][offsets[1:] > 0] - 1
        after[edges] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.rows = np.searchsorted(offsets, self.starts, "right") - 1
        with np.errstate(over="ignore"):
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(_R, n), out=self._sums[1:])
        self._back = _power_table(_R_INVERSE, n + 1)

    def hashes(self, longest: int | None = None, salt: int = 0) -> np.ndarray:
        """64 bits for each word, or for its first ``longest`` bytes."""
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        with np.errstate(over="ignore"):
            raw = (self._sums[ends] - self._sums[self.starts]) * self._back[self.starts]
            return mix(raw + np.uint64(salt) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
