"""Words and their hashes inside tasks: small helpers on bytes and numpy arrays."""

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

_MIX = np.uint64(0xBF58476D1CE4E5B9)
# Odd bases of the two polynomial hashes (64-bit fractions of the golden ratio and of pi).
BASES = (0x9E3779B97F4A7C15, 0x243F6A8885A308D3)


def text_bytes(column) -> list:
    """UTF-8 bytes of an Arrow string column; None for null."""
    return column.cast(pa.binary()).to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def lower_words(data: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; none for null."""
    return data.lower().split() if data else []


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(h: np.ndarray, size: int, base: int = BASES[0]) -> np.ndarray:
    """A hash for each window of ``size`` consecutive words (none if there are fewer).

    The polynomial of a window is read off prefix sums modulo 2^64: the base is
    odd, so its powers can be divided by. Cost does not depend on ``size``.
    """
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if size <= 6:
        out = h[:n].copy()
        for k in range(1, size):
            out = out * np.uint64(base) + h[k : n + k]
        return mix(out)
    powers, inverse = _powers(base, len(h))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers[: len(h)], out=sums[1:])
    return mix((sums[size:] - sums[:n]) * inverse[:n])


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    kept = _POWERS.get(base)
    if kept is None or len(kept[0]) < n:
        size = (n + 0xFFFF) >> 16 << 16
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        kept = _POWERS[base] = tuple(both)
    return kept
