"""Polynomial hashes of byte ranges, modulo 2**64, in numpy."""

import numpy as np

R = np.uint64(0x9E3779B97F4A7C15)
_RI = np.uint64(pow(int(R), -1, 1 << 64))
BYTE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_Powers.up):
        size = max(n, 2 * len(_Powers.up), 1 << 16)
        _Powers.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, R))])
        _Powers.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _RI))])
    return _Powers.up, _Powers.down


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """``of(starts, length)``: hashes of equally long ranges of ``data``; equal bytes have equal hashes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = powers(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        spread = BYTE.take(data)
        spread *= up[:n]
        np.cumsum(spread, out=self.total[1:])

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        return mix((self.total[starts + length] - self.total[starts]) * self.down[starts])


    def run(self, first: int, n: int, length: int) -> np.ndarray:
        """``of`` the ``n`` neighbouring starts from ``first`` on, without gathering."""
        h = self.total[first + length : first + n + length] - self.total[first : first + n]
        h *= self.down[first : first + n]
        return mix_in_place(h)


def mix_in_place(h: np.ndarray) -> np.ndarray:
    """``mix``, in the array itself."""
    t = h >> np.uint64(29)
    for factor, shift in ((0xBF58476D1CE4E5B9, 32), (0x94D049BB133111EB, 29)):
        h ^= t
        h *= np.uint64(factor)
        np.right_shift(h, np.uint64(shift), out=t)
    h ^= t
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])
