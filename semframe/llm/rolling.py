"""Rolling hashes of character windows, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
UNBASE = pow(BASE, -1, 1 << 64)


def scrambled(values: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each value."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            factors = np.ones(n, np.uint64)
            factors[1:] = BASE
            self.up = np.cumprod(factors, dtype=np.uint64)
            factors[1:] = UNBASE
            self.down = np.cumprod(factors, dtype=np.uint64)


class Sums:
    """Running sums of a slice of code points, from which the hash of any of
    its stretches follows."""

    def __init__(self, codes: np.ndarray, powers: Powers):
        n = len(codes)
        powers.reach(n + 1)
        self.down = powers.down
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(scrambled(codes + np.uint64(0x51ED27)) * powers.up[:n], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return scrambled((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, length: int) -> np.ndarray:
        """Hash of each window of ``length`` code points, by its start."""
        n = len(self.sums) - length
        return scrambled((self.sums[length:] - self.sums[:-length]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def window_hashes(codes: np.ndarray, length: int, powers: Powers) -> np.ndarray:
    return Sums(codes, powers).windows(length)


POSITION = np.uint64((1 << 21) - 1)


def least_blocks(sums: Sums, last: np.ndarray, block: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, counts, hash)`` of the runs of neighbouring windows of
    ``length`` that have one least block of ``block`` code points.  ``last``
    tells of each position how many of its text follow in the slice, so that no
    window lies in two texts.  Of equal blocks the first counts."""
    h = sums.windows(block)
    w = length - block + 1
    whole = np.flatnonzero(last[: max(0, len(last) - length + 1)] >= length - 1)
    if not len(whole):
        return whole, whole, np.zeros(0, np.uint64)
    # a slice has fewer than 2**21 positions: the upper bits of the hash, then the place
    packed = np.full(-(-len(h) // w) * w, ~np.uint64(0))
    packed[: len(h)] = (h & ~POSITION) | np.arange(len(h), dtype=np.uint64)
    rows = packed.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(behind[whole], ahead[whole + w - 1]) & POSITION).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(least) != 0) | (np.diff(whole) != 1)]))
    return whole[first], np.diff(np.append(first, len(whole))), h[least[first]]


def slices(texts: list[str], overlap: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole texts, several at a time, as ``(codes, text number, offset, last)``.

    ``codes`` holds about ``most`` code points; ``number`` and ``offset`` tell of
    each position which text it lies in and where, ``last`` how many positions
    of its text follow in the slice.  A text longer than ``most`` comes in
    several slices that share ``overlap`` positions.
    """
    pending: list[tuple[int, int, np.ndarray]] = []
    held = 0

    def pack(parts):
        sizes = [len(c) for _, _, c in parts]
        number = np.repeat([i for i, _, _ in parts], sizes)
        inner = np.arange(sum(sizes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.concatenate([c for _, _, c in parts]), number, inner + np.repeat([o for _, o, _ in parts], sizes), np.repeat(sizes, sizes) - inner - 1

    for i, text in enumerate(texts):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        step = most - overlap
        for at in range(0, max(1, len(codes) - overlap), step) if len(codes) > most else (0,):
            part = codes[at : at + most]
            pending.append((i, at, part))
            held += len(part)
            if held >= most:
                yield pack(pending)
                pending, held = [], 0
    if held:
        yield pack(pending)
