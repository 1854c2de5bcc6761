"""Words and hashes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A finishing permutation of 64-bit values (the splitmix64 generator's)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def noise(n: int, seed: int, first: int = 0) -> np.ndarray:
    """Fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mixed((np.arange(first + 1, first + n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


#: Bytes that are looked at together; a word longer than this is hashed in parts.
SEGMENT = 1 << 21

_BYTE = noise(256, 1)
_PLACES = noise(1 << 10, 2) | np.uint64(1)


def _places(n: int) -> np.ndarray:
    global _PLACES
    if n > len(_PLACES):
        _PLACES = noise(1 << n.bit_length(), 2) | np.uint64(1)
    return _PLACES


def runs(texts: Iterable[bytes | None], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Texts in runs of about so many bytes at most; a longer text makes a run of its own. None counts as empty."""
    run, size = [], 0
    for t in texts:
        t = t or b""
        if run and (size + len(t) > most or len(run) >= 4096):
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


class Words:
    """The words of a run of texts: maximal runs of bytes other than space, tab, newline, VT, FF, CR.

    Bytes are looked at in segments, so what grows with a text is 8 bytes for each word's place, or 16 beyond 2 GB.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = np.frombuffer(texts[0] if len(texts) == 1 else b"".join(texts), np.uint8)
        self._lower = lower
        bounds, size = np.cumsum([0, *map(len, texts)]), len(self.data)
        kind = np.int32 if size < 2**31 else np.int64
        starts, ends = [np.zeros(0, kind)], [np.zeros(0, kind)]
        for a in range(0, size, SEGMENT):
            b = min(a + SEGMENT, size)
            space = _SPACE[self.data[max(a - 1, 0) : b + 1]]
            here = space[min(a, 1) :][: b - a]
            before, after = np.ones(b - a, bool), np.ones(b - a, bool)
            before[a == 0 :] = space[: b - a - (a == 0)]
            after[: b - a - (b == size)] = space[min(a, 1) + 1 :]
            inner = bounds[np.searchsorted(bounds, a) : np.searchsorted(bounds, b, "right")] - a  # where a text starts or ends
            before[inner[inner < b - a]] = True
            after[inner[inner > 0] - 1] = True
            starts.append((np.flatnonzero(~here & before) + a).astype(kind))
            ends.append((np.flatnonzero(~here & after) + (a + 1)).astype(kind))
        self.starts, self.ends = np.concatenate(starts), np.concatenate(ends)
        #: Words of text k are first[k] to first[k + 1].
        self.first = np.searchsorted(self.starts, bounds)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self.starts), np.uint64)
        cuts = np.searchsorted(self.starts, np.arange(0, len(self.data) + SEGMENT, SEGMENT)).tolist()
        for i, j in zip(cuts, cuts[1:]):
            if i < j and self.ends[j - 1] - self.starts[j - 1] > SEGMENT:  # only a segment's last word can leave it
                j -= 1
                out[j] = self._long(int(self.starts[j]), int(self.ends[j]))
            if i < j:
                out[i:j] = self._short(i, j)
        return out

    def _bytes(self, a: int, b: int) -> np.ndarray:
        return _LOWER[self.data[a:b]] if self._lower else self.data[a:b]

    def _short(self, i: int, j: int) -> np.ndarray:
        data = self._bytes(int(self.starts[i]), int(self.ends[j - 1]))
        sizes = (self.ends[i:j] - self.starts[i:j]).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        solid = data[~_SPACE[data]]
        place = np.arange(len(solid)) - np.repeat(begin, sizes)
        return mixed(np.add.reduceat(_BYTE[solid] * _places(int(sizes.max()))[place], begin))

    def _long(self, a: int, b: int) -> np.uint64:
        total = np.zeros(1, np.uint64)
        for at in range(a, b, SEGMENT):
            part = self._bytes(at, min(at + SEGMENT, b))
            total += (_BYTE[part] * (noise(len(part), 2, at - a) | np.uint64(1))).sum(dtype=np.uint64)
        return mixed(total)[0]


def windows(hashes: np.ndarray, width: int, seed: int = 3) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive values; len(hashes) - width + 1 of them."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for a in range(0, n, SEGMENT):
        part = out[a : a + SEGMENT]
        for k, c in enumerate((noise(width, seed) | np.uint64(1)).tolist()):
            part += hashes[a + k : a + k + len(part)] * np.uint64(c)
        part[:] = mixed(part)
    return out
