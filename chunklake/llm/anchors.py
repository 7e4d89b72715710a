"""Content-defined anchors of byte windows, for the substring dedup of suffixes.py."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes in a string that must repeat to be removed.
WINDOW = 100
#: Bytes in a gram; the smallest gram hash in a window is the window's anchor.
GRAM = 32
#: Bytes that are handled at once; positions take so many bits in a packed number.
CHUNK, PLACE = 1 << 20, 24


#: A number for each byte, and the base of the polynomial; any odd base and any distinct numbers do, since anchors only say which runs to compare.
_BYTES = np.random.default_rng(1).integers(1, 1 << 63, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each place on, for all that have as many: a polynomial of 64 bits, by doubling, and a last mixing."""
    h, n = _BYTES[data], 1
    while n < GRAM:
        right = h[n:] * np.uint64(pow(_BASE, n, 1 << 64))
        right += h[:-n]
        h, n = right, 2 * n
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


@dataclass
class Runs:
    """Runs of windows that share an anchor: `text` (which of the chunk's texts), `anchor` (hash), `first` and `last` (where in the text the first and the last window start), `at` (where the first starts in `data`)."""

    data: bytes
    text: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    last: np.ndarray
    at: np.ndarray

    def strings(self, which) -> list[bytes]:
        """The bytes from a run's first window to the end of its last."""
        n = (self.last - self.first + WINDOW)[which].tolist()
        return [self.data[a : a + m] for a, m in zip(self.at[which].tolist(), n, strict=True)]


def _runs(parts: list[tuple[int, int, bytes]]) -> Runs:
    """Runs of the windows in some pieces of texts: (text, where the piece starts in it, bytes)."""
    data = b"".join(x for _, _, x in parts)
    sizes = np.array([len(x) for _, _, x in parts])
    begin = np.cumsum(sizes) - sizes
    h = gram_hashes(np.frombuffer(data, np.uint8))
    # Smallest hash, then the earlier place: over 2, 4 .. grams and at last over all in a window.
    packed = (h >> np.uint64(PLACE)) << np.uint64(PLACE)
    packed |= np.arange(len(h), dtype=np.uint64)
    span, n = WINDOW - GRAM + 1, 1
    while 2 * n <= span:
        packed = np.minimum(packed[:-n], packed[n:])
        n *= 2
    if n < span:
        packed = np.minimum(packed[: len(packed) - (span - n)], packed[span - n :])
    place = (packed & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    # Windows inside one piece only.
    inside = np.zeros(len(data) + 1, np.int8)
    for b, s in zip(begin[sizes >= WINDOW].tolist(), sizes[sizes >= WINDOW].tolist(), strict=True):
        inside[b : b + s - WINDOW + 1] = 1
    inside = inside[: len(place)].astype(bool)
    new = inside.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= (place[1:] != place[:-1]) | ~inside[1:]
    lo, hi = np.flatnonzero(new), np.flatnonzero(ends)
    part = np.searchsorted(begin, lo, "right") - 1
    # Empty pieces share their place with the next; the last of them holds the window.
    shift = np.array([s for _, s, _ in parts])[part] - begin[part]
    return Runs(data, np.array([t for t, _, _ in parts])[part], h[place[lo]], lo + shift, hi + shift, lo)


def runs(texts: list[bytes]) -> Iterator[Runs]:
    """All runs of some texts, chunk by chunk. A text longer than a chunk comes in pieces that overlap so that no window is lost."""
    parts, size = [], 0
    for k, text in enumerate(texts):
        for start in range(0, max(1, len(text) - WINDOW + 1), CHUNK):
            piece = text[start : start + CHUNK + WINDOW - 1] if len(text) > CHUNK else text
            if len(piece) < WINDOW:
                continue
            parts.append((k, start, piece))
            size += len(piece)
            if size >= CHUNK:
                yield _runs(parts)
                parts, size = [], 0
            if len(text) <= CHUNK:
                break
    if parts:
        yield _runs(parts)
