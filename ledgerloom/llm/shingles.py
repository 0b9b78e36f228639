"""Word shingles of texts, as sets of 64-bit hashes, and circulant MinHash signatures."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd, so that its powers can be undone
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SEGMENT = 1 << 17
_tables: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, for n places at least."""
    if not _tables or len(_tables[0]) < n:
        size = max(n, _SEGMENT)
        _tables[:] = [np.cumprod(np.append(np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _tables


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text in UTF-8, in order.

    Words are cut at ASCII white space and hashed in lower case (A to Z only).
    A word's hash is a polynomial in its bytes: the difference of two running
    sums over the text, shifted back to where the word starts.
    """
    data = data.lower()
    parts, at = [], 0
    while at < len(data):
        to = at + _SEGMENT
        if to < len(data):  # segments end where a word does
            ahead = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, offset=to)]) if not _SPACE[data[to]] else [0]
            to = to + int(ahead[0]) if len(ahead) else len(data)
        part = np.frombuffer(data[at:to], np.uint8)
        power, inverse = _powers(len(part) + 1)
        edges = np.flatnonzero(np.diff(_SPACE[part], prepend=True, append=True))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
        starts, ends = edges[0::2], edges[1::2]
        parts.append((sums[ends] - sums[starts]) * inverse[starts])
        at = to
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    hashes ^= hashes >> np.uint64(31)
    return hashes * _MIX


def shingle_set(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words, given the words' hashes.

    Fewer words count, all together, as one shingle; no words give an empty set.
    """
    if not len(hashes):
        return hashes
    span = min(width, len(hashes))
    mixed = np.full(len(hashes) - span + 1, span, np.uint64)
    for k in range(span):
        mixed = (mixed ^ hashes[k : len(hashes) - span + 1 + k]) * _MIX + _STEP
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


class CirculantMinHash:
    """Signatures from two permutations, of which the second is shifted circularly.

    The first permutation places a shingle on a ring of ``2 ** ring_bits``
    places; coordinate k is the least value that the second permutation, turned
    by k places, gives to a shingle of the set.
    """

    def __init__(self, coordinates: int, ring_bits: int = 20, seed: int = 20240607):
        random = np.random.default_rng(seed)
        self._mask = np.uint64((1 << ring_bits) - 1)
        self._place = random.permutation(1 << ring_bits).astype(np.int32)
        turned = random.permutation(1 << ring_bits).astype(np.int32)
        ring = np.concatenate([turned, turned[: coordinates - 1]])
        self._rows = np.lib.stride_tricks.sliding_window_view(ring, coordinates)
        self.coordinates = coordinates

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        places = np.sort(self._place[(shingles & self._mask).astype(np.int64)])
        least = np.full(self.coordinates, np.iinfo(np.int32).max, np.int32)
        for at in range(0, len(places), 2048):
            np.minimum(least, self._rows[places[at : at + 2048]].min(axis=0), out=least)
        return least


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates; bands never share a key by position."""
    n, k = signatures.shape
    parts = signatures.astype(np.uint64).reshape(n, k // rows, rows)
    keys = np.broadcast_to(np.arange(1, k // rows + 1, dtype=np.uint64) * _STEP, (n, k // rows)).copy()
    for r in range(rows):
        keys = (keys ^ parts[:, :, r]) * _MIX
        keys ^= keys >> np.uint64(31)
        keys = keys * _STEP
    return keys.view(np.int64)
