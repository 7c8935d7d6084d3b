"""Word shingles of whole texts as 64-bit hashes, vectorised over many documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Lower-cases A-Z and marks the white space that parts words.
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True

#: Base of the word polynomial (its inverse modulo 2**64 exists, as it is odd).
_BASE = 0x9E3779B97F4A7C15 | 3
_CHUNK = 1 << 18
#: Factors of a shingle's words by place, and of its word count.
_PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], "u8")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, _CHUNK)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _CHUNK)


def mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts below _CHUNK bytes, cut at white space where there is any and else inside a word."""
    at = 0
    while len(text) - at >= _CHUNK - 1:
        end = max(text.rfind(c, at, at + _CHUNK - 2) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        end = end + 1 if end > at else at + _CHUNK - 2
        yield text[at:end]
        at = end
    yield text[at:]


def _polynomials(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and polynomial hashes of the words of a text below _CHUNK bytes."""
    data = _LOWER[np.frombuffer(text, "u1")]
    solid = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view("i1")))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, "u8")
    np.cumsum((data + np.uint64(1)) * _UP[: len(data)], out=sums[1:])
    return starts, ends, (sums[ends] - sums[starts]) * _DOWN[starts]


def _long(pieces: list[bytes]) -> np.ndarray:
    """Word hashes of a text in parts; the parts of a word that a cut goes through are joined."""
    polys, sizes = [], []
    poly = size = 0  # of the word that the latest part ends in
    for p in pieces:
        starts, ends, here = _polynomials(p)
        n = ends - starts
        if size and len(n) and starts[0] == 0:
            here[0] = (poly + pow(_BASE, size, 1 << 64) * int(here[0])) % (1 << 64)
            n[0] += size
        elif size:
            polys.append(np.array([poly], "u8"))
            sizes.append(np.array([size]))
        poly = size = 0
        if len(n) and ends[-1] == len(p):
            poly, size = int(here[-1]), int(n[-1])
            here, n = here[:-1], n[:-1]
        polys.append(here)
        sizes.append(n)
    if size:
        polys.append(np.array([poly], "u8"))
        sizes.append(np.array([size]))
    return mix(np.concatenate(polys) + np.concatenate(sizes).astype("u8"))


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """One array of word hashes per text, in order; few large numpy calls. A word is one hash at any size."""
    group: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if group:
            starts, ends, polys = _polynomials(b"\n".join(group))
            words = mix(polys + (ends - starts).astype("u8"))
            at = np.cumsum([len(t) + 1 for t in group])[:-1]
            yield from np.split(words, np.searchsorted(starts, at))

    for text in texts:
        pieces = list(_pieces(text))
        if len(pieces) > 1:
            yield from flush()
            group, size = [], 0
            yield _long(pieces)
            continue
        if size + len(text) + 1 >= _CHUNK:
            yield from flush()
            group, size = [], 0
        group.append(text)
        size += len(text) + 1
    yield from flush()


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words are one shingle."""
    n = len(words)
    if n == 0:
        return np.empty(0, "u8")
    w = min(k, n)
    out = np.full(n - w + 1, w, "u8")
    for i in range(w):
        out += words[i : n - w + 1 + i] * _PLACES[i]
    return np.unique(mix(out))
