"""Rolling fingerprints of texts in numpy, for use inside tasks.

Texts of a batch are laid end to end with one separator byte between them, so
that one vectorised pass serves many short texts. All fingerprints are 64 bits
and depend on content only, not on position, batch or machine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 20  # texts laid together; one longer text forms a chunk of its own


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_KEPT: dict = {}  # tables of this process, made when first asked for


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64."""
    if len(_KEPT.get(base, ())) < n:
        out = np.full(max(1 << 12, 1 << n.bit_length()), base, np.uint64)
        out[0] = 1
        _KEPT[base] = np.multiply.accumulate(out)
    return _KEPT[base][:n]


def byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of values[start:end]; the length takes part."""
    raw = (sums[end] - sums[start]) * powers(INVERSE, len(sums))[start]
    return mixed(raw + mixed((end - start).astype(np.uint64)))


class Words:
    """Words of texts laid end to end: their places, hashes and the text each belongs to."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray, lower: np.ndarray | None = None):
        self.raw = b" ".join(texts) + b" "
        data = np.frombuffer(self.raw, np.uint8)
        if lower is not None:
            data = lower[data]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        inside = is_word[data]
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edges[0::2], edges[1::2]
        self.hash = range_hashes(prefix_sums(byte_values()[data]), self.start, self.end)
        #: Words of text k are first[k]:first[k + 1].
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.text_of = np.repeat(np.arange(len(texts)), self.counts)
        #: Place of a word within its text.
        self.place = np.arange(len(self.start)) - self.first[:-1][self.text_of]

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Global index of every window's first word, and fingerprints of the windows."""
        left = self.counts[self.text_of] - self.place
        start = np.flatnonzero(left >= size)
        return start, range_hashes(prefix_sums(self.hash), start, start + size)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Words `[^\x20\x09-\x0D]+` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, and A-Z to a-z.
SPACED = ~byte_class((0x20, 0x20), (0x09, 0x0D))
LETTERS_DIGITS = ~byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
ASCII_LOWER = np.where(byte_class((65, 90)), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def chunks(sizes: Iterable[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts that hold about `most` bytes together."""
    begin, held, k = 0, 0, -1
    for k, size in enumerate(sizes):
        if held and held + size > most:
            yield begin, k
            begin, held = k, 0
        held += size
    if k >= begin:
        yield begin, k + 1


def encoded(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is the empty text."""
    return [b"" if x is None else x for x in column.cast("large_binary").to_pylist()]


def _is_cover(residues: list[int], modulus: int) -> bool:
    return len({(a - b) % modulus for a in residues for b in residues}) == modulus


def difference_cover(modulus: int) -> np.ndarray:
    """Residues such that every difference modulo `modulus` occurs between two of them.

    For q * q + q + 1 with a prime q these are the q + 1 powers of a cubic field's
    generator that lie in a plane (Singer): the fewest that can do.
    """
    if ("cover", modulus) in _KEPT:
        return _KEPT["cover", modulus]
    q = round(modulus**0.5)
    q = next((k for k in (q - 1, q) if k * k + k + 1 == modulus), 0)
    for a, b, c in ((a, b, c) for a in range(q) for b in range(q) for c in range(1, q)):
        x, found = (1, 0, 0), []  # x**i as (1, x, x**2), with x**3 = a * x**2 + b * x + c
        for i in range(modulus):
            if x[2] == 0:
                found.append(i)
            x = (c * x[2] % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)
        if len(found) == q + 1 and _is_cover(found, modulus):
            return _KEPT.setdefault(("cover", modulus), np.array(found))
    raise ValueError(f"no cover is built for {modulus}")
