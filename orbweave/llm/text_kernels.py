"""numpy kernels over batches of texts: word spans, word and shingle hashes.

A word is a maximal run of bytes other than space and 0x09-0x0D.  Texts are
handled whole, in groups of about ``GROUP_BYTES`` (small
enough for the processor's cache) so that memory is bounded by
the longest text, never by the number of texts.

Hashes are 64-bit.  Two different words or shingles agree with a probability of
2**-64 a pair; results that need equality of whole sets use 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GROUP_BYTES = 1 << 17
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h + _U((salt * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) & (1 << 64) - 1)
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_SYMBOL = mix(np.arange(1 << 16, dtype=np.uint64), 7)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, GROUP_BYTES + GROUP_BYTES // 4)
            self.up = np.cumprod(np.r_[_U(1), np.full(size, _BASE)])
            self.down = np.cumprod(np.r_[_U(1), np.full(size, _BASE_INVERSE)])
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def hash_spans(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``symbols[start:end]``; symbols are below 65536."""
    up, down = _POWERS.get(len(symbols) + 1)
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(_SYMBOL[symbols] * up[: len(symbols)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)))


def groups(texts: list[bytes], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes."""
    begin = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield begin, i
            begin, total = i, 0
        total += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Flat index of the concatenated ranges ``start .. start + length``."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    out = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
    out += np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)
    return out


def word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and where each text's words begin.

    The second array has one entry more than there are texts.
    """
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes + 1) - sizes - 1
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    hashes = hash_spans(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
    return hashes, np.r_[np.searchsorted(starts, begins), len(starts)]


_WEIGHT = mix(np.arange(64, dtype=np.uint64), 3) | _U(1)


def shingle_sets(texts: list[bytes], words: int, lower: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sorted distinct hashes of the ``words``-word shingles of every text.

    Yields, for groups of consecutive texts, all their sets in one array and
    where each set begins (one entry more than texts).  A text of fewer words
    has its whole sequence as its one shingle; a text without words has none.
    """
    for a, b in groups(texts):
        hashes, at = word_hashes(texts[a:b], lower)
        n_words = np.diff(at)
        joined = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for k in range(words):
            joined += hashes[k : k + len(joined)] * _WEIGHT[k]
        joined = mix(joined, words)
        sizes = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
        begins = np.r_[0, np.cumsum(sizes)]
        whole = n_words >= words
        out = np.empty(begins[-1], np.uint64)
        out[ragged(begins[:-1][whole], sizes[whole])] = joined[ragged(at[:-1][whole], sizes[whole])]
        for d in np.flatnonzero(~whole & (n_words > 0)):
            i, j = at[d], at[d + 1]
            out[begins[d]] = mix(np.array([(hashes[i:j] * _WEIGHT[: j - i]).sum()], np.uint64), int(j - i))[0]
        for i, j in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            out[i:j].sort()
        new = np.ones(len(out), bool)
        new[1:] = out[1:] != out[:-1]
        new[begins[:-1][sizes > 0]] = True
        yield out[new], np.r_[0, np.cumsum(new)][begins]


def set_keys(flat: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums a set; both agree only for equal sets."""
    sums = []
    for salt in (11, 12):
        total = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(mix(flat, salt), out=total[1:])
        sums.append((total[begins[1:]] - total[begins[:-1]]).view(np.int64))
    return sums[0], sums[1]
