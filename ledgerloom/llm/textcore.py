"""Vectorised text primitives shared by the operators: words as byte ranges, 64-bit word hashes, k-grams, key-sorted streams.

Everything works on UTF-8 bytes held in numpy arrays. Working memory follows the piece size, not the text size: a text longer
than a piece is hashed piece by piece, cut at separators.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

_U = np.uint64
_PIECE = 1 << 21
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 2**64)
_pow_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACE = bytes([0x20, *range(0x09, 0x0E)])
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _is_space_word() -> np.ndarray:
    table = np.ones(256, bool)
    table[list(SPACE)] = False
    return table


def _is_alnum_word() -> np.ndarray:
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def _is_letter_word() -> np.ndarray:
    table = np.zeros(256, bool)
    table[0x61:0x7B] = table[0x80:] = True
    return table


#: Byte tables over lower-cased text: True where the byte belongs to a word.
NON_SPACE, ALNUM, LETTERS = _is_space_word(), _is_alnum_word(), _is_letter_word()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^i and R^-i modulo 2^64 for i below a power of two that holds n."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _pow_cache:
        _pow_cache.clear()
        out = []
        for base in (_R, _RINV):
            p = np.empty(size, np.uint64)
            p[0], done = 1, 1
            while done < size:
                p[done : 2 * done] = p[:done] * _U(pow(base, done, 2**64))
                done *= 2
            out.append(p)
        _pow_cache[size] = (out[0], out[1])
    return _pow_cache[size]


class Words:
    """Words of a batch of texts. doc_at[i]:doc_at[i+1] are the words of text i; start and end are byte positions in buf."""

    __slots__ = ("buf", "doc_at", "end", "hash", "start", "text_at")

    def __init__(self, texts: list[bytes], table: np.ndarray, hashes: bool = True):
        joined = b"\n".join(texts).translate(LOWER)
        self.buf = np.frombuffer(joined, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_at = np.concatenate([[0], np.cumsum(lengths + 1)])[: len(texts) + 1]
        starts, ends = [], []
        n = len(self.buf)
        for a in range(0, n, _PIECE):  # the boundary scan needs one byte to the left
            b = min(n, a + _PIECE)
            inside = table[self.buf[max(0, a - 1) : b]].view(np.int8)
            d = np.diff(inside, prepend=np.int8(0)) if a == 0 else np.diff(inside)
            starts.append(np.flatnonzero(d == 1) + a)
            ends.append(np.flatnonzero(d == -1) + a)
        if n and table[self.buf[-1]]:
            ends.append(np.array([n]))
        self.start = np.concatenate(starts).astype(np.int64) if starts else np.empty(0, np.int64)
        self.end = np.concatenate(ends).astype(np.int64) if ends else np.empty(0, np.int64)
        self.doc_at = np.searchsorted(self.start, self.text_at)
        self.hash = self._hashes() if hashes else None

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        i, m = 0, len(self.start)
        while i < m:
            a = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, a + _PIECE, "right")))
            b = self.end[j - 1]
            power, inverse = _powers(int(b - a) + 1)
            h = np.empty(b - a + 1, np.uint64)
            h[0] = 0
            np.cumsum(_BYTE[self.buf[a:b]] * power[: b - a], out=h[1:])
            s, e = self.start[i:j] - a, self.end[i:j] - a
            out[i:j] = mix((h[e] - h[s]) * inverse[s] + (e - s).astype(np.uint64))
            i = j
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.doc_at)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc_at) - 1), self.counts())


def kgrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k entries of h: one less than k entries shorter than h."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * _U(0x9FB21C651E98DF25) + h[i : len(h) - k + 1 + i])
    return out


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 of each text of an Arrow column, empty for null."""
    return [t or b"" for t in batch.column(batch.schema.names.index(name)).cast(pa.binary()).to_pylist()]


def as_bytes(texts: Iterable) -> list[bytes]:
    """UTF-8 of each text, empty for null."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def pieces(texts: list[bytes], limit: int = _PIECE // 2) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with up to limit bytes each, or a single longer text."""
    a = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield a, i
            a, total = i, 0
        total += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def by_key(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups from a stream that is sorted by keys; groups may span batches."""
    held: list[pd.DataFrame] = []
    last = None
    for pdf in batches:
        if not len(pdf):
            continue
        values = pdf[keys].to_numpy()
        cut = np.concatenate([[0], np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1, [len(pdf)]])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            key = tuple(values[a])
            if held and key != last:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(pdf.iloc[a:b])
            last = key
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]
