"""Vectorised text helpers shared by the operators that run over Arrow batches.

Everything works on whole texts. A null text counts as an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.batches import give_back, slices

__all__ = ["U64", "Words", "as_text", "give_back", "hash_strings", "mix", "ngrams", "powers", "segment_sum", "slices", "words"]
U64 = np.uint64
_GOLDEN, _MIX1, _MIX2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64-bit words."""
    x = x + _GOLDEN
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


_BASE = 0xC2B2AE3D27D4EB4F
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), U64(base))
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 1 << 24:
            _powers[base] = have
    return have[:n]


def hash_strings(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string, the same in every process: a polynomial of its bytes, mixed with its length."""
    values = values.cast(pa.large_string())
    if not len(values):
        return np.empty(0, U64)
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(values.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    total = np.concatenate([np.zeros(1, U64), np.cumsum((raw.astype(U64) + U64(1)) * powers(_INVERSE, len(raw)), dtype=U64)])
    # a string's bytes summed with falling powers from its own start
    h = (total[ends[1:]] - total[ends[:-1]]) * powers(_BASE, len(raw) + 1)[ends[:-1]]
    return mix(h ^ mix(np.diff(ends).astype(U64) + U64(seed * int(_GOLDEN) % 2**64)))


@dataclass
class Words:
    """Words of several texts: ``ids`` index ``vocabulary``; text i has ids[offsets[i]:offsets[i+1]]."""

    ids: np.ndarray
    offsets: np.ndarray
    vocabulary: pa.Array

    @property
    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every process."""
        return hash_strings(self.vocabulary)[self.ids]


def as_text(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.large_string()), "")


def words(column: pa.Array, lower: bool = False) -> Words:
    """Split at white space. Empty and null texts have no words."""
    text = as_text(column)
    if lower:
        text = pc.utf8_lower(text)
    lists = pc.utf8_split_whitespace(text)
    flat = lists.values.dictionary_encode()
    offsets = np.asarray(lists.offsets).astype(np.int64)
    ids, vocabulary = np.asarray(flat.indices).astype(np.int64), flat.dictionary
    empty = pc.index(vocabulary, pa.scalar("", vocabulary.type)).as_py()
    if empty >= 0:
        keep = ids != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        ids = ids[keep]
    return Words(ids, offsets, vocabulary)


def ngrams(h: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and the position of each run's first word."""
    if len(h) < n:
        return np.empty(0, U64), np.empty(0, np.int64)
    m = len(h) - n + 1
    g = h[:m].copy()
    for k in range(1, n):
        g = mix(g) + h[k : m + k]
    start = np.arange(m)
    end = np.repeat(offsets[1:], np.diff(offsets))[:m]
    ok = start + n <= end
    return mix(g[ok]), start[ok]


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i+1]] for each i; 0 for an empty run."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]
