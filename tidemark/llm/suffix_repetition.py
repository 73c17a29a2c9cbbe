"""Quality rule: repetition inside a text, found with a suffix array over its words.

Prefix doubling sorts the suffixes of all texts of a slice at once (a suffix never compares equal past its text's
end). Neighbours in the suffix array whose longest common prefix (LCP) reaches MIN_WORDS bound the LCP intervals;
each interval of depth l is a maximal repeated substring of l words, and a suffix's deepest interval has the
larger LCP of its two neighbours. The union of the spans of all intervals gives the covered words. A text is kept
if the covered fraction is at most MAX_COVERED and its longest repeat at most MAX_LONGEST words.

Defined results: a null or empty text has no words, nothing covered, and is kept; occurrences may overlap, so
"a a a a" repeats "a a a"; each row is judged by itself, so repeated rows get equal results and a null doc_id is
passed on; the result doesn't depend on the order of equal suffixes, as there are none; an empty table gives an
empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrowtext import slices, words
from tidemark.llm.tables import text_batches

MIN_WORDS = 16
MAX_COVERED = 0.2
MAX_LONGEST = 100
SCHEMA = "doc_id long, words int, repeated_words int, covered_fraction double, longest_repeat int, keep boolean"


def suffix_array(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, texts kept apart, and for each level l the class of each suffix's first 2**l words."""
    n = len(ids)
    size = np.diff(offsets)
    doc, end = np.repeat(np.arange(len(size)), size), np.repeat(offsets[1:], size)
    key = doc * (int(ids.max()) + 1 if n else 1) + ids
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    start = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.empty(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    levels, k = [rank.copy()], 1
    places = np.flatnonzero(~(start & np.append(start[1:], True)))
    while len(places):
        some = order[places]
        after = some + k
        second = np.where(after < end[some], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[some] * (n + 1) + second
        by = np.argsort(key)
        some, key = some[by], key[by]
        order[places] = some
        start = np.concatenate([[True], key[1:] != key[:-1]])
        rank[some] = np.maximum.accumulate(np.where(start, places, 0))
        levels.append(rank.copy())
        places = places[~(start & np.append(start[1:], True))]
        k *= 2
    return order, levels


def common_prefixes(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that the suffixes a[i] and b[i] share at their start."""
    n, shared = len(levels[0]), np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + shared, b + shared
        inside = (x < n) & (y < n)
        rank = levels[level]
        same = inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
        shared += same.astype(np.int64) << level
    return shared


def repetition(ids: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Covered words and longest repeat of each text."""
    texts = len(offsets) - 1
    covered, longest = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    n = len(ids)
    if n < 2:
        return covered, longest
    order, levels = suffix_array(ids, offsets)
    level = min_words.bit_length() - 1
    if level >= len(levels):
        return covered, longest
    near = levels[level][order]
    pair = np.flatnonzero(near[1:] == near[:-1])
    a, b = order[pair], order[pair + 1]
    lcp = common_prefixes(a, b, levels)
    ok = lcp >= min_words
    at, length = np.concatenate([a[ok], b[ok]]), np.concatenate([lcp[ok], lcp[ok]])
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    total = np.concatenate([[0], np.cumsum(np.cumsum(edge[:n]) > 0)])
    covered = total[offsets[1:]] - total[offsets[:-1]]
    np.maximum.at(longest, np.searchsorted(offsets, at, side="right") - 1, length)
    return covered, longest


def score(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row per row of docs: words, covered words and fraction, longest repeat in words, keep. No shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            w = words(b.column(1))
            size = np.diff(w.offsets)
            covered, longest = repetition(w.ids, w.offsets, min_words)
            share = np.round(covered / np.maximum(size, 1), 6)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size.astype(np.int32)), pa.array(covered.astype(np.int32)), pa.array(share), pa.array(longest.astype(np.int32)), pa.array((share <= max_covered) & (longest <= max_longest))],
                ["doc_id", "words", "repeated_words", "covered_fraction", "longest_repeat", "keep"],
            )

    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op2_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
