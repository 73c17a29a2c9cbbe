"""Substring dedup: Rabin-Karp hashes of every window of WINDOW words, counted in Spark; repeated windows merge
into maximal removal intervals.

A rolling polynomial hash over 64-bit word hashes gives each window its hash. To count them without one shuffled
row a window, windows travel in runs: a window's anchor is the smallest of its GRAM-word hashes (leftmost in a
tie), so equal windows have equal anchors and meet in one partition; neighbouring windows mostly share their
anchor occurrence, and one row (anchor, doc_id, first window, packed hashes) carries about 22 of them at six bytes
each. A run whose anchor occurs once holds no repeated window and goes no further; the others are unpacked and
counted by (anchor, window hash) within the same partitioning.

Anchors are counted first. Those of more than HEAVY runs, such as a notice in a large share of all documents, would
each fill one task, so their windows are unpacked at once and counted by aggregates that combine before the shuffle;
the counts are joined back by window, where AQE can split a skewed key. Both ways find the same intervals.

Of the occurrences of a window, the one with the smallest (doc_id, position) is kept; the others are removed.
Overlapping or touching windows of a document merge to intervals of word positions [start_word, end_word).

Defined results: null and empty texts, and texts of fewer than WINDOW words, have no windows; rows without a doc_id
take no part (``remove`` leaves them as they are); rows that share a doc_id are one document, so a repeated row
isn't a repeat of itself; a text that repeats itself with a short period keeps its first window's occurrence, of
which overlapping later windows take all but the first period; ties can't arise, since (doc_id, position) orders
all occurrences; an empty table gives an empty result; ``remove`` passes all other columns, whatever they are called,
and drops a row only if removal leaves it no word. ``repeated_intervals`` runs one job at once, for the counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.arrowtext import U64, mix, powers, slices, words
from tidemark.llm.tables import fresh, text_batches, written

WINDOW = 50
GRAM = 8
BYTES = 6
#: Most runs of an anchor that one task unpacks.
HEAVY = 100_000
_BASE = 0x9E3779B97F4A7C15 | 1
_POSITION_BITS = 31
RUNS = "anchor long, doc_id long, first int, packed binary"


def rabin_karp(h: np.ndarray, window: int) -> np.ndarray:
    """Hash of each run of ``window`` words: sum of h[i + j] * base**-j, modulo 2**64, from running sums."""
    inverse = pow(_BASE, -1, 2**64)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(h * powers(inverse, len(h)), dtype=U64)])
    return mix((total[window:] - total[:-window]) * powers(_BASE, len(h) - window + 1))


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each run of n values."""
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def runs(column: pa.Array, window: int, gram: int, hashed: bool = True) -> tuple[np.ndarray, ...]:
    """For each run of windows with one anchor occurrence: anchor, text, first window's word, count; and all hashes, if asked for."""
    w = words(column)
    none = np.empty(0, np.int64)
    if len(w.ids) < window:
        return none.astype(U64), none, none, none, none.astype(U64)
    h = w.hashes()
    g = h[: len(h) - gram + 1].copy()
    for k in range(1, gram):
        g = mix(g) + h[k : len(h) - gram + 1 + k]
    g = mix(g)
    low = U64((1 << _POSITION_BITS) - 1)
    anchor = (sliding_min((g & ~low) | np.arange(len(g), dtype=U64), window - gram + 1) & low).astype(np.int64)
    doc = w.doc
    at = np.arange(len(h) - window + 1)
    ok = doc[at] == doc[at + window - 1]
    at, anchor = at[ok], anchor[ok]
    hashes = rabin_karp(h, window)[ok] if hashed else none.astype(U64)
    new = np.flatnonzero(np.concatenate([[True], np.diff(anchor) != 0])) if len(at) else none
    return g[anchor[new]], doc[at[new]], at[new] - w.offsets[doc[at[new]]], np.diff(np.append(new, len(at))), hashes


def _map_runs(window: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            anchor, doc, first, count, hashes = runs(b.column(1), window, gram)
            if not len(anchor):
                continue
            raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()
            ends = np.concatenate([[0], np.cumsum(count)]) * BYTES
            packed = pa.Array.from_buffers(pa.binary(), len(anchor), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
            ids = pc.take(b.column(0), pa.array(doc))
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), ids, pa.array(first.astype(np.int32)), packed], ["anchor", "doc_id", "first", "packed"])

    return run


def _intervals(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(2)
            row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(lists.offsets)))
            at = np.asarray(lists.flatten()).astype(np.int64)
            order = np.lexsort((at, row))
            row, at = row[order], at[order]
            new = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(at) > window)])
            last = np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)
            first = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([pc.take(b.column(0), first), pa.array(at[new].astype(np.int32)), pa.array((at[last] + window).astype(np.int32)), pc.take(b.column(1), first)], ["doc_id", "start_word", "end_word", "removed"])

    return run


def _anchors(window: int, gram: int):
    """Anchors of the runs, added up within a task as far as a slice goes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            anchor, n = np.unique(runs(b.column(0), window, gram, False)[0].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], ["anchor", "n"])

    return run


def repeated_intervals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """doc_id, start_word, end_word, removed: the maximal intervals of repeated windows of each document.

    removed is false for the intervals made of the kept (first) occurrences, true for those to take out.
    """
    text_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    counted = texts.select("text").mapInArrow(_anchors(window, gram), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    crowded = written(counted.where(F.col("n") > heavy).select("anchor"), "heavy-anchors")
    any_crowded = not crowded.isEmpty()

    all_runs, at = texts.mapInArrow(_map_runs(window, gram), RUNS), F.struct("doc_id", "start")
    unpacked = F.posexplode(F.expr(f"transform(sequence(0, length(packed) div {BYTES} - 1), i -> substring(packed, i * {BYTES} + 1, {BYTES}))")).alias("k", "hash")
    start = (F.col("first") + F.col("k")).alias("start")
    light = all_runs.join(crowded, "anchor", "left_anti") if any_crowded else all_runs
    by_anchor, by_window = W.partitionBy("anchor"), W.partitionBy("anchor", "hash")
    met = (
        light.withColumn("most", F.count(F.lit(1)).over(by_anchor))
        .where("most > 1")
        .select("anchor", "doc_id", "first", unpacked)
        .select("anchor", "hash", "doc_id", start)
        .withColumn("least", F.min(at).over(by_window))
        .withColumn("most", F.max(at).over(by_window))
        .where("least != most")
        .select("anchor", "doc_id", "start", (F.col("least") != at).alias("removed"))
    )
    if any_crowded:
        windows = all_runs.join(crowded, "anchor", "left_semi").select("anchor", "doc_id", "first", unpacked).select("anchor", F.struct("anchor", "hash").alias("window"), "doc_id", start)
        known = windows.groupBy("window").agg(F.min(at).alias("least"), F.max(at).alias("most")).where("least != most").select("window", "least")
        met = met.unionAll(windows.join(known, "window").select("anchor", "doc_id", "start", (F.col("least") != at).alias("removed")))
    starts = met.groupBy("anchor", "doc_id", "removed").agg(F.collect_list("start").alias("s")).groupBy("doc_id", "removed").agg(F.flatten(F.collect_list("s")).alias("s"))
    return starts.select("doc_id", "removed", "s").mapInArrow(_intervals(window), "doc_id long, start_word int, end_word int, removed boolean")


def _cut(texts: list[str | None], spans: list[list[dict] | None]) -> list[str | None]:
    lists = pc.utf8_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
    out = []
    for text, row, cuts in zip(texts, lists, spans):
        if not cuts:
            out.append(text)
            continue
        place, bounds = 0, []
        for word in row.as_py():
            if word:
                place = text.index(word, place)
                bounds.append(place)
                place += len(word)
        bounds.append(len(text))
        kept, last = [], 0
        for c in sorted(cuts, key=lambda c: c["start_word"]):
            kept.append(text[last : bounds[min(c["start_word"], len(bounds) - 1)]])
            last = bounds[min(c["end_word"], len(bounds) - 1)]
        out.append("".join([*kept, text[last:]]))
    return out


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs without the removed intervals; n_chars, if there, is counted anew. Columns as in docs."""
    cut_id, spans_of = fresh(docs.columns, "cut_id", "cuts")
    cuts = repeated_intervals(docs, window, gram).where("removed").groupBy(F.col("doc_id").alias(cut_id)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(spans_of))
    joined = docs.join(cuts, docs["doc_id"].cast("long") == F.col(cut_id), "left").drop(cut_id)
    at, spans = joined.columns.index("text"), joined.columns.index(spans_of)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            hit = np.asarray(pc.is_valid(b.column(spans)).to_numpy(zero_copy_only=False))
            plain = b.select([k for k in range(b.num_columns) if k != spans])
            if (~hit).any():
                yield plain.filter(pa.array(~hit))
            if not hit.any():
                continue
            part, cut = plain.filter(pa.array(hit)), b.column(spans).filter(pa.array(hit))
            text = pa.array(_cut(part.column(at).to_pylist(), cut.to_pylist()), part.schema.field(at).type)
            columns = list(part.columns)
            columns[at] = text
            if "n_chars" in plain.schema.names:
                n = plain.schema.names.index("n_chars")
                columns[n] = pc.utf8_length(text).cast(columns[n].type)
            left = pa.RecordBatch.from_arrays(columns, schema=part.schema)
            yield left.filter(pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(text)), 0))

    return joined.mapInArrow(run, docs.schema)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_intervals(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""with own as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents where doc_id is not null and text is not null),
    places as (select doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) as i from own where len(w) >= {WINDOW}),
    windows as (select doc_id, i, md5(array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ')) as k, doc_id::hugeint * 1000000000 + i as place from places),
    met as (select doc_id, i, place > least as removed from windows join (select k, min(place) as least, max(place) as most from windows group by k having min(place) <> max(place)) using (k)),
    runs as (select *, sum(new) over (partition by doc_id, removed order by i) as run from
        (select distinct doc_id, removed, i, case when i - lag(i) over (partition by doc_id, removed order by i) <= {WINDOW} then 0 else 1 end as new from (select distinct doc_id, removed, i from met) x) y)
    select doc_id, (min(i) - 1)::int as start_word, (max(i) - 1 + {WINDOW})::int as end_word, removed from runs group by doc_id, removed, run"""
