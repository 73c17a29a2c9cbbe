"""Quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader.

Features of a text are the n-grams (n = 1, 2) of its lower-cased words and the n-grams (n = 1, 2, 3) of the
words' shapes. A shape keeps case pattern and marks ("Word," -> "Aa,"; "THE!!" -> "A!"); a word equal to the one
before it has the shape "=". Each n-gram is hashed to one of 2**BITS coordinates, whose value is its share of the
text's n-grams times SCALE; the score is the sparse dot product with the learned weights.

Defined results: a null or empty text has no features, its probability is that of the bias alone; rows are scored
one by one, so repeated rows get equal results and ties don't arise; an empty table gives an empty result; labels
that are null or not 0/1, and labels without a document, are left out of the fit, a doc_id with both labels counts as
bad; rows that share a doc_id take part each, in the order of their texts; without labelled documents of both classes
the fit is refused with ValueError (a model that has learnt nothing would pass everything) unless the table is empty,
in which case all weights are 0; other columns of the input are never read by ``score`` and pass unchanged through
``keep``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrowtext import U64, hash_strings, mix, segment_sum, slices, words
from tidemark.llm.tables import text_batches

BITS = 18
SCALE = 16.0
#: Most labelled rows of each class that the fit uses; they are the first by a hash of their doc_id.
FIT_ROWS = 6000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-3
THRESHOLD = 0.5
MODEL_SCHEMA = "weights binary, bias double, classes long"


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all n-grams, text by text, and the offsets of the texts."""
    w = words(column)
    size = np.diff(w.offsets)
    if not len(w.ids):
        return np.empty(0, np.int64), np.zeros(len(size) + 1, np.int64)
    shapes = w.vocabulary
    for pattern, to in ((r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lo}]+", "a"), (r"\p{N}+", "0"), (r"!+", "!"), (r"\*+", "*"), (r"#+", "#"), (r"%+", "%"), (r"&+", "&"), (r"\$+", "$"), (r"\.+", ".")):
        shapes = pc.replace_substring_regex(shapes, pattern, to)
    word = hash_strings(pc.utf8_lower(w.vocabulary), 1)
    first = np.zeros(len(w.ids), bool)
    first[w.offsets[:-1][size > 0]] = True
    again = np.concatenate([[False], (w.ids[1:] == w.ids[:-1])]) & ~first
    shape = np.where(again, hash_strings(pa.array(["="]), 2)[0], hash_strings(shapes, 2)[w.ids])
    word = word[w.ids]
    doc = w.doc
    parts, docs = [], []
    for seq, n_max in ((word, 2), (shape, 3)):
        g = seq
        for n in range(1, n_max + 1):
            if n > 1:
                g = mix(g[:-1]) + seq[n - 1 :]
            ok = doc[: len(g)] == doc[n - 1 :]
            parts.append((mix(g[ok] + U64(n)) >> U64(64 - BITS)).astype(np.int64))
            docs.append(doc[: len(g)][ok])
            if len(g) < 2:
                break
    of = np.concatenate(docs)
    order = np.argsort(of, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(size)))])
    return np.concatenate(parts)[order], offsets.astype(np.int64)


def train(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (coordinates, label) in the order given; the last coordinate is the bias."""
    dim = 1 << BITS
    z, n = np.zeros(dim + 1), np.zeros(dim + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        lazy = (np.sign(z[i]) * L1 - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) <= L1, 0.0, lazy)

    ready = []
    for coordinates, y in rows:
        i, count = np.unique(coordinates, return_counts=True)
        ready.append((np.append(i, dim), np.append(count * (SCALE / max(1, len(coordinates))), 1.0), y))
    for _ in range(EPOCHS):
        for i, x, y in ready:
            w = weight(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    all_of = weight(np.arange(dim + 1))
    return all_of[:dim].astype(np.float32), float(all_of[dim])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """Weights and bias, from at most ``fit_rows`` labelled documents of each class.

    Only the sampled doc_ids (a fixed number) are broadcast; one task runs the sequential fit on the texts it gets.
    """
    text_batches(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").alias("_y")).where("_id is not null and _y in (0, 1)")
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
        picked = part if picked is None else picked.unionAll(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text")).join(F.broadcast(picked), "_id")

    def one(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in slices(batches, 1):
            at, offsets = features(b.column(1))
            for k, (i, y, digest) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())):
                rows.append((i * 0x9E3779B97F4A7C15 % 2**64, i, digest or "", y, at[offsets[k] : offsets[k + 1]].astype(np.int32)))
        rows.sort(key=lambda r: r[:3])
        w, bias = train([(r[4], r[3]) for r in rows])
        yield pa.RecordBatch.from_pydict({"weights": pa.array([w.tobytes()], pa.binary()), "bias": [bias], "classes": [len({r[3] for r in rows})]})

    got = texts.select("_id", "_text", "_y", F.md5("_text").alias("_digest")).repartition(1).mapInArrow(one, MODEL_SCHEMA).collect()
    classes = got[0]["classes"] if got else 0  # an empty exchange has no task at all
    if classes < 2:
        if not docs.isEmpty():
            raise ValueError("the labels are all of one class" if classes else "no document has a label")
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(got[0]["weights"], np.float32), got[0]["bias"]


def _probabilities(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    at, offsets = features(column)
    total = segment_sum(weights[at], offsets) * SCALE / np.maximum(np.diff(offsets), 1) + bias
    return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def score(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, quality_score (probability of good quality), keep (score >= threshold), for each row of docs."""
    shared = spark.sparkContext.broadcast(model)
    text_batches(spark)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        for b in slices(batches, 1):
            p = np.round(_probabilities(b.column(1), w, bias), 6)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(p >= threshold)], ["doc_id", "quality_score", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, quality_score double, keep boolean")


def keep(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold; no shuffle."""
    shared = spark.sparkContext.broadcast(model)
    text_batches(spark)
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        for b in slices(batches, at):
            p = np.round(_probabilities(b.column(at), w, bias), 6)
            yield b.filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(spark, docs, fit(spark, docs, labels))
