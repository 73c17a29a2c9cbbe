"""BPE encoding and decoding with a public byte-level vocabulary; long texts by tree concatenation.

Texts of up to PART characters are encoded at once. A longer text is cut into parts at any character; Spark encodes
the parts in parallel, and neighbouring results are concatenated pairwise up a tree. A join re-encodes a window that
starts a few pre-tokens before the cut (those can't depend on what follows) and grows to the right until one of its
pre-token boundaries is also a boundary of the right side: from there on both sides agree exactly, because the
pattern looks only forward. Within one unsplit run that spans the cut (or is long by itself), tokens are joined the
same way: the window of k tokens on either side is re-encoded and grows until its outer tokens fit their neighbours,
that is, until each outer pair re-encodes to itself; a sequence of which all neighbouring pairs do so is the BPE
encoding of its bytes. The result equals the encoding of the whole text, id by id.

Defined results: a null text counts as empty; an empty text has no tokens and makes the round trip; strings of
special tokens are ordinary text; rows are encoded one by one, so repeated rows come out as often as they went in,
and null doc_ids are passed on; an empty table gives an empty result; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrowtext import as_text, slices
from tidemark.llm.tables import text_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a part. Longer texts are cut.
PART = 16000
#: Bytes of an unsplit run that are encoded at once.
RUN = 1024
#: Pre-tokens before a cut that may change with what follows it.
BACK = 4
SCHEMA = "doc_id long, n_tokens int, tokens array<int>, round_trip boolean"


class Codec:
    """Encoder and decoder of one vocabulary (the bytes of a .tiktoken file)."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.encoding = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)
        self.kind = np.uint16 if max(ranks.values()) < 1 << 16 else np.uint32
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.fits = lru_cache(1 << 16)(self._fits)
        self.short_run = lru_cache(1 << 17)(self._short_run)

    def encode(self, text: str) -> np.ndarray:
        """Of a text of any length, without cutting it at pre-tokens."""
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def decode(self, tokens: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, tokens))

    def _fits(self, a: int, b: int) -> bool:
        return self.encoding._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def _short_run(self, text: str) -> tuple[int, ...]:
        return tuple(self.encoding._encode_single_piece(text))

    def run(self, text: str) -> tuple[int, ...]:
        """Tokens of one unsplit run."""
        if len(text) <= 64:
            return self.short_run(text)
        return tuple(self.run_bytes(text.encode()))

    def run_bytes(self, raw: bytes) -> list[int]:
        if len(raw) <= RUN:
            return self.encoding._encode_single_piece(raw)
        half = len(raw) // 2
        return self.join_tokens(self.run_bytes(raw[:half]), self.run_bytes(raw[half:]))

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the concatenated bytes of two encodings."""
        k = 2
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            middle = self.encoding._encode_single_piece(self.decode(left[a:]) + self.decode(right[:b]))
            if (a == 0 or self.fits(left[a - 1], middle[0])) and (b == len(right) or self.fits(middle[-1], right[b])):
                return [*left[:a], *middle, *right[b:]]
            k *= 2

    def part(self, text: str) -> Encoded:
        pieces = self.split.findall(text)
        return Encoded(text, pieces, [self.run(p) for p in pieces])

    def join(self, a: Encoded, b: Encoded) -> Encoded:
        """Encoding of a.text + b.text."""
        if not a.pieces or not b.pieces:
            return a if a.pieces else b
        keep = max(0, len(a.pieces) - BACK)
        tail = "".join(a.pieces[keep:])
        ends = np.cumsum([len(p) for p in b.pieces])
        width, whole = 64, len(b.text)
        while True:
            window, found, agreed = tail + b.text[:width], [], None
            last = width >= whole
            for m in self.split.finditer(window):
                if not last and m.end() > len(window) - 4:
                    break
                found.append(m.group())
                beyond = m.end() - len(tail)
                if beyond >= 0 and (beyond == 0 or ends[min(np.searchsorted(ends, beyond), len(ends) - 1)] == beyond):
                    agreed = 0 if beyond == 0 else int(np.searchsorted(ends, beyond)) + 1
                    break
            if agreed is not None:
                break
            if last:
                agreed = len(b.pieces)
                break
            width *= 2
        tokens = []
        for p in found:
            seam = len(p) > 64 and a.pieces and b.pieces and p == a.pieces[-1] + b.pieces[0]
            tokens.append(tuple(self.join_tokens([*a.tokens[-1]], [*b.tokens[0]])) if seam else self.run(p))
        return Encoded(a.text + b.text, [*a.pieces[:keep], *found, *b.pieces[agreed:]], [*a.tokens[:keep], *tokens, *b.tokens[agreed:]])

    def concatenate(self, parts: list[Encoded]) -> list[int]:
        """Pairwise up a tree."""
        while len(parts) > 1:
            parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return [t for piece in parts[0].tokens for t in piece] if parts else []


class Encoded:
    """A text, its pre-tokens and the tokens of each."""

    __slots__ = ("pieces", "text", "tokens")

    def __init__(self, text: str, pieces: list[str], tokens: list[tuple[int, ...]]):
        self.text, self.pieces, self.tokens = text, pieces, tokens


@lru_cache(4)
def codec(vocabulary: bytes, pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


def _rows(ids: pa.Array, tokens: list[np.ndarray], ok: list[bool]) -> pa.RecordBatch:
    size = np.array([len(t) for t in tokens], np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int32), *tokens]).astype(np.int32)))
    return pa.RecordBatch.from_arrays([ids, pa.array(size.astype(np.int32)), lists, pa.array(ok, pa.bool_())], ["doc_id", "n_tokens", "tokens", "round_trip"])


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, part: int = PART) -> DataFrame:
    """doc_id, n_tokens, tokens, round_trip (decoding gives the text back), for each row of docs.

    The vocabulary file is read on the driver and broadcast (its size is fixed). Short texts aren't shuffled.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    text_batches(docs.sparkSession)
    small = np.uint16 if part * 4 < 1 << 16 else np.uint32  # a run has at most as many tokens as bytes
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)
        for b in slices(batches, 1):
            own = as_text(b.column(1)).to_pylist()
            tokens = [c.encode(t) for t in own]
            yield _rows(b.column(0), tokens, [c.decode(t.tolist()) == x.encode() for t, x in zip(tokens, own)])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            for i in range(b.num_rows):
                text = b.column(2)[i].as_py()
                parts = [text[k : k + part] for k in range(0, len(text), part)]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(parts), pa.int64()), pa.array([b.column(1)[i].as_py()] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array(parts)], ["doc_id", "same", "k", "text"])

    def encode_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)
        for b in slices(batches, 3):
            done = [c.part(t) for t in b.column(3).to_pylist()]
            packed = lambda rows, kind: pa.array([np.array(r, kind).tobytes() for r in rows], pa.binary())
            lengths = packed(([len(p) for p in e.pieces] for e in done), small)
            counts = packed(([len(t) for t in e.tokens] for e in done), small)
            ids = packed(([x for t in e.tokens for x in t] for e in done), c.kind)
            yield pa.RecordBatch.from_arrays([*b.columns, lengths, counts, ids], ["doc_id", "same", "k", "text", "lengths", "counts", "ids"])

    def concatenate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)
        for b in batches:
            for i in range(b.num_rows):
                parts, seen, copies = [], -1, 0
                for p in b.column(1)[i].as_py():
                    copies += p["k"] == 0
                    if p["k"] == seen:
                        continue
                    seen = p["k"]
                    lengths, counts = (np.frombuffer(p[x], small).astype(np.int64) for x in ("lengths", "counts"))
                    ids = np.frombuffer(p["ids"], c.kind).tolist()
                    pieces = [p["text"][e - n : e] for e, n in zip(np.cumsum(lengths).tolist(), lengths.tolist())]
                    parts.append(Encoded(p["text"], pieces, [tuple(ids[e - n : e]) for e, n in zip(np.cumsum(counts).tolist(), counts.tolist())]))
                whole = "".join(p.text for p in parts)
                tokens = np.array(c.concatenate(parts), np.int32)
                ok = c.decode(tokens.tolist()) == whole.encode()
                for _ in range(copies):
                    yield _rows(b.column(0).slice(i, 1), [tokens], [ok])

    long_texts = texts.where(F.length("text") > part).select("doc_id", F.md5("text").alias("same"), "text")
    parts = (
        long_texts.mapInArrow(cut, "doc_id long, same string, k int, text string")
        .repartition("doc_id", "same", "k")
        .mapInArrow(encode_parts, "doc_id long, same string, k int, text string, lengths binary, counts binary, ids binary")
    )
    joined = (
        parts.groupBy("doc_id", "same")
        .agg(F.array_sort(F.collect_list(F.struct("k", "text", "lengths", "counts", "ids"))).alias("parts"))
        .select("doc_id", "parts")
        .mapInArrow(concatenate, SCHEMA)
    )
    return texts.where(F.length("text") <= part).mapInArrow(short, SCHEMA).unionByName(joined)


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
