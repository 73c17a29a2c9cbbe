"""License scans by diagonal voting.

All rolling GRAM-word hashes of all documents are joined in Spark to the positions of the same hashes in the license
templates (a fixed table, so it is broadcast). A match of document position i with template position j votes for the
diagonal i - j; votes are counted by (document, template, diagonal), and diagonals at most GAP apart, which differ
by a few inserted or lost words, merge into one band. Bands of a template that follow each other in the document
within the template's length, as where a page header interrupts a license, make one candidate span. A candidate whose
votes cover at least VOTES of the template's grams is verified on the document's words: the longest common
subsequence with the template must reach MATCH of the template's words.

Words are lower-cased letters and digits; other characters separate them, so line breaks and marks don't matter.

Defined results: null and empty texts have no span; rows without a doc_id take no part; rows that share a doc_id
are one document and give a span once; where verified spans overlap, the one with the most matched words stays, in a
tie that with the larger matched share, then the first template by name; an empty table gives an empty result;
columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.arrowtext import Words, as_text, ngrams, slices, words
from tidemark.llm.tables import text_batches, written

GRAM = 3
GAP = 3
VOTES = 0.4
MATCH = 0.8
#: Hash buckets of doc_ids that are told apart before the texts of candidates are fetched.
BUCKETS = 1 << 24
_BUCKET = f"pmod(xxhash64({{}}), {BUCKETS}L)"

TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    "AGPL-notice": "licensed under the GNU Affero General Public License, version 3.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all-rights-reserved": "All rights reserved.",
}


def license_words(column: pa.Array) -> Words:
    return words(pc.replace_substring_regex(pc.utf8_lower(as_text(column)), r"[^\pL\pN]+", " "))


def template_grams(templates: dict[str, str]) -> list[tuple[str, int, int, int]]:
    """(template, position, gram, words) for every gram of every template; a template shorter than a gram is refused."""
    out = []
    for name, text in templates.items():
        w = license_words(pa.array([text]))
        if len(w.ids) < GRAM:
            raise ValueError(f"template {name} has fewer than {GRAM} words")
        g, at = ngrams(w.hashes(), w.offsets, GRAM)
        out += [(name, int(p), int(x), len(w.ids)) for p, x in zip(at, g.view(np.int64))]
    return out


def _grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1):
        w = license_words(b.column(1))
        g, at = ngrams(w.hashes(), w.offsets, GRAM)
        doc = w.doc[at] if len(at) else at
        yield pa.RecordBatch.from_arrays([pc.take(b.column(0), pa.array(doc)), pa.array((at - w.offsets[doc]).astype(np.int32)), pa.array(g.view(np.int64))], ["doc_id", "pos", "gram"])


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        m = row & where.get(y, 0)
        row = (row + m | row - m) & full
    return len(a) - row.bit_count()


def candidates(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, template, from_word, to_word, votes: merged diagonals with enough votes."""
    spark = docs.sparkSession
    text_batches(spark)
    grams = spark.createDataFrame(template_grams(templates), "template string, tpos int, gram long, size int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    votes = (
        texts.mapInArrow(_grams, "doc_id long, pos int, gram long")
        .join(F.broadcast(grams), "gram")
        .groupBy("doc_id", "template", "size", (F.col("pos") - F.col("tpos")).alias("diagonal"))
        .agg(F.countDistinct("tpos").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    )
    order = W.partitionBy("doc_id", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > GAP, F.lit(True)).cast("int")
    bands = (
        votes.withColumn("new", new)
        .withColumn("band", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("doc_id", "template", "size", "band")
        .agg(F.sum("votes").alias("votes"), F.min("lo").alias("from_word"), (F.max("hi") + GRAM).alias("to_word"))
    )
    enough = F.col("votes") >= F.ceil((F.col("size") - GRAM + 1) * VOTES)
    # bands too weak alone, chained where the next begins within the template's length behind the one before
    place = W.partitionBy("doc_id", "template").orderBy("from_word", "band")
    apart = F.coalesce(F.col("from_word") - F.lag("to_word").over(place) > F.col("size"), F.lit(True)).cast("int")
    chained = (
        bands.where(~enough)
        .withColumn("apart", apart)
        .withColumn("chain", F.sum("apart").over(place.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("doc_id", "template", "size", "chain")
        .agg(F.sum("votes").alias("votes"), F.min("from_word").alias("from_word"), F.max("to_word").alias("to_word"))
    )
    both = bands.drop("band").unionByName(chained.drop("chain")).where(enough)
    return both.select("doc_id", "template", "from_word", "to_word", F.col("votes").cast("int").alias("votes"))


def _verify(templates: dict[str, str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(templates)
        t = license_words(pa.array([templates[n] for n in names]))
        h = t.hashes()
        of = {n: h[t.offsets[k] : t.offsets[k + 1]].tolist() for k, n in enumerate(names)}
        for b in slices(batches, 1):
            w = license_words(b.column(1))
            h = w.hashes()
            rows = []
            for k, (doc_id, spans) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                own = h[w.offsets[k] : w.offsets[k + 1]]
                good, taken = [], []
                for s in spans:
                    want = of[s["template"]]
                    slack = max(GAP, len(want) - (s["to_word"] - s["from_word"]))
                    lo, hi = max(0, s["from_word"] - slack), min(len(own), s["to_word"] + slack)
                    shared = common_subsequence(want, own[lo:hi].tolist())
                    if shared >= MATCH * len(want):
                        good.append((-shared, -shared / len(want), s["template"], s["from_word"], s["to_word"], s["votes"]))
                for _, share, name, lo, hi, n in sorted(good):
                    if all(hi <= a or b <= lo for a, b in taken):
                        taken.append((lo, hi))
                        rows.append((doc_id, name, lo, hi, n, round(-share, 4)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()))], ["doc_id", "template", "from_word", "to_word", "votes", "matched"])

    return run


def _bits(ids: DataFrame, name: str) -> DataFrame:
    """word, bits: the buckets of the ids."""
    return ids.select(F.expr(f"{_BUCKET.format(name)} div 64 as word"), F.expr(f"shiftleft(1L, cast({_BUCKET.format(name)} % 64 as int)) as bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, template, from_word, to_word, votes, matched: the verified spans.

    Runs the vote at once. Of the texts only those in a candidate's bucket of doc_ids are shuffled to it. The buckets
    are broadcast as bits, 64 a row, so that there are BUCKETS / 64 rows at most, however many candidates there are.
    """
    voted = candidates(docs, templates).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("template", "from_word", "to_word", "votes")).alias("spans"))
    found = written(voted, "license-candidates")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    near = texts.join(F.broadcast(_bits(found, "_id")), F.expr(f"{_BUCKET.format('doc_id')} div 64 = word")).where(f"(shiftright(bits, cast({_BUCKET.format('doc_id')} % 64 as int)) & 1) = 1")
    return near.join(found, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "spans").mapInArrow(_verify(templates), "doc_id long, template string, from_word int, to_word int, votes int, matched double").distinct()


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
