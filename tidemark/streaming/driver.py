"""Streaming counterparts: gate and deduplicate pages as they arrive."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators.gate import GateConfig, gate


def gated_stream(texts: DataFrame, keywords: Sequence[str], config: GateConfig) -> DataFrame:
    """A stream of documents (doc_id, text) with the gate's verdict; each content once.

    State is one 16-byte key a distinct content; put a watermark on the input to bound it.
    """
    p = texts.select("doc_id", F.col("text").alias("main_content"), T.content_hash(F.col("text")).alias("content_hash"), T.keyword_hits(F.col("text"), keywords).alias("keyword_hits"), F.array().cast("array<string>").alias("headings"))
    return gate(p.dropDuplicates(["content_hash"]), config)


def url_stream(links: DataFrame, watermark: str | None = None) -> DataFrame:
    """A stream of links (url[, ts]) to distinct canonical URLs that look like articles."""
    u = links.withColumn("url", U.canonical(F.col("url"))).where(F.col("url").isNotNull() & U.looks_like_article(F.col("url")))
    return u.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["url"]) if watermark else u.dropDuplicates(["url"])


def domain_counts(links: DataFrame, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Windowed counts of links (url, ts) by domain, late ones dropped behind the watermark."""
    return links.withWatermark("ts", watermark).groupBy(F.window("ts", window), U.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("links"))


def quota_stream(links: DataFrame, most: int) -> DataFrame:
    """A stream of links (slot_id, url, ord) cut to the first ``most`` of each slot and domain, with their place.

    State is one count a slot and domain, which every later micro-batch goes on from. Links of a micro-batch count by ord.
    """

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        left = most - used
        rows = pd.concat(list(frames)).sort_values(["ord", "url"], kind="stable").head(left)
        if len(rows):
            state.update((used + len(rows),))
        yield rows.assign(place=range(used + 1, used + 1 + len(rows)))[["slot_id", "domain", "url", "ord", "place"]]

    rows = links.select(F.col("slot_id").cast("long").alias("slot_id"), U.domain(F.col("url")).alias("domain"), "url", F.col("ord").cast("long").alias("ord"))
    out = "slot_id long, domain string, url string, ord long, place long"
    return rows.groupBy("slot_id", "domain").applyInPandasWithState(count, out, "used long", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is, then stop."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()
