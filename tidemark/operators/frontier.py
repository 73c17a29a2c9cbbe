"""Focused crawl as level-synchronous breadth-first search over DataFrames.

Order within a slot is the path from a seed: the seed's place, then the position of each link followed. Paths of a
level compare like the queue of one worker. Budgets count every processed page, fetched or not. All state is in
written tables of a few narrow columns, one a level; texts are read once, when pages are judged, and once more at the
end, for the pages that are returned. The driver holds only row counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.operators.gate import VERDICT, GateConfig, gate
from tidemark.tables import dropped, written


@dataclass(frozen=True)
class CrawlConfig:
    max_depth: int = 2
    max_pages: int = 30
    max_pages_per_domain: int = 10
    gate: GateConfig = field(default_factory=GateConfig)


def seed_frontier(slots: DataFrame, seeds: DataFrame) -> DataFrame:
    """slot_id, url, ord: canonical seeds of every slot, first occurrence in order. seeds: ord, url."""
    s = seeds.select("ord", U.canonical(F.col("url")).alias("url")).where("url is not null").groupBy("url").agg(F.min("ord").cast("long").alias("ord"))
    return slots.select("slot_id").crossJoin(s).select("slot_id", "url", "ord")


def _first(rows: DataFrame, by: list, most: int = 1) -> DataFrame:
    """The first rows of each key in the order of the crawl; a limit that Spark applies before it shuffles them."""
    return rows.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy("depth", "path"))).where(F.col("n") <= most).drop("n")


def within_budget(frontier: DataFrame, done: DataFrame | None, depth: int, config: CrawlConfig) -> DataFrame:
    """slot_id, url, path, domain, depth: the rows of frontier (slot_id, url, path) that weren't processed before and that domain quotas and the page budget let through.

    What was done counts by standing in front: it is at most a page budget a slot, so no join with counts is needed.
    """
    rows = frontier.select("slot_id", "url", "path", U.domain(F.col("url")).alias("domain"), F.lit(depth).alias("depth"))
    if done is not None:
        rows = done.select(rows.columns).unionAll(rows)
    own = F.when(F.col("domain") == "", F.col("url"))  # URLs without a domain share no quota
    rows = _first(_first(rows, ["slot_id", "url"]), ["slot_id", "domain", own], config.max_pages_per_domain)
    return _first(rows, ["slot_id"], config.max_pages).where(F.col("depth") == depth)


def with_evaluated(pages: DataFrame, done: DataFrame | None, depth: int) -> DataFrame:
    """pages (slot_id, depth, path, content_hash, ...) with ``evaluated``: whether the page is there and its content is new to the slot.

    Pages without a hash are always new.
    """
    rows = pages
    if done is not None:
        rows = done.where("evaluated").select(*(F.col(c) if c in ("slot_id", "depth", "path", "content_hash") else F.lit(None).cast(t).alias(c) for c, t in pages.dtypes)).unionAll(pages)
    alone = F.when(F.coalesce("content_hash", F.lit("")) == "", F.concat_ws(" ", "depth", F.col("path").cast("string")))
    n = F.row_number().over(W.partitionBy("slot_id", "content_hash", alone).orderBy("depth", "path"))
    return rows.withColumn("evaluated", F.col("content_hash").isNotNull() & (n == 1)).where(F.col("depth") == depth)


def crawl(slots: DataFrame, seeds: DataFrame, pages: DataFrame, config: CrawlConfig, scorer: Callable | None = None) -> DataFrame:
    """slot_id, ord (from 1, in the order of the crawl), depth, url, the page's columns and the gate's result for every evaluated page.

    pages is the replay source: url (canonical), success, title, main_content, headings, keyword_hits, content_hash,
    text_snippet, extracted_links (array<struct<url, text, title>>). A live fetcher fills such a table first. Without
    a scorer a page's verdict is the same wherever it is reached, so all are judged by rules in one pass; a scorer is
    asked level by level, about the pages that are reached and no others. Runs jobs at once: one written table a level.
    """
    known = pages.where("success").withColumn("content_hash", F.coalesce("content_hash", F.lit("")))
    judged = None if scorer else written(gate(known, config.gate).select("url", "content_hash", "extracted_links", *VERDICT), "crawl-verdicts")
    frontier = seed_frontier(slots, seeds).select("slot_id", "url", F.array("ord").alias("path"))
    levels: list[DataFrame] = []
    for depth in range(config.max_depth + 1):
        done = reduce(DataFrame.unionAll, [x.select("slot_id", "url", "path", "domain", "depth", "content_hash", "evaluated") for x in levels]) if levels else None
        admitted = within_budget(frontier, done, depth, config)
        if scorer is None:
            level = written(with_evaluated(admitted.join(judged, "url", "left"), done, depth), f"crawl-{depth}")
        else:
            marked = written(with_evaluated(admitted.join(known.select("url", "content_hash"), "url", "left"), done, depth), f"crawl-marked-{depth}")
            asked = gate(marked.where("evaluated").select("slot_id", "url").join(known, "url"), config.gate, scorer)
            level = written(marked.join(asked.select("slot_id", "url", "extracted_links", *VERDICT), ["slot_id", "url"], "left"), f"crawl-{depth}")
            dropped(marked)
        if level.isEmpty():
            dropped(level)
            break
        levels.append(level)
        links = level.where("evaluated and expand").select("slot_id", "path", F.posexplode("extracted_links").alias("pos", "link"), F.col("url").alias("_base"))
        new = links.select("slot_id", U.canonical(F.col("link.url"), F.col("_base")).alias("url"), F.concat("path", F.array(F.col("pos").cast("long"))).alias("path"))
        frontier = new.where(F.col("url").isNotNull() & U.looks_like_article(F.col("url")))
    dropped(judged)
    if not levels:
        raise ValueError("there is no seed within the budget")
    light = reduce(DataFrame.unionAll, [x.where("evaluated").select("slot_id", "url", "path", "depth", *VERDICT) for x in levels])
    light = light.withColumn("ord", F.row_number().over(W.partitionBy("slot_id").orderBy("depth", "path"))).drop("path")
    return light.join(known.select(*(c for c in pages.columns if c not in VERDICT)).dropDuplicates(["url"]), "url")
