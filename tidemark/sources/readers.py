"""Readers of slides, seeds, recall results and cached pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas

#: Slot ids of a slide; an array can't hold as many keywords.
SLOTS = 1 << 31


def slides(spark: SparkSession, path: str) -> DataFrame:
    """One row a slide decision."""
    return spark.read.schema(schemas.SLIDES).option("multiLine", True).json(path).select("input_file", F.explode("decisions").alias("d")).select("input_file", "d.*")


def slots(slide_rows: DataFrame) -> DataFrame:
    """slot_id, slide_number, title, reason, keyword: one row for each keyword of each selected slide, in its order."""
    chosen = slide_rows.where(F.col("should_optimize") & (F.size("suggested_keywords") > 0))
    rows = chosen.select("slide_number", "title", "reason", F.posexplode("suggested_keywords").alias("k", "keyword"))
    return rows.select((F.col("slide_number").cast("long") * SLOTS + F.col("k")).alias("slot_id"), "slide_number", "title", "reason", "keyword")


def seeds(spark: SparkSession, path: str, category: str, statuses: Sequence[str] = ("approved", "pending")) -> DataFrame:
    """ord, url: the seeds of a category whose status allows it."""
    catalog = spark.read.schema(schemas.SEED_CATALOG).option("multiLine", True).json(path).select(F.explode("preset_urls").alias("category", "c"))
    return catalog.where((F.col("category") == category) & F.col("c.status").isin(*statuses)).select(F.posexplode("c.urls").alias("ord", "url"))


def recall_candidates(spark: SparkSession, path: str) -> DataFrame:
    """keyword, ord, url, score, sources."""
    r = spark.read.schema(schemas.RECALL).option("multiLine", True).json(path).select(F.explode("results").alias("r"))
    return r.select("r.keyword", F.posexplode("r.ranked_candidates").alias("ord", "c")).select("keyword", "ord", "c.*")


def scored_pages(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of page records; lines that hold none are skipped."""
    return spark.read.schema(schemas.PAGE_RECORD).json(path).where("relevance_score is not null")


def item_fields(item: Column) -> Column:
    """struct<title, summary, url> of a feed item's XML."""
    field = lambda name: F.trim(F.regexp_extract(item, f"(?is)<{name}(?: [^>]*)?>(.*?)</{name}>", 1))
    return F.struct(field("title").alias("title"), field("description").alias("summary"), field("link").alias("url"))


def feed_item_rows(feeds: DataFrame, key: str, body: str, most: int = 30) -> DataFrame:
    """key, ord, title, summary, url: the first items of each feed (XML text); a broken feed gives none, an item without a link neither."""
    plain = F.regexp_replace(body, "<!\\[CDATA\\[|\\]\\]>", "")
    items = F.slice(F.regexp_extract_all(plain, F.lit("(?is)<item[ >](.*?)</item>"), 1), 1, most)
    rows = feeds.select(key, F.posexplode(items).alias("ord", "item")).select(key, "ord", item_fields(F.col("item")).alias("x"))
    return rows.select(key, "ord", "x.*").where("url != ''")


def cached(tasks: DataFrame, pages: DataFrame) -> DataFrame:
    """tasks with their page by data_id; success and error say whether there was one."""
    known = pages.withColumn("_found", F.lit(True))
    j = tasks.join(known, "data_id", "left")
    return j.withColumn("success", F.coalesce("_found", F.lit(False))).withColumn("error", F.when(F.col("success"), None).otherwise("no cached page")).drop("_found")


def feed_items(spark: SparkSession, path: str, most: int = 30) -> DataFrame:
    """feed, ord, title, summary, url of RSS files, the first items of each."""
    return feed_item_rows(spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("feed"), "value"), "feed", "value", most)
