"""Writers: page store, record lines, nested report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def store_pages(pages: DataFrame, path: str, ord_: str | None = None) -> None:
    """Pages as Parquet under their data_id = md5(url); of several for one URL, the last."""
    p = pages.withColumn("data_id", F.md5("url"))
    if ord_:
        p = p.withColumn("_n", F.row_number().over(W.partitionBy("data_id").orderBy(F.desc(ord_)))).where("_n = 1").drop("_n")
    p.write.mode("overwrite").parquet(path)


def write_records(records: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; overwrites unless told to append."""
    records.write.mode("append" if append else "overwrite").json(path)


def report_rows(pages: DataFrame) -> DataFrame:
    """The columns of the report: url, title, summary, relevance_score, reason; others stay in front."""
    own = [c for c in pages.columns if c in ("slot_id", "slide_number", "keyword", "rank")]
    return pages.select(*own, "url", "title", F.col("text_snippet").alias("summary"), "relevance_score", F.col("reasons").alias("reason"))


def nested_report(rows: DataFrame, slides: DataFrame, timestamp: str) -> DataFrame:
    """slide rows with keywords_information: keyword -> its ranked results, and the time given."""
    results = rows.groupBy("slide_number", "keyword").agg(F.array_sort(F.collect_list(F.struct("rank", "url", "title", "summary", "relevance_score", "reason"))).alias("found"))
    listed = results.withColumn("found", F.transform("found", lambda x: x.dropFields("rank")))
    by_slide = listed.groupBy("slide_number").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("keyword", "found")))).alias("keywords_information"))
    return slides.join(by_slide, "slide_number", "left").withColumn("crawl_timestamp", F.lit(timestamp))


def write_report(report: DataFrame, path: str) -> None:
    """One JSON file of all slides; the report is as small as the slide deck."""
    report.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
