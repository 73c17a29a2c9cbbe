"""Ranks, quotas, order-preserving unions and counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import urls as U


def top_per_group(df: DataFrame, group: Sequence[str], score: str, ord_: str, k: int = 3) -> DataFrame:
    """The k best rows of each group, ties in order; with the rank."""
    n = F.row_number().over(W.partitionBy(*group).orderBy(F.desc(score), F.asc(ord_)))
    return df.withColumn("rank", n).where(F.col("rank") <= k)


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key: the first in order (dropDuplicates would keep any)."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def union_in_order(parts: Sequence[DataFrame], url: str = "url", ord_: str = "ord", by: Sequence[str] = ()) -> DataFrame:
    """Distinct normalised URLs of all parts: those of the first part first. Columns: by, url, src_rank, ord."""
    all_of = None
    for k, p in enumerate(parts):
        one = p.select(*by, U.without_fragment(F.col(url)).alias("url"), F.lit(k).alias("src_rank"), F.col(ord_).alias("ord")).where("url is not null and url != ''")
        all_of = one if all_of is None else all_of.unionByName(one)
    return first_wins(all_of, [*by, "url"], ["src_rank", "ord"])


def except_known(candidates: DataFrame, known: DataFrame, key: Sequence[str]) -> DataFrame:
    """The distinct keys of candidates that aren't among the known ones (queued or visited, say)."""
    return candidates.select(*key).distinct().join(known.select(*key), list(key), "left_anti")


def sources_of(df: DataFrame, key: Sequence[str], source: str = "source") -> DataFrame:
    """Sorted distinct sources of each key."""
    return df.groupBy(*key).agg(F.array_sort(F.collect_set(source)).alias("sources"))


def trim(df: DataFrame, group: Sequence[str], kind: str, score: str, ord_: str, most: Mapping[str, int]) -> DataFrame:
    """At most most[kind] rows of each group and kind, the best first."""
    cap = F.coalesce(*(F.when(F.col(kind) == k, n) for k, n in most.items()), F.lit(0))
    n = F.row_number().over(W.partitionBy(*group, kind).orderBy(F.desc(score), F.asc(ord_)))
    return df.withColumn("rank", n).where(F.col("rank") <= cap)


def quota(df: DataFrame, group: Sequence[str], domain: Column, ord_: str, most: int) -> DataFrame:
    """The first ``most`` rows of each domain within each group."""
    n = F.row_number().over(W.partitionBy(*group, domain).orderBy(ord_))
    return df.withColumn("rank", n).where(F.col("rank") <= most)


def run_statistics(pages: DataFrame, seconds: Column | float) -> DataFrame:
    """One row: processed, kept, discarded, expanded, unique domains, distinct contents, pages per second."""
    n = F.count(F.lit(1))
    return pages.agg(
        n.alias("processed"),
        F.count_if(F.col("decision") == "keep").alias("kept"),
        F.count_if(F.col("decision") != "keep").alias("discarded"),
        F.count_if("expand").alias("expanded"),
        F.count_distinct(U.domain(F.col("url"))).alias("unique_domains"),
        F.count_distinct("content_hash").alias("unique_contents"),
        (n / F.greatest(F.lit(seconds).cast("double"), F.lit(1.0))).alias("pages_per_second"),
    )


def step_metrics(success: Column, seconds: Column | float = 0.0) -> list[Column]:
    """processed, success, failed, total_time of the rows of a step."""
    ok, spent = F.coalesce(success, F.lit(False)), seconds if isinstance(seconds, Column) else F.lit(seconds)
    return [
        F.count(F.lit(1)).alias("processed"),
        F.count_if(ok).alias("success"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(spent.cast("double")), F.lit(0.0)).alias("total_time"),
    ]


def observed(rows: DataFrame, success: Column, seconds: Column | float = 0.0) -> tuple[DataFrame, Observation]:
    """rows unchanged, and the step's metrics, which are there once an action has gone over the rows."""
    o = Observation()
    return rows.observe(o, *step_metrics(success, seconds)), o


def counts_by_source(candidates: DataFrame, by: Sequence[str] = ("keyword",), source: str = "source") -> DataFrame:
    """by, source, candidates: distinct URLs that each source gave."""
    return candidates.groupBy(*by, source).agg(F.count_distinct("url").alias("candidates"))
