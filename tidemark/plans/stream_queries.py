"""Registered queries: streams over stored tables, run until nothing is left and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.gate import GateConfig
from tidemark.plans.page_queries import _DOMAIN, _GATE, _HASH, _PARTS
from tidemark.plans.registry import KEYWORD, query, table
from tidemark.plans.source_queries import place
from tidemark.streaming import driver


def _streamed(spark, rows, name, batches=4):
    """rows, stored in files that arrive in four parts: a file for each task that reads them, four at least."""
    path = place(spark, name)
    files = rows._jdf.queryExecution().toRdd().getNumPartitions()
    (rows if files >= batches else rows.repartition(batches)).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-max(files, batches) // batches)).parquet(path)


def _drained(spark, stream, name):
    out = place(spark, f"{name}-out")
    driver.run_available(stream, out, place(spark, f"{name}-log"))
    return spark.read.parquet(out)


@query(f"with {_GATE}, one as (select *, {_HASH} as hash from gated) select hash as content_hash, any_value(method) as method, any_value(decision) as decision, any_value(keyword_hits)::int as keyword_hits from (select hash, method, decision, h as keyword_hits from one where length(text) = length(trim(regexp_replace(text, '\\s+', ' ', 'g')))) x group by hash")
def stream_gate(spark, sf_dir):
    """Documents as a stream, each content judged once (texts without blanks to collapse)."""
    d = table(spark, sf_dir, "documents").where("length(text) = length(trim(regexp_replace(text, '\\\\s+', ' ')))").select("doc_id", "text")
    s = driver.gated_stream(_streamed(spark, d, "texts"), [KEYWORD], GateConfig(keywords=(KEYWORD,)))
    return _drained(spark, s, "gate").select("content_hash", "method", "decision", "keyword_hits")


@query(f"with {_PARTS}, d as (select page_id, {_DOMAIN} as domain from parts) select domain, least(count(*), 5) as kept, count(distinct page_id) as seen from d group by domain")
def stream_quota(spark, sf_dir):
    """The quota of links a slot and domain, kept up across micro-batches."""
    p = table(spark, sf_dir, "pages").select(F.lit(1).cast("long").alias("slot_id"), "url", F.col("page_id").alias("ord"))
    kept = _drained(spark, driver.quota_stream(_streamed(spark, p, "links"), 5), "quota")
    counts = kept.groupBy("domain").agg(F.count(F.lit(1)).alias("kept"), F.max("place").alias("last")).where("kept = last").select("domain", "kept")
    seen = p.groupBy(driver.U.domain(F.col("url")).alias("domain")).agg(F.count_distinct("ord").alias("seen"))
    return counts.join(seen, "domain")


@query(f"with {_PARTS} select distinct 'https://' || lower(host) || '/a/b/' || page_id % 50 || '.html' as url from parts")
def stream_urls(spark, sf_dir):
    """A stream of links to distinct canonical articles."""
    u, n = F.col("url"), (F.col("page_id") % 50).cast("string")
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("HTTPS://"), driver.U.netloc(u), F.lit(":443/a//b/"), n, F.lit(".html?utm_source=s#x")).alias("url"))
    index = p.select(F.concat(F.regexp_replace("url", ":443.*", ""), F.lit("/index.html")).alias("url"))
    return _drained(spark, driver.url_stream(_streamed(spark, p.unionByName(index), "urls")), "urls")


@query(f"with {_PARTS}, d as (select {_DOMAIN} as domain, page_id // 6 as h from parts) select h::bigint as hour, domain, count(*) as links from d where h < (select max(page_id) // 6 - 3 from pages) group by all")
def stream_domain_counts(spark, sf_dir):
    """Links an hour and domain, emitted once the watermark has passed the hour."""
    p = table(spark, sf_dir, "pages").select("url", F.timestamp_seconds(F.col("page_id") * 600).alias("ts")).coalesce(1)
    path = place(spark, "timed")
    p.write.parquet(path)
    counts = driver.domain_counts(spark.readStream.schema(p.schema).parquet(path))
    out = _drained(spark, counts.select("window.start", "domain", "links"), "counts")
    last = table(spark, sf_dir, "pages").agg(F.floor(F.max("page_id") / 6).alias("last"))
    hour = F.floor(F.unix_timestamp("start") / 3600)
    return out.select(hour.alias("hour"), "domain", "links").join(F.broadcast(last), F.col("hour") < F.col("last") - 3).drop("last")
