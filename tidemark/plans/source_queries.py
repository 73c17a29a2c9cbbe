"""Registered queries: what is read and written. Files are made from the driver's tables in the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import rank as R
from tidemark.operators.frontier import CrawlConfig, crawl, seed_frontier
from tidemark.plans.page_queries import _GATE, GATE, _crawl_sql, replay_pages
from tidemark.plans.registry import query, table
from tidemark.sources import adapters, readers, sinks
from tidemark.tables import shared_folder


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved_json(rows: DataFrame, name: str) -> str:
    """A folder with one JSON file that lists the rows."""
    path = place(rows.sparkSession, name)
    rows.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).coalesce(1).write.text(path)
    return path


_DECK = "deck as (select doc_id as slide_number, lang as title, doc_id % 2 = 0 as should_optimize, source as reason, case when doc_id % 5 = 0 then [] else [lang, 'k' || doc_id, source] end as words from documents where doc_id < 300)"


def _deck(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id < 300")
    words = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", F.concat(F.lit("k"), "doc_id"), "source"))
    slide = F.struct(F.col("doc_id").alias("slide_number"), F.col("lang").alias("title"), (F.col("doc_id") % 2 == 0).alias("should_optimize"), F.col("source").alias("reason"), words.alias("suggested_keywords"), F.lit("").alias("optimization_strategy"))
    return d.groupBy(F.col("lang").alias("input_file")).agg(F.collect_list(slide).alias("decisions"))


@query(f"with {_DECK} select title as input_file, slide_number::int as slide_number, should_optimize, reason, array_to_string(words, ',') as keywords from deck")
def slides_read(spark, sf_dir):
    s = readers.slides(spark, saved_json(_deck(spark, sf_dir), "deck"))
    return s.select("input_file", "slide_number", "should_optimize", "reason", F.array_join("suggested_keywords", ",").alias("keywords"))


@query(f"with {_DECK} select slide_number * 2147483648 + k as slot_id, slide_number::int as slide_number, words[k + 1] as keyword from deck, (values (0), (1), (2)) t(k) where should_optimize and len(words) > 0")
def slots_of_slides(spark, sf_dir):
    return readers.slots(readers.slides(spark, saved_json(_deck(spark, sf_dir), "deck"))).select("slot_id", "slide_number", "keyword")


@query(f"with {_DECK} select count(*)::int as slides, count_if(should_optimize)::int as to_process, sum(len(words))::bigint as keywords, count(distinct title) as decks from deck")
def deck_statistics(spark, sf_dir):
    s = readers.slides(spark, saved_json(_deck(spark, sf_dir), "deck"))
    return s.agg(F.count(F.lit(1)).cast("int").alias("slides"), F.count_if("should_optimize").cast("int").alias("to_process"), F.sum(F.size("suggested_keywords")).cast("long").alias("keywords"), F.count_distinct("input_file").alias("decks"))


@query("with o as (select *, 'c' || page_id % 3 as category from pages where page_id < 200) select category, (row_number() over (partition by category order by url) - 1)::int as ord, url from o where category <> 'c2'")
def seed_catalog_read(spark, sf_dir):
    """Approved and pending categories; the refused one gives nothing."""
    p = table(spark, sf_dir, "pages").where("page_id < 200").select("url", F.concat(F.lit("c"), F.col("page_id") % 3).alias("category"))
    status = F.when(F.col("category") == "c0", "approved").when(F.col("category") == "c1", "pending").otherwise("rejected")
    entry = F.struct(F.col("category").alias("name"), F.array_sort("urls").alias("urls"), status.alias("status"))
    c = p.groupBy("category").agg(F.collect_list("url").alias("urls")).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("category", entry))).alias("preset_urls"))
    path = saved_json(c, "catalog")
    return readers.seeds(spark, path, "c0").withColumn("category", F.lit("c0")).unionByName(readers.seeds(spark, path, "c1").withColumn("category", F.lit("c1"))).unionByName(readers.seeds(spark, path, "c2").withColumn("category", F.lit("c2"))).select("category", "ord", "url")


@query("select 'k' || page_id % 4 as keyword, (row_number() over (partition by page_id % 4 order by page_id) - 1)::int as ord, url, (page_id % 7)::int as score, 'rss,web' as sources from pages")
def recall_results_read(spark, sf_dir):
    c = F.struct("page_id", "url", (F.col("page_id") % 7).alias("score"), F.array(F.lit("rss"), F.lit("web")).alias("sources"))
    r = table(spark, sf_dir, "pages").groupBy(F.concat(F.lit("k"), F.col("page_id") % 4).alias("keyword")).agg(F.array_sort(F.collect_list(c)).alias("ranked_candidates"))
    results = r.agg(F.collect_list(F.struct("keyword", F.lit("en").alias("language"), "ranked_candidates")).alias("results"))
    return readers.recall_candidates(spark, saved_json(results, "recall")).withColumn("sources", F.array_join("sources", ","))


@query("select 'u' || doc_id as url, case when doc_id % 2 = 0 then 0.25 else 0.5 end::double as relevance_score, lang as title from documents where doc_id % 3 <> 2")
def scored_lines_read(spark, sf_dir):
    """Record lines overwritten, appended to, and read back without those that hold no score."""
    d, path = table(spark, sf_dir, "documents"), place(spark, "lines")
    row = lambda k, score: d.where(f"doc_id % 3 = {k}").select(F.concat(F.lit("u"), "doc_id").alias("url"), score.alias("relevance_score"), F.col("lang").alias("title"))
    score = F.when(F.col("doc_id") % 2 == 0, 0.25).otherwise(0.5)
    sinks.write_records(row(2, score), path)
    sinks.write_records(row(0, score), path)
    sinks.write_records(row(1, score), path, append=True)
    sinks.write_records(row(2, F.lit(None).cast("double")), path, append=True)
    return readers.scored_pages(spark, path).select("url", "relevance_score", "title")


@query("select md5(url) as data_id, url, max(page_id) as last, count(*) > 0 as stored from pages group by url")
def page_store(spark, sf_dir):
    """Pages stored under the hash of their URL; of several, the last."""
    path = place(spark, "store")
    sinks.store_pages(table(spark, sf_dir, "pages").select("url", "page_id"), path, "page_id")
    return spark.read.parquet(path).select("data_id", "url", F.col("page_id").alias("last"), F.lit(True).alias("stored"))


@query("select page_id, page_id % 2 = 0 as success, case when page_id % 2 = 0 then length(url) end as size, case when page_id % 2 = 1 then 'no cached page' end as error from pages")
def extracted_cache(spark, sf_dir):
    """Extracted pages stored and looked up again."""
    p, path = table(spark, sf_dir, "pages"), place(spark, "extracted")
    p.where("page_id % 2 = 0").select(F.md5(F.concat("url", "page_id")).alias("data_id"), F.length("url").cast("long").alias("size")).write.parquet(path)
    return readers.cached(p.select("page_id", F.md5(F.concat("url", "page_id")).alias("data_id")), spark.read.parquet(path)).select("page_id", "success", "size", "error")


@query(
    """with r as (select doc_id % 20 as slide_number, lang as keyword, doc_id, row_number() over (partition by doc_id % 20, lang order by doc_id) as rank from documents)
    select slide_number::int as slide_number, keyword, rank::int as rank, 'u' || doc_id as url, 's' || doc_id as summary, 'because' as reason from r where rank <= 3"""
)
def nested_report(spark, sf_dir):
    """The three first of each slide and keyword, written as a nested report and read back."""
    d = table(spark, sf_dir, "documents").withColumn("slide_number", (F.col("doc_id") % 20).cast("int"))
    top = R.top_per_group(d.withColumn("relevance_score", F.lit(0.5)), ["slide_number", "lang"], "relevance_score", "doc_id", 3)
    pages = top.select("slide_number", F.col("lang").alias("keyword"), "rank", F.concat(F.lit("u"), "doc_id").alias("url"), F.lit("t").alias("title"), F.concat(F.lit("s"), "doc_id").alias("text_snippet"), "relevance_score", F.lit("because").alias("reasons"))
    path = place(spark, "report")
    sinks.write_report(sinks.nested_report(sinks.report_rows(pages), d.select("slide_number").distinct(), "2024-01-01"), path)
    found = "array<struct<url: string, title: string, summary: string, relevance_score: double, reason: string>>"
    back = spark.read.schema(f"slide_number int, crawl_timestamp string, keywords_information map<string, {found}>").json(path)
    flat = back.select("slide_number", F.explode("keywords_information").alias("keyword", "found")).select("slide_number", "keyword", F.posexplode("found").alias("k", "x"))
    return flat.select("slide_number", "keyword", (F.col("k") + 1).alias("rank"), "x.url", "x.summary", "x.reason")


@query("select doc_id, lang, source from documents where doc_id % 2 = 0")
def records_round_trip(spark, sf_dir):
    """Rows to JSON text and back."""
    d = table(spark, sf_dir, "documents").where("doc_id % 2 = 0")
    lines = d.select(F.to_json(F.struct("doc_id", "lang", "source", "text")).alias("line"))
    return lines.select(F.from_json("line", "doc_id bigint, lang string, source string, text string").alias("r")).select("r.doc_id", "r.lang", "r.source")


@query("select page_id, ord::int as ord, 'T' || page_id || '-' || ord as title, 'about & more' as summary, 'http://f/' || page_id || '/' || ord as url from pages, (values (0), (1)) t(ord) where page_id % 4 <> 3")
def feed_items(spark, sf_dir):
    """Items of feeds: the first three, of which the one without a link is left out; broken feeds give none."""
    item = lambda k, link: F.concat(F.lit("<item><title><![CDATA[T"), "page_id", F.lit(f"-{k}]]></title><description> about & more </description>{'<link>http://f/' if link else ''}"), F.when(F.lit(link), F.col("page_id").cast("string")).otherwise(""), F.lit(f"/{k}</link></item>" if link else "</item>"))
    body = F.when(F.col("page_id") % 4 == 3, "<rss><item><title>cut").otherwise(F.concat(F.lit("<rss><channel>"), item(0, True), item(1, True), item(2, False), item(3, True), F.lit("</channel></rss>")))
    return readers.feed_item_rows(table(spark, sf_dir, "pages").select("page_id", body.alias("body")), "page_id", "body", 3)


def numbered(url: str) -> dict:
    """A fetcher without a network: fails for every third number, sends the body in chunks."""
    n = int(url.rsplit("/", 1)[1])
    if n % 3 == 2:
        adapters.raise_for(404 if n % 2 else 503)
    return {"html": (b"<p>" + str(n).encode() + b"</p>" * 3 for _ in range(1000)), "status_code": 200, "title": f"t{n}"}


@query(
    """select page_id, page_id % 3 <> 2 as success, case when page_id % 3 = 2 then 0 else 200 end as status_code, case when page_id % 3 <> 2 then 20 else 0 end::int as size,
    case when page_id % 3 <> 2 then null when page_id % 2 = 1 then 'HTTP 404' else 'retry after None s' end as error from pages where page_id < 200"""
)
def fetched_pages(spark, sf_dir):
    """Pages cut after 20 bytes; failures are rows."""
    p = table(spark, sf_dir, "pages").where("page_id < 200").select(F.concat(F.lit("http://n/"), "page_id").alias("url"))
    got = adapters.fetch(p, numbered, 4, max_bytes=20, sleep=_no_wait)
    return got.select(F.regexp_extract("url", "[0-9]+$", 0).cast("long").alias("page_id"), "success", "status_code", F.length("html").alias("size"), "error")


def _no_wait(seconds: float) -> None:
    """A far side that never asks to wait."""


def result_page(url: str) -> dict:
    """A search engine without a network: result links of the keyword, after a first reply that is too short."""
    word = url.rsplit("=", 1)[1]
    links = "".join(f'<a class="result__a" href="/l/?uddg=http%3A%2F%2F{word}.example%2F{k % 2}">x</a>' for k in range(4))
    return {"html": "" if word == "empty" else links + " " * 1000, "status_code": 200}


@query("select 'k' || page_id as keyword, k::int as ord, 'http://k' || page_id || '.example/' || k as url from pages, (values (0), (1)) t(k) where page_id < 40")
def web_search(spark, sf_dir):
    k = table(spark, sf_dir, "pages").where("page_id < 40").select(F.concat(F.lit("k"), "page_id").alias("keyword"))
    return adapters.web_search(k.unionByName(spark.createDataFrame([("empty",)], "keyword string")), result_page, "https://find.example/?q={}", 4, sleep=_no_wait)


def indexed(query: str, most: int) -> list[str]:
    """Articles of a news index in widening spans, until there are enough; the second span is refused once."""
    calls: list[str] = []

    def get(params: dict) -> tuple[int, dict, dict]:
        calls.append(params["timespan"])
        if params["timespan"] == "3m" and calls.count("3m") == 1:
            return 429, {"Retry-After": "7"}, {}
        n = {"1m": 2, "3m": 4, "6m": 30}[params["timespan"]]
        return 200, {}, {"articles": [{"url": f"http://{query}.example/{k}/#x"} for k in range(n)] + [{}]}

    return adapters.staged_search(lambda span: adapters.article_search(get, query, span, most, sleep=_no_wait), enough=4)


@query("select 'k' || page_id as keyword, k::int as ord, 'http://k' || page_id || '.example/' || k as url from pages, (values (0), (1), (2), (3)) t(k) where page_id < 40")
def article_search(spark, sf_dir):
    k = table(spark, sf_dir, "pages").where("page_id < 40").select(F.concat(F.lit("k"), "page_id").alias("keyword"))
    return adapters.search(spark, k, indexed)


@query("select page_id, page_id % 2 = 0 as fetchable from pages")
def fetchable_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", adapters.fetchable(F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.lit("ftp://x/"))).alias("fetchable"))


@query("select s.doc_id as slot_id, u.page_id as ord, 'https://a.example/x/' || u.page_id as url from (select doc_id from documents where doc_id < 30) s, (select page_id from pages where page_id < 40) u")
def seed_fanout(spark, sf_dir):
    """Each slot starts from every canonical seed; spellings of one page are one seed."""
    p = table(spark, sf_dir, "pages").where("page_id < 40").select("page_id")
    spelled = p.select(F.col("page_id").alias("ord"), F.concat(F.lit("HTTPS://A.example:443/x/"), "page_id", F.lit("/#top")).alias("url"))
    again = p.select((F.col("page_id") + 100).alias("ord"), F.concat(F.lit("https://a.example//x/"), "page_id", F.lit("?utm_source=q")).alias("url"))
    slots = table(spark, sf_dir, "documents").where("doc_id < 30").select(F.col("doc_id").alias("slot_id"))
    return seed_frontier(slots, spelled.unionByName(again))


@query(
    "with crawled as (" + _crawl_sql(3, 30, 6, 12) + "), "
    + f"""{_GATE}, best as (select slot_id, url, round(relevance_score, 6) as relevance_score, row_number() over (partition by slot_id order by relevance_score desc, ord) as rank from (select c.*, relevance_score from crawled c join gated g on c.url like '%/' || g.doc_id || '.html') x where decision = 'keep')
    select slot_id, rank, url, relevance_score from best where rank <= 3"""
)
def keyword_pipeline(spark, sf_dir):
    """Slots and seeds to the three best pages of each slot: crawl, gate and rank in one."""
    slots = spark.createDataFrame([(1,), (2,)], "slot_id long")
    seeds = spark.createDataFrame([(i, f"https://host{i % 7}.example/a/b/{i}.html") for i in range(12)], "ord int, url string")
    found = crawl(slots, seeds, replay_pages(spark, sf_dir), CrawlConfig(max_depth=3, max_pages=30, max_pages_per_domain=6, gate=GATE))
    top = R.top_per_group(found.where("decision = 'keep'"), ["slot_id"], "relevance_score", "ord", 3)
    return top.select("slot_id", "rank", "url", F.round("relevance_score", 6).alias("relevance_score"))
