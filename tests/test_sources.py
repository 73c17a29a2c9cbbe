import json

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.gate import GateConfig
from tidemark.sources import adapters, readers, sinks
from tidemark.streaming import driver


def test_slides_to_report(spark, tmp_path):
    slide = lambda n, chosen, words: dict(title=f"t{n}", slide_number=n, reason="r", should_optimize=chosen, optimization_strategy="", suggested_keywords=words)
    deck = dict(input_file="f", teaching_chain="", total_pages=2, should_optimize_count=1, decisions=[slide(1, True, ["x", "y"]), slide(2, False, [])])
    (tmp_path / "s.json").write_text(json.dumps(deck, indent=1))
    slides = readers.slides(spark, str(tmp_path / "s.json"))
    slots = readers.slots(slides)
    assert [(r.slot_id, r.keyword) for r in slots.orderBy("slot_id").collect()] == [(readers.SLOTS, "x"), (readers.SLOTS + 1, "y")]
    rows = slots.select("slide_number", "keyword", F.lit(1).alias("rank"), F.lit("u").alias("url"), F.lit("t").alias("title"), F.lit("s").alias("text_snippet"), F.lit(0.5).alias("relevance_score"), F.lit("why").alias("reasons"))
    report = sinks.nested_report(sinks.report_rows(rows), slides, "2024-01-01T00:00:00")
    sinks.write_report(report, str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part*") for x in p.read_text().splitlines()]
    first = next(x for x in lines if x["slide_number"] == 1)
    assert first["keywords_information"]["x"] == [{"url": "u", "title": "t", "summary": "s", "relevance_score": 0.5, "reason": "why"}]


def test_seeds(spark, tmp_path):
    entry = lambda status, urls: {"name": "", "urls": urls, "status": status, "last_updated": "", "maintainer": "", "description": ""}
    (tmp_path / "c.json").write_text(json.dumps({"preset_urls": {"a": entry("approved", ["u1", "u2"]), "b": entry("rejected", ["u3"])}, "meta": {}}))
    assert [r.url for r in readers.seeds(spark, str(tmp_path / "c.json"), "a").orderBy("ord").collect()] == ["u1", "u2"]
    assert readers.seeds(spark, str(tmp_path / "c.json"), "b").count() == 0


def test_store_and_cache(spark, tmp_path):
    p = spark.createDataFrame([("u", "old", 1), ("u", "new", 2), ("v", "x", 1)], "url string, html string, ord int")
    sinks.store_pages(p, str(tmp_path / "p"), "ord")
    stored = spark.read.parquet(str(tmp_path / "p"))
    assert {(r.url, r.html) for r in stored.collect()} == {("u", "new"), ("v", "x")}
    tasks = spark.createDataFrame([("u",), ("gone",)], "task string").select("task", F.md5("task").alias("data_id"))
    got = {r.task: (r.success, r.error) for r in readers.cached(tasks, stored).collect()}
    assert got == {"u": (True, None), "gone": (False, "no cached page")}
    records = stored.select("url", F.lit(0.5).alias("relevance_score"))
    sinks.write_records(records, str(tmp_path / "r"))
    sinks.write_records(records.withColumn("relevance_score", F.lit(None).cast("double")), str(tmp_path / "r"), append=True)
    assert readers.scored_pages(spark, str(tmp_path / "r")).count() == 2


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title><![CDATA[A]]></title><link>http://a</link><description>d</description></item><item><title>B</title><link>http://b</link></item></channel></rss>")
    (tmp_path / "broken.xml").write_text("<rss>")
    assert [(r.title, r.url) for r in readers.feed_items(spark, str(tmp_path)).orderBy("ord").collect()] == [("A", "http://a"), ("B", "http://b")]


def test_adapters(spark):
    def fetcher(url):
        if "bad" in url:
            raise OSError("no")
        return {"html": "x" * 100, "status_code": 200}

    urls = spark.createDataFrame([("http://ok",), ("http://bad",)], "url string")
    got = {r.url: r for r in adapters.fetch(urls, fetcher, 2, max_bytes=10, sleep=lambda s: None).collect()}
    assert len(got["http://ok"].html) == 10 and got["http://bad"].error == "no" and not got["http://bad"].success
    found = adapters.search(spark, spark.createDataFrame([("k",)], "keyword string"), lambda q, n: [q + "1", q + "1", q + "2"], "{} course")
    assert [r.url for r in found.orderBy("ord").collect()] == ["k course1", "k course2"]
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise adapters.RetryLater(7) if len(calls) == 1 else OSError()
        return "done"

    assert adapters.retry(flaky, 3, jitter=0, sleep=waits.append) == "done" and waits == [7, 2.0]
    assert adapters.staged_search(lambda span: [span + str(i) for i in range(2)], enough=3) == ["1m0", "1m1", "3m0", "3m1"]


def test_far_sides():
    drawn = []

    def chunks():
        for k in range(100):
            drawn.append(k)
            yield "é".encode() * 5

    assert adapters.body_of(chunks(), 25) == "é" * 12 and len(drawn) == 3  # no more is drawn than is wanted
    assert adapters.body_of("ééé", 3) == "é" and adapters.body_of(None) == ""
    for status, header, error in ((429, "12", 12.0), (429, "soon", None), (503, None, None)):
        try:
            adapters.raise_for(status, header)
        except adapters.RetryLater as e:
            assert e.seconds == error
    adapters.raise_for(200)
    calls, waits = [], []

    def get(params):
        calls.append(params["timespan"])
        return [(500, {}, None), (429, {"Retry-After": "90"}, None), (200, {}, {"articles": [{"url": "http://a/b/#c"}, {}]})][len(calls) - 1]

    assert adapters.article_search(get, "k", "1m", sleep=waits.append) == ["http://a/b"]
    assert 1.5 <= waits[0] <= 2.5 and 22.5 <= waits[1] <= 37.5
    calls.clear()
    assert adapters.article_search(lambda p: (calls.append(p), (404, {}, None))[1], "k", sleep=waits.append) == [] and len(calls) == 1
    cache = {"1m": ["a"]}
    assert adapters.staged_search(lambda span: [span], enough=2, cache=cache) == ["a", "3m"] and cache == {"1m": ["a"], "3m": ["3m"]}


def test_observed(spark):
    from tidemark.operators.rank import observed

    rows, o = observed(spark.range(10), F.col("id") < 7, F.lit(0.5))
    assert rows.count() == 10
    assert o.get == {"processed": 10, "success": 7, "failed": 3, "total_time": 5.0}


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"the text {i % 5} " * 30) for i in range(20)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    driver.run_available(driver.gated_stream(stream, ["the"], GateConfig(keywords=("the",))), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == docs.select(T.content_hash(F.col("text"))).distinct().count() == 5
    assert {r.method for r in got.collect()} == {"keyword_fast_pass"}
    links = spark.createDataFrame([("http://a.b/x/y/z.html#1",), ("http://a.b/x/y/z.html",), ("http://a.b/",)], "url string")
    links.write.parquet(str(tmp_path / "links"))
    s = spark.readStream.schema(links.schema).parquet(str(tmp_path / "links"))
    driver.run_available(driver.url_stream(s), str(tmp_path / "lo"), str(tmp_path / "lc"))
    assert [r.url for r in spark.read.parquet(str(tmp_path / "lo")).collect()] == ["http://a.b/x/y/z.html"]


def test_written_tables(spark):
    from tidemark import tables

    t = tables.written(spark.range(5).withColumn("x", F.col("id") * 2), "probe")
    assert t.columns == ["id", "x"] and t.count() == 5
    path = tables._paths[-1]
    assert path.startswith(tables.shared_folder(spark))
    other = tables.written(spark.range(3), "other")
    tables.dropped(other, None, spark.range(1))
    assert path in tables._paths and other._written_to not in tables._paths
    n, size = tables.size(spark)
    assert n >= 1 and size > 0
    assert tables.clear(spark) == n and tables.size(spark) == (0, 0)
    import os

    assert not os.path.exists(path.removeprefix("file://").removeprefix("file:"))
