import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import extract as X
from tidemark.operators import gate as G
from tidemark.operators import rank as R
from tidemark.operators import recall
from tidemark.operators.frontier import CrawlConfig, crawl

LONG = "x " * 200


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "url string, main_content string, keyword_hits int").withColumn("headings", F.array().cast("array<string>"))


def test_gate_tiers(spark):
    rows = [("a", "short", 5), ("b", LONG, 7), ("c", LONG, 1), ("d", LONG, 0), ("e", "x " * 50, 0)]
    got = {r.url: r for r in G.gate(pages_of(spark, rows), G.GateConfig(keywords=("k",))).collect()}
    assert [got[k].method for k in "abcde"] == ["fast_discard", "keyword_fast_pass", "llm_fallback", "llm_zero_hits_fallback", "rule_based"]
    assert got["b"].relevance_score == 0.92 and got["b"].priority == "high" and got["b"].expand
    off = {r.url: r.method for r in G.gate(pages_of(spark, rows), G.GateConfig(keywords=("k",), scorer_enabled=False)).collect()}
    assert off["c"] == off["d"] == "rule_based"


def test_gate_scorer_sees_its_slice_only(spark):
    def scorer(prompts):
        reply = {"keep_page": False, "expand_links": True, "relevance_score": 0.2, "reasons": f"n={len(prompts)}"}
        return ["so: " + json.dumps(reply) if "URL: c" in p else "broken {" if "URL: f" in p else None for p in prompts]

    rows = [("a", "short", 5), ("b", LONG, 7), ("c", LONG, 1), ("f", LONG, 2), ("d", LONG, 0)]
    got = {r.url: r for r in G.gate(pages_of(spark, rows).coalesce(1), G.GateConfig(keywords=("k",)), scorer).collect()}
    assert (got["c"].decision, got["c"].expand, got["c"].priority, got["c"].method, got["c"].reasons) == ("discard", True, "medium", "llm", "n=3")
    assert got["f"].method == "llm_fallback" and got["d"].method == "llm_zero_hits_fallback" and got["b"].method == "keyword_fast_pass"


def test_gate_asks_each_page_once_and_keeps_failures(spark, tmp_path):
    log = str(tmp_path / "asked")

    def scorer(prompts):
        with open(log, "a") as f:
            f.writelines(re.search("URL: (.)", p)[1] + "\n" for p in prompts)
        if any("URL: f" in p for p in prompts):
            raise OSError("no line")
        return [json.dumps({"keep_page": True, "relevance_score": 0.7})] * len(prompts)

    rows = [("a", "short", 5), ("b", LONG, 7), ("c", LONG, 1), ("f", LONG, 2), ("d", LONG, 0)]
    gated = G.gate(pages_of(spark, rows).coalesce(1), G.GateConfig(keywords=("k",)), scorer)
    got = {r.url: r for r in gated.collect()}
    assert gated.count() == 5
    assert (got["f"].decision, got["f"].method, got["f"].reasons, got["f"].expand) == ("discard", "error", "Evaluation error: no line", False)
    assert got["c"].method == "llm" and got["d"].method == "llm_zero_hits"
    assert Counter(open(log).read().split()) == {"c": 2, "f": 2, "d": 2}  # the batch, and one by one as it failed
    short = {r.url: r.reasons for r in G.gate(pages_of(spark, rows).coalesce(1), G.GateConfig(keywords=("k",)), lambda prompts: []).collect()}
    assert short["c"] == "Evaluation error: 0 replies to 3 questions"
    with pytest.raises(ValueError, match="headings"):
        G.gate(pages_of(spark, rows).drop("headings"), G.GateConfig())


def test_override(spark):
    g = G.gate(pages_of(spark, [("a", "short", 0), ("b", LONG, 9)]), G.GateConfig())
    c = spark.createDataFrame([("a", True, "keep", True, "high", "said so"), ("b", False, "discard", False, "low", "")], "url string, should_override boolean, decision string, expand boolean, priority string, reasons string")
    got = {r.url: (r.decision, r.method) for r in G.override(g, c, "url").collect()}
    assert got == {"a": ("keep", "coordinated"), "b": ("keep", "keyword_fast_pass")}


def test_markdown_links(spark):
    md = '[a](/x "t") ![i](/i.png) [b](http://y.com/z) [c](mailto:q) [a2](/x)'
    row = spark.createDataFrame([(md, "http://x.com/")], "m string, b string").select(X.unique_links(X.markdown_links(F.col("m"), F.col("b"))).alias("l")).first().l
    assert [tuple(x) for x in row] == [("http://x.com/x", "a", "t"), ("http://x.com/i.png", "i", None), ("http://y.com/z", "b", None)]


def test_link_cap_and_block(spark):
    md = " ".join(f"[t](http://h{i % 2}.com/{i})" for i in range(120))
    df = spark.createDataFrame([(md,)], "m string")
    assert df.select(F.size(X.unique_links(X.markdown_links(F.col("m"))))).first()[0] == 50
    assert df.select(F.size(X.unique_links(X.markdown_links(F.col("m")), block=["h1"], most=500))).first()[0] == 60


def test_html(spark):
    html = '<html><title>T</title><nav>menu <a href="/n">n</a></nav><h1>H</h1><p>one <b>two<script>var a="</p>"</script><a href=\'/x\' title=q>l</a><footer>f</footer><!-- c --></html>'
    row = X.parse_html(spark.createDataFrame([(1, html), (2, None)], "id int, html string"), "id").orderBy("id").collect()
    assert (row[0].html_title, row[0].html_h1, row[0].html_text) == ("T", "H", "T H one two l")
    assert [x.href for x in row[0].html_links] == ["/n", "/x"] and row[1].html_text == ""


def test_extract(spark):
    rows = [("http://a.com/p/", "<h1>x</h1><a href='/q'>q</a>", "# Head\nkey text", "", "t"), ("http://b.com/", "<p>key key</p>", "", "", ""), ("http://c.com/", "", "", "clean key", "")]
    got = {r.url: r for r in X.extract(spark.createDataFrame(rows, "url string, html string, markdown string, clean_content string, title string"), ["key"]).collect()}
    assert got["http://a.com/p/"].headings == ["Head"] and got["http://a.com/p/"].extracted_links[0].url == "http://a.com/q"
    assert got["http://b.com/"].keyword_hits == 2 and got["http://c.com/"].main_content == "clean key"


def test_extract_keeps_each_row_of_a_url(spark):
    rows = [("http://a.com/p", "<p>one", "", "", ""), ("http://a.com/p", "<p>two", "", "", ""), ("http://a.com/p", None, None, None, None)]
    got = X.extract(spark.createDataFrame(rows, "url string, html string, markdown string, clean_content string, title string"), ["two"])
    assert sorted((r.main_content, r.keyword_hits) for r in got.collect()) == [("", 0), ("one", 0), ("two", 1)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_external_links_and_entrances(spark):
    wiki = '<h2>See</h2><a href="http://no.com/">n</a><h2><span>External links</span></h2><ul><a href="http://e.com/a#x">1</a><a href="https://en.wikipedia.org/w">w</a><a href="http://e.com/f.pdf">p</a></ul><h2>Other</h2><a href="http://z.com">z</a>'
    p = spark.createDataFrame([(1, wiki), (2, '<a class="external text" href="http://q.com/">q</a>')], "id int, html string")
    assert {(r.id, r.url) for r in X.external_links(p, "id").collect()} == {(1, "http://e.com/a"), (2, "http://q.com/")}
    h = '<link type="application/rss+xml" rel="alternate" href="/feed"><a href="/news/">n</a><a href="/news/share">s</a><a href="/x">x</a>'
    got = X.discovered_entrances(spark.createDataFrame([(1, "http://a.com/", h)], "id int, url string, html string"), "id").orderBy("pos").collect()
    assert [r.entrance for r in got] == ["http://a.com/feed", "http://a.com/news"]


def test_ranks(spark):
    df = spark.createDataFrame([("k", "u1", 1.0, 2), ("k", "u2", 1.0, 1), ("k", "u3", 3.0, 3), ("j", "u4", 0.0, 1)], "g string, url string, score double, ord int")
    top = R.top_per_group(df, ["g"], "score", "ord", 2)
    assert {(r.g, r.rank, r.url) for r in top.collect()} == {("k", 1, "u3"), ("k", 2, "u2"), ("j", 1, "u4")}
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    one = X.first_per_domain(spark.createDataFrame([("k", "http://a.b/1", 1), ("k", "http://a.b/2", 0), ("k", "http://c.d/", 5)], "g string, url string, ord int"), "g", "url", "ord")
    assert {r.url for r in one.collect()} == {"http://a.b/2", "http://c.d/"}


def test_recall_streams(spark):
    rows = [("k", 0, "https://x.com/feeds/news.xml"), ("k", 1, "https://x.com/tag/a"), ("k", 2, "https://x.com/tag/a#z"), ("k", 3, "https://x.com/docs/a"), ("k", 4, "https://x.com/2024/1/2/a"), ("k", 5, "https://x.com/")]
    got = recall.classify_streams(spark.createDataFrame(rows, "keyword string, ord int, url string")).collect()
    kinds = Counter(r.kind for r in got)
    assert kinds["evidence"] == 2 and kinds["anchor_seed"] == 1  # one derived: /news/news
    feed_derived = {r.url for r in got if "derived_from_feed" in r.reasons}
    assert "https://x.com/topic/news" in feed_derived and "https://x.com/" not in feed_derived
    trimmed = recall.classify_streams(spark.createDataFrame(rows, "keyword string, ord int, url string"), trims={"event_seed": 1}).collect()
    assert [(r.kind, r.url, r.stream_count) for r in trimmed] == [("event_seed", "https://x.com/feeds/news.xml", kinds["event_seed"])]


def test_recall_sources(spark):
    body = json.dumps({"AbstractURL": "http://a", "Abstract": "x", "AbstractSource": "S", "Heading": "H", "RelatedTopics": [{"FirstURL": "http://b", "Text": "t"}, {"Name": "n"}], "Results": [{"FirstURL": "http://c", "Text": "u"}]})
    got = recall.search_results(spark.createDataFrame([(1, body)], "id int, body string"), "id", "body").orderBy("pos").collect()
    assert [(r.url, r.kind) for r in got] == [("http://a", "primary"), ("http://a", "official"), ("http://b", "related"), ("http://c", "result")]
    w = json.dumps({"query": {"search": [{"title": "A b", "snippet": "s", "wordcount": 3, "timestamp": "t"}]}})
    assert recall.encyclopedia_results(spark.createDataFrame([(1, w, "en")], "id int, body string, lang string"), "id", "body", "lang").first().url == "https://en.wikipedia.org/wiki/A_b"
    items = spark.createDataFrame([("New algorithm", "", "http://i/1", 0), ("Logarithms", "", "http://i/2", 1), ("算法好", "", "http://i/3", 2)], "title string, summary string, url string, ord int")
    kws = spark.createDataFrame([("算法",), ("logarithms",)], "keyword string")
    got = {(r.keyword, r.url) for r in recall.rss_matches(items, kws, {"算法": ["algorithm", "algorithms"]}).collect()}
    assert got == {("算法", "http://i/1"), ("logarithms", "http://i/2")}
    promoted = recall.promote(spark.createDataFrame([("k", 0, "http://a.b/x/y"), ("k", 1, "http://a.b/x/z")], "keyword string, ord int, url string"))
    assert [r.url for r in promoted.orderBy("ord").collect()] == ["http://a.b/", "http://a.b/x"]


def model(seeds, pages, depth_max, page_max, domain_max):
    """One worker draining a queue."""
    queue, queued, done, domains, seen, out = [], set(), set(), Counter(), set(), []
    host = lambda u: u.split("/")[2].removeprefix("www.")
    for u in seeds:
        if u not in queued:
            queued.add(u)
            queue.append((u, 0))
    while queue:
        u, d = queue.pop(0)
        if d > depth_max or len(done) >= page_max or domains[host(u)] >= domain_max or u in done:
            continue
        done.add(u)
        domains[host(u)] += 1
        if u not in pages:
            continue
        content, links = pages[u]
        if content in seen:
            continue
        seen.add(content)
        out.append((u, d))
        for v in links:
            if d + 1 <= depth_max and len(done) < page_max and domains[host(v)] < domain_max and v not in queued:
                queued.add(v)
                queue.append((v, d + 1))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_crawl_agrees_with_queue_model(spark, seed):
    rng = random.Random(seed)
    urls = [f"http://{'www.' if rng.random() < 0.2 else ''}h{rng.randint(0, 3)}.com/a/b/{i}.html" for i in range(rng.randint(8, 24))]
    pages = {u: (f"content {rng.randint(0, 18)}", [rng.choice(urls) for _ in range(rng.randint(0, 6))]) for u in urls if rng.random() < 0.9}
    seeds = [rng.choice(urls) for _ in range(3)]
    budget = dict(depth_max=rng.randint(0, 3), page_max=rng.randint(3, 15), domain_max=rng.randint(1, 6))
    link = "array<struct<url: string, text: string, title: string>>"
    table = spark.createDataFrame(
        [(u, True, "", c + " " + LONG, [], 9, c, "", [(v + rng.choice(["", "#x", "?utm_source=q"]), "", None) for v in links]) for u, (c, links) in pages.items()],
        f"url string, success boolean, title string, main_content string, headings array<string>, keyword_hits int, content_hash string, text_snippet string, extracted_links {link}",
    )
    config = CrawlConfig(max_depth=budget["depth_max"], max_pages=budget["page_max"], max_pages_per_domain=budget["domain_max"])
    got = crawl(spark.createDataFrame([(1,), (2,)], "slot_id long"), spark.createDataFrame(list(enumerate(seeds)), "ord int, url string"), table, config)
    want = model(seeds, pages, **budget)
    rows = got.orderBy("depth", "ord").collect()
    for slot in (1, 2):
        assert [(r.url, r.depth) for r in rows if r.slot_id == slot] == want


def test_links_of_a_large_page(spark):
    """First of each URL in order, in a time that grows with the links and not with their square."""
    import time

    link = lambda u, t: F.struct(u.alias("url"), t.alias("text"))
    links = F.transform(F.sequence(F.lit(0), F.lit(5999)), lambda k: link(F.concat(F.lit("http://h"), k % 3, F.lit(".example/"), (k * 7) % 4000), k))
    odd = F.array(link(F.lit(None).cast("string"), F.lit(9)), link(F.lit("http://b.x/"), F.lit(1)), link(F.lit("http://a.x/"), F.lit(2)), link(F.lit("http://b.x/"), F.lit(3)))
    row = spark.range(1).select(X.unique_links(odd).alias("odd"), X.unique_links(F.filter(odd, lambda x: F.lit(False))).alias("none"), X.unique_links(F.lit(None).cast("array<struct<url: string>>")).alias("null")).first()
    assert [x.text for x in row.odd] == [1, 2] and row.none == [] and row.null is None
    began = time.perf_counter()
    got = spark.range(1).select(X.unique_links(links, block=["H2"], most=10_000).alias("l")).first().l
    assert time.perf_counter() - began < 20
    first = {}
    for k in range(6000):
        first.setdefault(f"http://h{k % 3}.example/{k * 7 % 4000}", k)
    assert [x.text for x in got] == [k for u, k in first.items() if "h2" not in u]


def test_pages_are_parsed_in_small_batches(spark):
    import pyarrow as pa

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pages = spark.range(0, 3000, 1, 1).select("id", F.concat(F.lit("<title>t</title><p>"), "id").alias("html"))
    p = X.with_parsed(pages)
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches)
    assert pages.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] <= 1000
    assert p.where("html_title = 't' and html_text = concat('t ', id)").count() == 3000


def test_streamed_rows_keep_their_tasks(spark):
    """A stored stream has a file for each task, so none of them grows with the table; four parts all the same."""
    from tidemark.plans.stream_queries import _streamed

    for parts, batch in ((1, 1), (4, 1), (12, 3)):
        s = _streamed(spark, spark.range(0, 1200, 1, parts), "files")
        path = s._jdf.logicalPlan().dataSource().options().apply("path")
        assert len([f for f in __import__("os").listdir(path.removeprefix("file:")) if f.endswith(".parquet")]) == max(4, parts)
        assert s._jdf.logicalPlan().dataSource().options().apply("maxFilesPerTrigger") == str(batch)
