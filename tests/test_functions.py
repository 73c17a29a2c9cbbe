import random
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import classify as C
from tidemark.functions import text as T
from tidemark.functions import urls as U


def one(spark, column):
    return spark.range(1).select(column).first()[0]


CANONICAL = [
    ("https://site.test/page.html?utm_source=feed&page=1", None, "https://site.test/page.html?page=1"),
    ("HTTPS://WWW.Example.COM:443//a///b/index.html?b=2&a=1&spm=x#f", None, "https://www.example.com/a/b?a=1&b=2"),
    ("http://x.com:80", None, "http://x.com/"),
    ("http://x.com/index.htm", None, "http://x.com/"),
    ("example.com/x", None, None),
    ("//x.com/a", None, "https://x.com/a"),
    ("../c?q=a b&z=", "https://x.com/a/b/d.html", "https://x.com/a/c?q=a+b"),
    ("ftp://x.com/a/", None, "ftp://x.com/a"),
    ("https://x.com/a;p=1?q=~*é", None, "https://x.com/a?q=~%2A%C3%A9"),
    ("https://x.com/?q=%zz&q=%E4%B8%AD", None, "https://x.com/?q=%25zz&q=%E4%B8%AD"),
    ("https://x.com/a?REF=1&k=+", None, "https://x.com/a?k=+"),
    ("http://x.com/a b", None, "http://x.com/a b"),
    ("https://u:p@x.com/a", None, "https://u:p@x.com/a"),
    ("#top", "https://x.com/a", None),
    ("mailto:a@b", None, None),
    ("", None, None),
    (None, None, None),
]


def test_canonical(spark):
    df = spark.createDataFrame(CANONICAL, "u string, b string, w string")
    for r in df.select("u", "w", U.canonical(F.col("u"), F.col("b")).alias("g")).collect():
        assert r.g == r.w, r.u


def test_join_agrees_with_urllib(spark):
    bases = ["http://a/b/c/d;p?q", "http://a", "http://a/", "http://a/b", "http://a/b/c/"]
    refs = "g ./g g/ /g ?y g?y #s g#s .. ../ ../g ../.. ../../g ../../../g ./ . /./g /../g g. ..g ./../g ./g/. g/./h g/../h http:g //h/x mailto:q http://z/../y g//h /".split() + [""]
    rows = [(b, r, urljoin(b, r).split("#")[0]) for b in bases for r in refs]
    for r in spark.createDataFrame(rows, "b string, r string, w string").select("*", U.join(F.col("b"), F.col("r")).alias("g")).collect():
        assert (r.g or "").split("#")[0] == r.w, (r.b, r.r)


def plain_canonical(url):
    p = urlsplit(url)
    pairs = sorted((k, v) for k, v in parse_qsl(p.query) if k.lower() not in U.TRACKING)
    path = p.path or "/"
    while "//" in path:
        path = path.replace("//", "/")
    path = path.removesuffix("/") or "/"
    return f"{p.scheme}://{p.netloc}{path}" + (f"?{urlencode(pairs)}" if pairs else "")


def test_canonical_differential(spark):
    rng = random.Random(3)
    urls = []
    for _ in range(400):
        path = "".join(rng.choice(["/", "a", "b", "-", ".x", "é", "%41"]) for _ in range(rng.randint(0, 8)))
        query = "&".join(rng.choice(["a=1", "b=", "c", "utm_source=q", "d=%20x", "e=~*", "a=%zz", "k=ü", "=v"]) for _ in range(rng.randint(0, 4)))
        urls.append("https://h.example/" + path + ("?" + query if query else ""))
    for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.canonical(F.col("u")).alias("g")).collect():
        assert r.g == plain_canonical(r.u), r.u


@pytest.mark.parametrize(
    "text, keywords, want",
    [("DP dp dps _dp 中dp中 dp.", ["dp"], 3), ("马克思主义马克思主义", ["马克思"], 2), ("C++ c++", ["c++"], 0), ("x", [], 0), ("a \\E a", ["a"], 2), ("ab", [""], 0)],
)
def test_keyword_hits(spark, text, keywords, want):
    assert one(spark, T.keyword_hits(F.lit(text), keywords)) == want


def test_hash_snippet_headings(spark):
    assert one(spark, T.content_hash(F.lit(" a　b\n c "))) == one(spark, T.content_hash(F.lit("a b c"))) == "06f0760ec7f18687a7fbc0ddbf1b1722"
    assert one(spark, T.content_hash(F.lit("   "))) == "d41d8cd98f00b204e9800998ecf8427e"
    assert one(spark, T.content_hash(F.lit(""))) == ""
    assert one(spark, T.content_hash(F.lit(None).cast("string"))) == ""
    assert one(spark, T.headings(F.lit("# A\n## B  \n###C\n####### D\n#\nE\n text # F"))) == ["A", "B", "E"]
    assert one(spark, T.headings(F.lit("\n".join(f"# {i}" for i in range(20))))) == [str(i) for i in range(10)]
    assert one(spark, T.markdown_main_content(F.lit("a\n```\ncode\n```\n> q\n<!-- c -->\nb"))) == "a\nb"
    assert one(spark, T.snippet(F.lit("para one words here.\n\npara two words.\n\npara three final words."), 20)) == "para one words..."
    assert one(spark, T.snippet(F.lit("x" * 30), 20)) == "x" * 20 + "..."
    assert one(spark, T.truncate(F.lit("aa bb cc"), 5)) == "aa..."
    assert one(spark, T.safe_filename(F.lit(" A b/c "))) == "a_b_c"


def test_rule_score(spark):
    assert one(spark, T.rule_score(F.lit("k"), ["k"])) == 0.56
    assert one(spark, T.rule_score(F.lit("k " + "a" * 3000), ["k"], F.array(F.lit("k h"), F.lit("o")))) == 0.85
    assert one(spark, T.rule_score(F.lit("a" * 600), ["k"])) == 0.25
    assert one(spark, T.rule_score(F.lit(""), ["k"])) == 0.0
    assert len(T.score_table(3)) == 4 * 4 * 66


def test_json_object(spark):
    schema = "keep_page boolean, relevance_score double"
    assert one(spark, T.json_object(F.lit('Sure: {"keep_page": true, "relevance_score": 0.5} ok'), schema)).keep_page is True
    assert one(spark, T.json_object(F.lit("nothing"), schema)) is None or one(spark, T.json_object(F.lit("nothing"), schema)).keep_page is None


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="ab \n\t　x.", max_size=60))
def test_snippet_property(text):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        pytest.skip("no session")
    c = " ".join(text.split())
    want = c if len(c) <= 20 else (c[:20].rsplit(" ", 1)[0] + "...").strip()
    assert one(spark, T.snippet(F.lit(text), 20)) == want


CLASSES = [
    ("not a url", "discard", -999, ["invalid_url"]),
    ("https://arxiv.org/abs/1", "discard", -999, ["blocked_domain_or_token"]),
    ("https://x.com/fashion/a", "discard", -999, ["blocked_domain_or_token"]),
    ("https://bbs.x.com/a", "discard", -50, ["forum_like"]),
    ("https://x.com/2024/1/2/a", "evidence", 2, ["detail_article"]),
    ("https://x.com/rss", "event_seed", 30, ["feed_url"]),
    ("https://x.com/tag/a", "event_seed", 16, ["taxonomy_listing"]),
    ("https://mit.edu/tag/a", "event_seed", 27, ["trusted_domain", "taxonomy_listing"]),
    ("https://x.com/list?page=2", "event_seed", 12, ["pagination_listing"]),
    ("https://x.com/blog", "event_seed", 10, ["newsroom_entrance"]),
    ("https://x.com/docs/a", "anchor_seed", 13, ["anchor_like", "docs_hint"]),
    ("https://x.com/course/a", "anchor_seed", 12, ["anchor_like", "course_hint"]),
    ("https://x.com/a.html", "anchor_seed", 7, ["content_page", "anchor_from_content_or_kb"]),
    ("https://en.wikipedia.org/a", "anchor_seed", 5, ["knowledge_base", "anchor_from_content_or_kb"]),
    ("https://x.com/updates/security", "event_seed", 14, ["newsroom_entrance", "update_security_hint"]),
    ("https://x.com/a?utm_a=1&utm_b=2", "discard", -10, ["many_tracking_params", "unclear_type"]),
    ("https://x.com/", "discard", -2, ["unclear_type"]),
]


def test_classify(spark):
    df = spark.createDataFrame([(u, k, s, r) for u, k, s, r in CLASSES], "u string, k string, s int, r array<string>").select("*", C.classify(F.col("u")).alias("c"))
    for r in df.collect():
        assert (r.c.kind, r.c.score, r.c.reasons) == (r.k, r.s, r.r), r.u


def test_entrances(spark):
    assert one(spark, C.entrances_of_feed(F.lit("https://e.com/blog/feed"))) == ["https://e.com/"]
    kinds = ["blog", "categories", "category", "news", "tag", "tags", "topic", "topics"]
    assert one(spark, C.entrances_of_feed(F.lit("https://e.com/feeds/news.xml"))) == ["https://e.com/", *(f"https://e.com/{k}/news" for k in kinds)]
    assert one(spark, C.promoted_entrances(F.lit("https://e.com/News/a/b/c.html"))) == ["https://e.com/", "https://e.com/News/a/b", "https://e.com/News/a", "https://e.com/news"]


def test_native_plans(spark):
    df = spark.range(1).select(U.canonical(F.lit("http://a.b/c")), C.classify(F.lit("http://a.b/c")), T.rule_score(F.lit("x"), ["x"]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_file_name_of_long_texts(spark):
    """The name is that of the whole text, wherever runs of blanks and marks lie, and takes no time for the rest of it."""
    import time

    texts = ["", " \n ", "Ab c" * 50, "x" + " " * 5000 + "y" * 200, "!" * 3000 + "Z", " " * 2000 + "q r" * 90, "ab" * 60, "ab" * 60 + "!", "é" * 700 + "ü-1." * 99, "a!" * 481, "Σ" * 1500 + "k", "İx" * 800]
    whole = F.regexp_replace(F.regexp_replace(F.lower(T.strip(F.col("t"))), f"{T.SPACE}+", "_"), "[^0-9a-zA-Z_\\u4e00-\\u9fff\\-.]+", "_")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.safe_filename(F.col("t")).alias("name"), F.substring(whole, 1, 120).alias("want")).collect()
    assert [r.name for r in rows] == [r.want for r in rows]
    long = spark.range(0, 100, 1, 1).select(F.repeat(F.concat(F.lit("Some words, and "), "id"), 20_000).alias("t"))
    took = []
    for name in (T.safe_filename(F.col("t")), F.substring(whole, 1, 120), T.safe_filename(F.col("t"))):
        began = time.perf_counter()
        assert long.select(F.max(name)).first()[0]
        took.append(time.perf_counter() - began)
    assert took[2] < took[1] / 2
