"""Registered queries: recall, the classifier's whole ladder, entrances, link extraction from several kinds of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import classify as C
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import extract as X
from tidemark.operators import rank as R
from tidemark.operators import recall
from tidemark.plans.page_queries import _DOMAIN, _PARTS, _WEAK
from tidemark.plans.registry import KEYWORD, query, table

#: URLs of every outcome of the classifier; {n} is a page's number.
SHAPES = """https://web.archive.org/web/{n}/http://a.b/|https://books.google.com/books?id={n}|https://x.archive.org/{n}|https://arxiv.org/abs/{n}|https://site{n}.example/lifestyle/a|https://www.reddit.com/r/{n}
https://forum.site{n}.example/a|https://site{n}.example/thread/9|https://site{n}.example/2024/1/{n}/story|https://site{n}.example/news/big-story|https://site{n}.example/news/tags/x|https://site{n}.example/news/page/2
https://site{n}.example/a-very-long-name-of-a-page-that-goes-on-and-on-for-ever/and-another-long-name-of-a-page-for-ever/{n}/end|https://site{n}.example/feed|https://site{n}.example/feedback
https://site{n}.example/a/rss.xml|https://mit.edu/atom|https://site{n}.example/feed/index.html|https://site{n}.example/docs/guide.html|https://site{n}.example/a/b/c/d/e{n}|https://en.wikipedia.org/wiki/X{n}
https://id.loc.gov/x{n}|https://vocab.getty.edu/page/{n}|https://getty.edu/{n}|https://site{n}.example/tag/x|https://site{n}.example/category/y|https://stanford.edu/archive/z|https://site{n}.example/list?page={n}
https://cam.ac.uk/list/page/{n}|https://site{n}.example/x?p=1&offset=2|https://site{n}.example/news|https://site{n}.example/blog/|https://site{n}.example/press/a/b|https://harvard.edu/updates|https://dept.harvard.edu/bulletin/{n}
https://site{n}.example/tutorial/x|https://site{n}.example/introduction|https://site{n}.example/courses/|https://site{n}.example/getting_started|https://site{n}.example/api/changelog/|https://nasa.gov/docs/security/x
https://site{n}.example/x?utm_source=a&utm_medium=b|https://site{n}.example/x?a=1&b=2&c=3&d=4&e=5&gclid=6|https://site{n}.example/x?a=&utm_source=|https://nature.com/tag/x?utm_source=a&utm_id=b|https://site{n}.example/works/2013/x
https://site{n}.example/full-text|https://site{n}.example/tags/security/|https://site{n}.example/archives/advisory/|ftp://site{n}.example/x|https:///x{n}|mailto:x{n}|https://site{n}.example|https://SITE{n}.Example/About/#frag
https://site{n}.example/release-notes|https://gov.example.gov/{n}|https://school.edu.cn/wiki/{n}|https://site{n}.example/paper.pdf|https://site{n}.example/News/|https://site{n}.example/tag/x/page/3""".replace("\n", "|").split("|")

_names = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_LADDER = rf"""raw as (select id, regexp_replace(u, '#.*$', '') as b from shaped),
    url as (select id, case when b like '%/' and length(regexp_extract(b, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)) > 1 then regexp_replace(b, '/$', '') else b end as u from raw),
    cut as (select *, lower(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) as s, lower(regexp_extract(u, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)) as d,
        lower(regexp_replace(regexp_extract(u, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')) as p,
        list_distinct(list_transform(list_filter(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '^[^=]*=.')), lambda x: regexp_extract(x, '^[^=]*'))) as k from url),
    seen as (select *, array_to_string(list_slice(string_split(d, '.'), -2, -1), '.') as root, len(list_filter(string_split(p, '/'), lambda x: x <> '')) as segments,
        len(list_filter(k, lambda x: regexp_matches(lower(x), '^(utm_|gclid|fbclid|mc_cid|mc_eid)'))) as tracked, regexp_matches(p, '/(tags?|topics?|category|categories|archives?)/') as taxonomy,
        contains(p, '/page/') or len(list_filter(k, lambda x: lower(x) in ('page', 'p', 'offset'))) > 0 as paged from cut),
    judged as (select *, not starts_with(s, 'http') or d = '' or u = '' as invalid,
        d in {_names(C.LIBRARIES + C.PAPERS)} or root in {_names(C.LIBRARIES + C.PAPERS)} or regexp_matches(lower(u), '{C.GOSSIP}') as blocked,
        regexp_matches(d, 'stackoverflow\.com|stackexchange\.com|reddit\.com|quora\.com|zhihu\.com|tieba\.baidu\.com|discuss|forum|bbs') or regexp_matches(lower(u), '/forum|/discuss|/thread') as forum,
        (len(k) >= 6 and tracked >= 1) or tracked >= 2 as track, d in {_names(C.TRUSTED)} or root in {_names(C.TRUSTED)} or regexp_matches(d, '\.(edu|ac\.uk|ac\.cn|edu\.cn|gov|gov\.cn)$') as trust,
        d in {_names(C.KNOWLEDGE_HOSTS)} or root in {_names(C.KNOWLEDGE_ROOTS)} as kb,
        case when regexp_matches(lower(u), '/20\d\d/\d\d?/\d\d?/') then true when contains(p, '/news/') then not (taxonomy or paged) else length(p) > 90 and length(regexp_replace(p, '[^/]', '', 'g')) >= 3 end as detail,
        regexp_matches(p, '\.(html|htm|pdf|doc|docx|ppt|pptx)$') or regexp_matches(p, '/works?/20?\d\d/') or regexp_matches(p, '/full-?text') or segments >= 5 as content,
        regexp_matches(lower(u), 'rss|atom|feed|\.xml') and not contains(lower(u), 'feedback') as feed,
        regexp_matches(p, '/(docs|documentation|doc|manual|handbook|guide|tutorial|reference|api|spec|standards|courses?|syllabus|lectures?|teaching|learn|learning|kb|wiki)/|/(introduction|overview|getting[-_]started)') as anchor,
        regexp_matches(regexp_replace(p, '/+$', ''), '^/(news|press|pressroom|press-releases|releases|updates|announcements|notices|bulletin|blog)(/|$)') and segments <= 2 as room,
        regexp_matches(p, '/docs|/documentation|/manual|/handbook|/reference') as docs, regexp_matches(p, '/courses?|/syllabus|/lectures') as course, regexp_matches(p, '/changelog|/release-notes|/security|/advisory') as security from seen),
    rung as (select *, case when invalid then 'invalid' when blocked then 'blocked' when forum then 'forum' when detail then 'detail' when feed then 'feed' when content or kb then 'content' when taxonomy then 'taxonomy' when paged then 'paged'
        when room then 'room' when anchor then 'anchor' else 'none' end as r, case when track then -8 else 0 end + case when trust then 8 else 0 end + case when kb then 1 else 0 end as base,
        list_concat(case when track then ['many_tracking_params'] else [] end, list_concat(case when trust then ['trusted_domain'] else [] end, case when kb then ['knowledge_base'] else [] end)) as why from judged),
    verdict as (select id, u as url, d as domain, case when root = '' then d else root end as root_domain,
        case when r in ('invalid', 'blocked', 'forum', 'none') then 'discard' when r = 'detail' then 'evidence' when r in ('content', 'anchor') then 'anchor_seed' else 'event_seed' end as kind,
        case r when 'invalid' then -999 when 'blocked' then -999 when 'forum' then -50 when 'detail' then base + 2 when 'feed' then base + 30 + case when content then 3 else 0 end
            when 'content' then base + case when content then 3 else 0 end + case when anchor then 6 else 4 end + case when docs then 3 else 0 end + case when course then 2 else 0 end
            when 'anchor' then base + 10 + case when docs then 3 else 0 end + case when course then 2 else 0 end when 'none' then base - 2
            else base + case r when 'taxonomy' then 16 when 'paged' then 12 else 10 end + case when trust then case r when 'taxonomy' then 3 else 2 end else 0 end + case when security then 4 else 0 end end as score,
        array_to_string(case r when 'invalid' then ['invalid_url'] when 'blocked' then ['blocked_domain_or_token'] when 'forum' then ['forum_like'] when 'detail' then list_concat(why, ['detail_article'])
            when 'feed' then list_concat(list_concat(why, case when content then ['content_page'] else [] end), ['feed_url'])
            when 'content' then list_concat(list_concat(list_concat(why, case when content then ['content_page'] else [] end), [case when anchor then 'anchor_like' else 'anchor_from_content_or_kb' end]), list_concat(case when docs then ['docs_hint'] else [] end, case when course then ['course_hint'] else [] end))
            when 'anchor' then list_concat(list_concat(why, ['anchor_like']), list_concat(case when docs then ['docs_hint'] else [] end, case when course then ['course_hint'] else [] end)) when 'none' then list_concat(why, ['unclear_type'])
            else list_concat(list_concat(why, [case r when 'taxonomy' then 'taxonomy_listing' when 'paged' then 'pagination_listing' else 'newsroom_entrance' end]), case when security then ['update_security_hint'] else [] end) end, ',') as reasons from rung)"""
_SHAPED = "shaped as (select page_id * 1000 + k as id, replace(shape, '{n}', page_id::varchar) as u from (select page_id from pages where page_id < 25) p, (values " + ", ".join(f"({k}, '{s}')" for k, s in enumerate(SHAPES)) + ") t(k, shape))"


def _shaped(spark, sf_dir):
    shapes = spark.createDataFrame(list(enumerate(SHAPES)), "k int, shape string")
    p = table(spark, sf_dir, "pages").where("page_id < 25").select("page_id").crossJoin(F.broadcast(shapes))
    return p.select((F.col("page_id") * 1000 + F.col("k")).alias("id"), F.replace("shape", F.lit("{n}"), F.col("page_id").cast("string")).alias("u"))


@query(f"with {_SHAPED}, {_LADDER} select id, url, domain, root_domain, kind, score::int as score, reasons from verdict")
def classify_ladder(spark, sf_dir):
    """URLs of every outcome of the classifier."""
    return _shaped(spark, sf_dir).select("id", C.classify(F.col("u")).alias("c")).select("id", "c.*").withColumn("reasons", F.array_join("reasons", ","))


@query(f"with {_SHAPED}, {_LADDER} select r as rung, count(*) as urls, count_if(trust) as trusted, count_if(track) as tracked, count_if(kb) as known from rung group by r")
def classify_rungs(spark, sf_dir):
    """How many URLs end at each rung, by the reasons given."""
    c = _shaped(spark, sf_dir).withColumn("c", C.classify(F.col("u"))).withColumn("u", U.without_fragment(F.col("u")))
    has = lambda x: F.array_contains("c.reasons", x)
    rung = F.lit(None)
    names = {"invalid_url": "invalid", "blocked_domain_or_token": "blocked", "forum_like": "forum", "detail_article": "detail", "feed_url": "feed", "anchor_from_content_or_kb": "content", "taxonomy_listing": "taxonomy", "pagination_listing": "paged", "newsroom_entrance": "room", "unclear_type": "none"}
    for reason, name in names.items():
        rung = F.when(has(reason), name).otherwise(rung)
    rung = F.coalesce(rung, F.when(has("content_page") | has("knowledge_base"), "content").otherwise("anchor"))
    n = lambda test: F.count_if(test)
    u = F.col("u")
    return c.groupBy(rung.alias("rung")).agg(F.count(F.lit(1)).alias("urls"), n(C.trusted(C.host(u))).alias("trusted"), n(C.many_tracking_keys(u)).alias("tracked"), n(C.knowledge_base(C.host(u))).alias("known"))


_KINDS = "'category', 'categories', 'tag', 'tags', 'topic', 'topics'"


@query(
    f"""with u as (select page_id, 'https://s' || page_id % 9 || '.example' as site, 'x' || page_id % 5 as slug, page_id % 4 as k from pages),
    all_of as (select page_id, unnest(list_concat([site || '/'], case k when 0 then list_transform([{_KINDS}], lambda x: site || '/' || x || '/' || slug) when 1 then list_transform([{_KINDS}, 'blog', 'news'], lambda x: site || '/' || x || '/' || slug) else [] end)) as entrance from u)
    select page_id, entrance from all_of"""
)
def derived_entrances(spark, sf_dir):
    """Entrances of feeds by topic, plain feeds and feeds at other places."""
    p = table(spark, sf_dir, "pages")
    site, slug = F.concat(F.lit("https://s"), F.col("page_id") % 9, F.lit(".example")), F.concat(F.lit("x"), F.col("page_id") % 5)
    k = F.col("page_id") % 4
    feed = F.when(k == 0, F.concat(site, F.lit("/Feeds/tags/"), slug, F.lit(".xml"))).when(k == 1, F.concat(site, F.lit("/a/feeds/"), slug, F.lit(".rss"))).when(k == 2, F.concat(site, F.lit("/rss.xml"))).otherwise(F.concat(site, F.lit("/newsfeeds/"), slug))
    return p.select("page_id", F.explode(C.entrances_of_feed(feed)).alias("entrance"))


@query(
    r"""with i as (select doc_id, 'http://i/' || doc_id as url, trim(coalesce(substr(text, 1, 60), '') || case when doc_id % 7 = 0 then ' 算法' else '' end || case when doc_id % 11 = 0 then ' New machine-learning news' else '' end) as body from documents)
    select 'the' as keyword, url, doc_id as ord from i where regexp_matches(lower(body), '\bthe\b') union all select '算法', url, doc_id from i where regexp_matches(lower(body), '\balgorithms?\b|\bof the\b')
    union all select '好算法', url, doc_id from i where false union all select '算', url, doc_id from i where contains(body, '算') union all select 'machine-learning', url, doc_id from i where contains(body, 'machine-learning')"""
)
def rss_matches(spark, sf_dir):
    """Feed items that hold a keyword or a translation of it."""
    d = table(spark, sf_dir, "documents")
    extra = F.concat(F.when(F.col("doc_id") % 7 == 0, " 算法").otherwise(""), F.when(F.col("doc_id") % 11 == 0, " New machine-learning news").otherwise(""))
    items = d.select(F.lit("").alias("title"), F.concat(F.coalesce(F.substring("text", 1, 60), F.lit("")), extra).alias("summary"), F.concat(F.lit("http://i/"), "doc_id").alias("url"), F.col("doc_id").alias("ord"))
    keywords = spark.createDataFrame([("the",), ("算法",), ("好算法",), ("算",), ("machine-learning",)], "keyword string")
    return recall.rss_matches(items, keywords, {"算法": ["algorithm", "algorithms", "of the"]})


@query("select page_id, case page_id % 3 when 0 then 'a,b' when 1 then 'k1' else 'k2' end as words from pages")
def keyword_translations(spark, sf_dir):
    """A keyword's translations, or itself."""
    k = F.concat(F.lit("k"), F.col("page_id") % 3)
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.rss_keywords(k, {"k0": ["a", "b"]}), ",").alias("words"))


@query("select page_id, pos, url, kind, source, title from (select page_id, unnest([{'pos': 0, 'url': url, 'kind': 'primary', 'source': 'AbstractURL', 'title': 'abs'}, {'pos': 1, 'url': url, 'kind': 'official', 'source': 'S', 'title': 'head'}, {'pos': 2, 'url': 'http://rel/' || page_id, 'kind': 'related', 'source': 'RelatedTopics', 'title': 'rel'}, {'pos': 3, 'url': 'http://res/', 'kind': 'result', 'source': 'Results', 'title': ''}], recursive := true) from pages)")
def instant_answer_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    item = lambda u, t: F.struct(u.alias("FirstURL"), t.alias("Text"))
    none = F.lit(None).cast("string")
    body = F.to_json(F.struct(F.col("url").alias("AbstractURL"), F.lit("abs").alias("Abstract"), F.lit("S").alias("AbstractSource"), F.lit("head").alias("Heading"), F.array(item(F.concat(F.lit("http://rel/"), "page_id"), F.lit("rel")), item(none, F.lit("group"))).alias("RelatedTopics"), F.array(item(F.lit("http://res/"), none)).alias("Results")))
    return recall.search_results(p.select("page_id", body.alias("body")), "page_id", "body")


@query("select page_id, pos::int as pos, 'https://' || case when page_id % 2 = 0 then 'en' else 'zh' end || '.wikipedia.org/wiki/Page_' || page_id || '_' || pos as url, 'Page ' || page_id || ' ' || pos as title, 's' as snippet, (page_id + pos)::int as wordcount, 't' as timestamp from pages, (values (0), (1)) t(pos)")
def encyclopedia_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    hit = lambda k: F.struct(F.concat(F.lit("Page "), "page_id", F.lit(f" {k}")).alias("title"), F.lit("s").alias("snippet"), (F.col("page_id") + k).cast("int").alias("wordcount"), F.lit("t").alias("timestamp"))
    body = F.to_json(F.struct(F.struct(F.array(hit(0), hit(1)).alias("search")).alias("query")))
    lang = F.when(F.col("page_id") % 2 == 0, "en").otherwise("zh")
    return recall.encyclopedia_results(p.select("page_id", body.alias("body"), lang.alias("lang")), "page_id", "body", "lang")


_CITED = "<ol class=\"references\"><li><a class=\"external text\" href=\"http://ref.example/{n}\">r</a></li></ol><a class=\"external\" href=\"http://any.example/{n}#x\">a</a><a href=\"http://plain.example/\">p</a>"
_SECTION = "<h2><span class=\"mw-headline\">External links</span></h2><ul><li><a href=\"http://out.example/{n}/\">1</a><a href=\"https://en.wikipedia.org/w\">w</a><a href=\"http://out.example/f.pdf\">p</a><a href=\"http://out.example/{n}#z\">2</a></li></ul><h2>More</h2>"


@query("select page_id, 0 as pos, case page_id % 3 when 0 then 'http://out.example/' when 1 then 'http://ref.example/' else 'http://any.example/' end || page_id as url from pages")
def external_links(spark, sf_dir):
    """Links of the section, else of the references, else marked ones."""
    n = F.col("page_id").cast("string")
    at = lambda s: F.replace(F.lit(s), F.lit("{n}"), n)
    html = F.when(F.col("page_id") % 3 == 0, F.concat(at(_SECTION), at(_CITED))).when(F.col("page_id") % 3 == 1, at(_CITED)).otherwise(at(_CITED[_CITED.index("</ol>") + 5 :]))
    return X.external_links(table(spark, sf_dir, "pages").select("page_id", html.alias("html")), "page_id")


@query(f"with {_PARTS} select page_id, pos::int as pos, s || '://' || host || case pos when 0 then '/feed' when 1 then '/atom.xml' else '/news' end as entrance from parts, (values (0), (1), (2)) t(pos)")
def page_entrances(spark, sf_dir):
    """Feeds that a page announces, then anchors that look like entrances."""
    html = '<link rel="alternate" type="application/rss+xml" href="/feed"><link rel="alternate" href="/atom.xml"><link rel="stylesheet" href="/feed.css"><a href="/news/">n</a><a href="/news/login">l</a><a href="/about">x</a>'
    return X.discovered_entrances(table(spark, sf_dir, "pages").select("page_id", "url", F.lit(html).alias("html")), "page_id")


@query("select page_id, case when page_id % 2 = 0 then 'http://t.example/a b|http://direct.example/' || page_id else 'https://other.example/' || page_id end as links from pages")
def search_page_links(spark, sf_dir):
    """Results of a search page: marked links first, redirects unwrapped, else any link."""
    n = F.col("page_id").cast("string")
    marked = F.concat(F.lit('<a class="result__a" href="//d.example/l/?uddg=http%3A%2F%2Ft.example%2Fa%20b&amp;rut=1">1</a><a href="http://no.example/">n</a><a class=\'x result__a\' href="http://direct.example/'), n, F.lit('">2</a><a class="result__a" href="/local">3</a>'))
    plain = F.concat(F.lit('<a href="/local">l</a><a href="https://other.example/'), n, F.lit('">o</a>'))
    html = F.when(F.col("page_id") % 2 == 0, marked).otherwise(plain)
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(X.search_page_links(html), "|").alias("links"))


@query(f"with {_PARTS} select page_id, s || '://' || lower(host) || '/x/' || page_id || '|' || 'https://i.example/p' || '|' || s || '://' || lower(host) || '/h' as links, 'a,i,l' as texts, 3 as n from parts")
def combined_links(spark, sf_dir):
    """Markdown links (images too), then HTML links; first occurrences."""
    p = table(spark, sf_dir, "pages")
    md = F.concat(F.lit("[a](/x/"), "page_id", F.lit(' "t") ![i](https://i.example/p) [m](mailto:q) [b](/x/'), "page_id", F.lit("?utm_source=z)"))
    rows = p.select("page_id", "url", F.lit('<a href="/h" title="q">l</a><a href="https://i.example/p#top">again</a><a href="javascript:x">j</a>').alias("html"), md.alias("markdown"), F.lit("body").alias("clean_content"), F.lit("").alias("title"))
    e = X.extract(rows, [KEYWORD], keep=["page_id"])
    get = lambda f: F.array_join(F.transform("extracted_links", lambda x: x[f]), "|" if f == "url" else ",")
    return e.select("page_id", get("url").alias("links"), get("text").alias("texts"), F.col("extracted_links_count").alias("n"))


@query("with l as (select page_id, k, 'http://h' || k % 3 || '.example/' || k as u from pages, generate_series(0, 119) t(k)) select page_id, 50 as kept, 80 as allowed, 80 as unblocked from l group by page_id")
def link_caps(spark, sf_dir):
    """The cap of 50, allowed and blocked domains."""
    urls = F.transform(F.sequence(F.lit(0), F.lit(119)), lambda k: F.struct(F.concat(F.lit("http://h"), k % 3, F.lit(".example/"), k).alias("url")))
    n = lambda **kw: F.size(X.unique_links(urls, **kw))
    return table(spark, sf_dir, "pages").select("page_id", n().alias("kept"), n(allow=["h0", "h1"], most=500).alias("allowed"), n(block=["H2"], most=500).alias("unblocked"))


@query("select page_id % 10 as keyword, case when page_id % 2 = 0 then 'even' else 'odd' end as source, count(distinct url) as candidates from pages group by all union all select page_id % 10, 'third', count(distinct url) from pages where page_id % 3 = 0 group by all")
def source_counts(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("keyword", F.col("page_id") % 10)
    rows = p.select("keyword", "url", F.when(F.col("page_id") % 2 == 0, "even").otherwise("odd").alias("source")).unionByName(p.where("page_id % 3 = 0").select("keyword", "url", F.lit("third").alias("source")))
    return R.counts_by_source(rows)


@query(f"with {_PARTS}, d as (select page_id, page_id % 4 as keyword, {_DOMAIN} as domain from parts), f as (select keyword, domain, min(page_id) as page_id from d group by all) select keyword, page_id from f qualify row_number() over (partition by keyword order by page_id) <= 6")
def first_per_domain(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select((F.col("page_id") % 4).alias("keyword"), "url", "page_id")
    return X.first_per_domain(p, "keyword", "url", "page_id").select("keyword", "page_id")


@query(
    rf"""with {_PARTS}, weak as (select page_id, page_id % 4 as keyword, {_WEAK} as url from parts), merged as (select keyword, url, min(page_id) as ord from weak group by all)
    select keyword, url, ord, array_to_string(list_sort(list_distinct(list(case when page_id % 2 = 0 then 'rss' else 'web' end))), ',') as sources from merged join weak using (keyword, url) group by all"""
)
def ranked_candidates(spark, sf_dir):
    """Merged candidates with score and sources."""
    p = table(spark, sf_dir, "pages").select((F.col("page_id") % 4).alias("keyword"), U.without_fragment(F.col("url")).alias("url"), F.col("page_id").alias("ord"))
    merged = R.union_in_order([p], by=["keyword"])
    labelled = p.withColumn("source", F.when(F.col("ord") % 2 == 0, "rss").otherwise("web"))
    return recall.rank_candidates(merged, labelled).where("score >= 0").select("keyword", "url", "ord", F.array_join("sources", ",").alias("sources"))


@query(
    rf"""with {_PARTS}, seg as (select page_id, page_id % 4 as keyword, s || '://' || host as site, string_split(trim(path, '/'), '/') as g from parts),
    flat as (select page_id, keyword, unnest(list_concat([site || '/'], case when len(g) > 1 then [site || '/' || array_to_string(list_slice(g, 1, len(g) - 1), '/')] else [] end, case when len(g) > 2 then [site || '/' || array_to_string(list_slice(g, 1, len(g) - 2), '/')] else [] end)) as url from seg)
    select keyword, url, min(page_id) as first_page from flat group by all"""
)
def promoted_by_keyword(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select((F.col("page_id") % 4).alias("keyword"), "url", F.col("page_id").alias("ord"))
    return recall.promote(p).select("keyword", "url", F.floor(F.col("ord") / 1000).alias("first_page"))


@query(f"with {_PARTS} select page_id, case page_id % 3 when 0 then 'https://e.example/a b' when 1 then url else '/l/?uddg=' end as target, {_DOMAIN} <> '' as crawlable from parts")
def unwrapped_redirects(spark, sf_dir):
    k = F.col("page_id") % 3
    href = F.when(k == 0, "//d.example/l/?uddg=https%3A%2F%2Fe.example%2Fa%20b&rut=9").when(k == 1, F.col("url")).otherwise("/l/?uddg=")
    return table(spark, sf_dir, "pages").select("page_id", U.unwrap_redirect(href).alias("target"), U.crawlable(F.col("url"), same_as=U.domain(F.col("url"))).alias("crawlable"))
