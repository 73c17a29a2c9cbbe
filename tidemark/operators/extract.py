"""Content, headings and links of raw pages."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.batches import slices, text_batches
from tidemark.functions import text as T
from tidemark.functions import urls as U

LINKS = "array<struct<href: string, text: string, title: string>>"
_HIDDEN = set("footer header nav script style".split())
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class PageParser(HTMLParser):
    """Title, first h1, anchors, feed links and visible text of a page; survives unclosed tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[dict] = []
        self.feeds: list[dict] = []
        self.words: list[str] = []
        self.title = self.h1 = ""
        self._hidden: list[str] = []
        self._anchor: dict | None = None
        self._heading = self._in_title = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _HIDDEN:
            self._hidden.append(tag)
        elif tag == "a":
            self._close_anchor()
            if a.get("href") is not None:
                self._anchor = {"href": a["href"], "text": "", "title": a.get("title")}
        elif tag == "link" and a.get("href"):
            self.feeds.append({"href": a["href"], "text": (a.get("rel") or "").lower(), "title": (a.get("type") or "").lower()})
        elif tag == "title":
            self._in_title = True
        elif tag == "h1":
            self._heading = not self.h1

    def handle_endtag(self, tag):
        if tag in _HIDDEN and tag in self._hidden:
            while self._hidden.pop() != tag:
                pass
        elif tag == "a":
            self._close_anchor()
        elif tag == "title":
            self._in_title = False
        elif tag == "h1":
            self._heading = False

    def handle_data(self, data):
        if self._in_title:
            self.title += data
        if self._anchor is not None:
            self._anchor["text"] += data
        if self._heading:
            self.h1 += data
        if not self._hidden and data.strip():
            self.words.append(data.strip())

    def _close_anchor(self):
        if self._anchor is not None:
            self._anchor["text"] = self._anchor["text"].strip()
            self.links.append(self._anchor)
            self._anchor = None

    def close(self):
        super().close()
        self._close_anchor()


def with_parsed(pages: DataFrame, html: str = "html", main_text: Callable[[str], str] | None = None) -> DataFrame:
    """pages with html_title, html_h1, html_text, html_links, html_feeds, row by row; no shuffle. main_text replaces the text extractor.

    Pages are parsed in slices of some megabytes, so memory doesn't depend on the size of a batch.
    """
    text_batches(pages.sparkSession)
    at = pages.columns.index(html)
    link = pa.list_(pa.struct([("href", pa.string()), ("text", pa.string()), ("title", pa.string())]))
    kinds = (pa.string(),) * 3 + (link,) * 2
    names = "html_title html_h1 html_text html_links html_feeds".split()

    def parsed(source: str | None) -> tuple:
        p = PageParser()
        p.feed(source or "")
        p.close()
        return p.title.strip(), p.h1.strip(), main_text(source or "") if main_text else " ".join(p.words), p.links, p.feeds

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at, 4 << 20):
            rows = [parsed(x) for x in b.column(at).to_pylist()]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(list(c), t) for c, t in zip(columns, kinds))], [*b.schema.names, *names])

    kinds_of = [F.lit(None).cast(t).alias(n) for n, t in zip(names, ["string"] * 3 + [LINKS] * 2)]
    return pages.mapInArrow(run, pages.select("*", *kinds_of).schema)


def parse_html(pages: DataFrame, key: str, html: str = "html", main_text: Callable[[str], str] | None = None) -> DataFrame:
    """key, html_title, html_h1, html_text, html_links, html_feeds, one row a page."""
    return with_parsed(pages.select(key, html), html, main_text).drop(html)


def hrefs(html: Column) -> Column:
    """href values of <a> tags, by pattern: the native way where texts and titles aren't needed."""
    return F.regexp_extract_all(html, F.lit("(?is)<a\\s[^>]*?\\bhref\\s*=\\s*\"([^\"]*)\""), 1)


def markdown_links(markdown: Column, base: Column | None = None) -> Column:
    """array<struct<url, text, title>> of Markdown links (images too); those without a canonical URL are left out."""
    pattern = "\\[([^\\]]+)\\]\\(([^)]+?)(?:\\s+\"([^\"]+)\")?\\)"
    parts = F.arrays_zip(*(F.regexp_extract_all(markdown, F.lit(pattern), k).alias(n) for k, n in ((2, "u"), (1, "t"), (3, "h"))))
    rows = F.transform(parts, lambda x: F.struct(U.canonical(x.getField("u"), base).alias("url"), x.getField("t").alias("text"), F.nullif(x.getField("h"), F.lit("")).alias("title")))
    return F.filter(rows, lambda x: x["url"].isNotNull())


def html_links(links: Column, base: Column | None = None) -> Column:
    rows = F.transform(links, lambda x: F.struct(U.canonical(x["href"], base).alias("url"), x["text"].alias("text"), F.nullif(x["title"], F.lit("")).alias("title")))
    return F.filter(rows, lambda x: x["url"].isNotNull())


def unique_links(links: Column, allow: Sequence[str] = (), block: Sequence[str] = (), most: int = 50) -> Column:
    """First link of each URL in order, of allowed domains, up to a number."""

    def firsts(x: Column) -> Column:  # equal URLs are neighbours in the sorted array, the earliest in front
        places = F.sort_array(F.transform(x, lambda y, i: F.struct(y["url"].alias("url"), i.alias("i"))))
        starts = lambda s: F.filter(s, lambda y, k: (k == 0) | (F.get(s, k - 1)["url"] != y["url"]))
        return F.transform(F.sort_array(F.transform(T.let(places, starts), lambda y: y["i"])), lambda i: F.get(x, i))

    def distinct(x: Column) -> Column:
        urls = F.filter(F.transform(x, lambda y: y["url"]), lambda u: u.isNotNull())
        return F.when(F.size(F.array_distinct(urls)) == F.size(x), x).otherwise(firsts(F.filter(x, lambda y: y["url"].isNotNull())))

    own = T.let(links, distinct)
    if allow or block:
        ok = lambda d: (d != "") & U.allowed_name(d, allow, block)
        own = F.filter(own, lambda x: T.let(U.domain(x["url"]), ok))
    return F.slice(own, 1, most)


def first_links(pages: DataFrame, key: str, url: str, links: str) -> DataFrame:
    """key, pos, link_url: each page's distinct canonical links with the position of their first occurrence."""
    flat = pages.select(key, F.col(url).alias("_base"), F.posexplode(links).alias("pos", "_href")).select(key, "pos", U.canonical(F.col("_href"), F.col("_base")).alias("link_url"))
    return flat.where("link_url is not null").groupBy(key, "link_url").agg(F.min("pos").alias("pos")).select(key, "pos", "link_url")


def extract(pages: DataFrame, keywords: Sequence[str], allow: Sequence[str] = (), block: Sequence[str] = (), snippet: int = 500, cap: int = 10_000, main_text: Callable[[str], str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The extracted-page row for each raw page (url, html, markdown, clean_content, title), behind the columns to keep.

    clean_content wins if there is any; else the Markdown's main text; else the visible text of the HTML. Each row is
    extracted by itself, so rows of one URL with different contents keep their own.
    """
    p = with_parsed(pages.select(*keep, "url", "html", "markdown", "clean_content", "title", F.md5("url").alias("data_id")), "html", main_text)
    some = lambda c: c.isNotNull() & (c != "")
    body = F.when(some(F.col("clean_content")), F.col("clean_content")).when(some(F.col("markdown")), T.markdown_main_content(F.col("markdown"), cap)).otherwise(F.substring("html_text", 1, cap))
    none = F.array().cast("array<struct<url: string, text: string, title: string>>")
    links = F.concat(F.coalesce(markdown_links(F.col("markdown"), F.col("url")), none), F.coalesce(html_links(F.col("html_links"), F.col("url")), none))
    p = p.withColumn("main_content", body).withColumn("extracted_links", unique_links(links, allow, block))
    return p.select(
        *keep,
        "data_id",
        "url",
        "title",
        "main_content",
        T.headings(F.when(some(F.col("markdown")), F.col("markdown")).otherwise(F.col("html"))).alias("headings"),
        T.keyword_hits(F.col("main_content"), keywords).alias("keyword_hits"),
        T.content_hash(F.col("main_content")).alias("content_hash"),
        T.snippet(F.col("main_content"), snippet).alias("text_snippet"),
        "extracted_links",
        F.size("extracted_links").alias("extracted_links_count"),
        U.domain(F.col("url")).alias("domain"),
    )


def external_links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, pos, url: links of an encyclopedia page to other sites, in order, first occurrence only.

    Links of the section headed "External links" (or its Chinese name); if there are none, those of the references
    marked class=external; if there are none, all that are so marked.
    """
    section = "(?is)<h[2-3][^>]*>(?:(?!</h[2-3]>).)*(?:External links|外部链接|外部連結)(?:(?!</h[2-3]>).)*</h[2-3]>((?:(?!<h[2-3][ >]).)*)"
    references = "(?is)(<ol\\s[^>]*class=\"[^\"]*\\breferences\\b.*?</ol>|<(?:span|sup|li|div)\\s[^>]*class=\"[^\"]*\\breference\\b[^\"]*\".*?</(?:span|sup|li|div)>)"
    href = "(?is)<a\\s[^>]*?href=\"([^\"]*)\""

    def marked(body: Column) -> Column:
        tags = F.filter(F.regexp_extract_all(body, F.lit("(?is)(<a\\s[^>]*>)"), 1), lambda t: t.rlike("(?i)class=\"[^\"]*\\bexternal\\b"))
        return F.filter(F.transform(tags, lambda t: F.regexp_extract(t, href, 1)), lambda u: u != "")

    inside = F.regexp_extract_all(F.regexp_extract(html, section, 1), F.lit(href), 1)
    cited = marked(F.array_join(F.regexp_extract_all(F.col(html), F.lit(references), 1), " "))
    links = F.when(F.size(inside) > 0, inside).when(F.size(cited) > 0, cited).otherwise(marked(F.col(html)))
    own = F.transform(F.filter(F.transform(links, lambda u: F.trim(u)), U.external_candidate), U.without_fragment)
    return pages.select(key, F.posexplode(F.array_distinct(own)).alias("pos", "url"))


def search_page_links(html: Column, most: int = 10) -> Column:
    """Result URLs of a search engine's page: links of class result__a, else links that hold "http"; redirects unwrapped."""
    tags = F.regexp_extract_all(html, F.lit("(?is)(<a\\s[^>]*>)"), 1)
    marked = F.filter(tags, lambda t: t.rlike("(?i)class\\s*=\\s*[\"'][^\"']*\\bresult__a\\b"))
    href = lambda t: F.replace(F.regexp_extract(t, "(?i)href\\s*=\\s*[\"']([^\"']*)", 1), F.lit("&amp;"), F.lit("&"))
    linked = lambda some: F.filter(F.transform(some, href), lambda u: u != "")
    any_link = F.filter(linked(tags), lambda u: F.contains(u, F.lit("http")))
    first = F.slice(F.when(F.size(linked(marked)) > 0, linked(marked)).otherwise(any_link), 1, most)
    urls = F.transform(F.filter(first, lambda u: F.contains(u, F.lit("/l/?uddg=")) | F.startswith(u, F.lit("http"))), U.unwrap_redirect)
    return F.array_distinct(urls)


def extractable(html: Column, markdown: Column) -> Column:
    """Whether there is anything to extract."""
    return (F.coalesce(html, F.lit("")) != "") | (F.coalesce(markdown, F.lit("")) != "")


def discovered_entrances(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """key, pos, entrance: feeds announced by a page, then anchors that look like entrances; first occurrences."""
    from tidemark.functions.classify import entrance_like

    p = with_parsed(pages.select(key, F.col(url).alias("_base"), html), html)
    near = lambda links: F.transform(links, lambda x: F.struct(U.join(F.col("_base"), x["href"]).alias("u"), x["text"].alias("rel"), x["title"].alias("kind")))
    feeds = F.filter(near(F.col("html_feeds")), lambda x: F.contains(x["rel"], F.lit("alternate")) & (x["kind"].rlike("rss|atom") | U.probable_feed(x["u"])))
    doors = F.filter(near(F.col("html_links")), lambda x: entrance_like(x["u"]))
    urls = F.transform(F.concat(feeds, doors), lambda x: U.without_fragment(x["u"]))
    return p.select(key, F.posexplode(F.array_distinct(urls)).alias("pos", "entrance"))


def first_per_domain(urls: DataFrame, group: str, url: str, ord_: str, most: int = 6) -> DataFrame:
    """The first URL of each domain in order, then the first ``most`` of each group."""
    d = urls.withColumn("_d", U.domain(F.col(url)))
    one = d.withColumn("_n", F.row_number().over(W.partitionBy(group, "_d").orderBy(ord_))).where("_n = 1")
    return one.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(ord_))).where(F.col("_n") <= most).drop("_n", "_d")
