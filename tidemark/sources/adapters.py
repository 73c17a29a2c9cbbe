"""Replaceable adapters for what needs a network: fetching, searching and scoring. None is used unless passed in."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable, Iterator, MutableMapping
from typing import Protocol
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.operators.extract import search_page_links

RESULT = "url string, html string, markdown string, title string, status_code int, error string, success boolean, seconds double"


class Fetcher(Protocol):
    """Fetches one URL: a dict with html, markdown, title, status_code; raises on failure.

    html may be an iterator over the body's chunks of bytes, of which no more is drawn than is wanted.
    """

    def __call__(self, url: str) -> dict: ...


class Searcher(Protocol):
    """Candidate URLs of a query, best first."""

    def __call__(self, query: str, most: int) -> list[str]: ...


class RetryLater(Exception):
    """The far side asks to wait; seconds may say how long."""

    def __init__(self, seconds: float | None = None):
        super().__init__(f"retry after {seconds} s")
        self.seconds = seconds


class GiveUp(Exception):
    """No further attempt would help."""


def raise_for(status: int, retry_after: str | None = None) -> None:
    """Nothing for 200; RetryLater for 429 (after what the header says in whole seconds) and 5xx; GiveUp for the rest."""
    if status == 429:
        asked = (retry_after or "").strip()
        raise RetryLater(float(asked) if asked.isdigit() else None)
    if 500 <= status < 600:
        raise RetryLater()
    if status != 200:
        raise GiveUp(f"HTTP {status}")


def retry(call: Callable[[], object], attempts: int = 3, first: float = 1.0, most: float = 10.0, jitter: float = 0.25, sleep: Callable[[float], None] = time.sleep) -> object:
    """call(), again after growing waits while it raises anything but GiveUp; the last failure is raised."""
    wait = first
    for k in range(attempts):
        try:
            return call()
        except GiveUp:
            raise
        except Exception as e:
            if k == attempts - 1:
                raise
            asked = e.seconds if isinstance(e, RetryLater) and e.seconds is not None else wait
            sleep(max(0.0, min(most, asked) * (1 + random.uniform(-jitter, jitter))))
            wait = min(most, wait * 2)


def body_of(html: str | Iterable[bytes] | None, max_bytes: int | None = None) -> str:
    """The text of a body. Chunks are drawn until there are max_bytes; a broken character at the cut is left out."""
    if html is None or isinstance(html, str):
        raw = (html or "").encode()
        return (html or "") if max_bytes is None or len(raw) <= max_bytes else raw[:max_bytes].decode(errors="ignore")
    parts, size = [], 0
    for chunk in html:
        parts.append(chunk)
        size += len(chunk)
        if max_bytes is not None and size >= max_bytes:
            break
    return b"".join(parts)[:max_bytes].decode(errors="ignore")


def fetch(urls: DataFrame, fetcher: Fetcher, parallel: int, attempts: int = 3, max_bytes: int | None = None, least: int = 0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """A row a URL: the page and the seconds it took, or its error as data. At most ``parallel`` tasks run at once.

    A body of fewer than ``least`` characters, as of a page that turns robots away, is fetched again like a failure.
    """

    def page(url: str) -> tuple:
        p = fetcher(url)
        html = body_of(p.get("html"), max_bytes)
        if len(html) < least:
            raise ValueError(f"body of {len(html)} characters")
        return url, html, p.get("markdown") or "", p.get("title") or "", int(p.get("status_code") or 0), None, True

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(),) * 4 + (pa.int32(), pa.string(), pa.bool_(), pa.float64())
        names = [x.split()[0] for x in RESULT.split(", ")]
        for b in batches:
            rows = []
            for url in b.column(0).to_pylist():
                began = time.perf_counter()
                try:
                    if not isinstance(url, str) or not url.startswith(("http://", "https://")):
                        raise GiveUp("not a web address")
                    row = retry(lambda url=url: page(url), attempts, sleep=sleep)
                except Exception as e:
                    row = (url, "", "", "", 0, str(e), False)
                rows.append((*row, time.perf_counter() - began))
            columns = list(zip(*rows)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return urls.select("url").repartition(parallel).mapInArrow(run, RESULT)


def web_search(queries: DataFrame, fetcher: Fetcher, address: str, parallel: int, most: int = 10, attempts: int = 3, least: int = 1000, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """keyword, ord, url: results of a search engine's pages. address holds {} for the encoded keyword."""
    head, tail = address.split("{}")
    asked = queries.select("keyword", F.concat(F.lit(head), F.url_encode("keyword"), F.lit(tail)).alias("url"))
    pages = fetch(asked.select("url").distinct(), fetcher, parallel, attempts, least=least, sleep=sleep)
    return asked.join(pages.where("success"), "url").select("keyword", F.posexplode(search_page_links(F.col("html"), most)).alias("ord", "url"))


def weak_normal(url: str) -> str:
    """The driver's counterpart of functions.urls.without_fragment."""
    plain = url.split("#", 1)[0]
    return plain.removesuffix("/") if len(urlsplit(plain).path) > 1 else plain


def article_search(get: Callable[[dict], tuple[int, dict, dict]], keyword: str, span: str = "3m", most: int = 20, attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """URLs of a news index's articles; get takes the parameters and returns (status, headers, JSON). No result if it gives up."""

    def once() -> list[str]:
        status, headers, body = get({"query": keyword, "mode": "ArtList", "format": "json", "maxrecords": most, "sort": "DateDesc", "timespan": span})
        raise_for(status, headers.get("Retry-After"))
        return [weak_normal(x["url"]) for x in (body or {}).get("articles") or [] if x.get("url")]

    try:
        return retry(once, attempts, 2.0, 30.0, sleep=sleep)
    except Exception:
        return []


def search(spark: SparkSession, queries: DataFrame, searcher: Searcher, template: str = "{}", most: int = 10) -> DataFrame:
    """keyword, ord, url: distinct results of each keyword's query."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i, u) for k in b.column(0).to_pylist() for i, u in enumerate(dict.fromkeys(searcher(template.format(k), most)))]
            columns = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string()))], ["keyword", "ord", "url"])

    return queries.select("keyword").mapInArrow(run, "keyword string, ord int, url string")


def staged_search(search_span: Callable[[str], list[str]], spans: Iterable[str] = tuple("1m 3m 6m".split()), enough: int = 20, cache: MutableMapping[str, list[str]] | None = None) -> list[str]:
    """Results of widening time spans, until there are enough. Spans in the cache aren't asked for again."""
    found: dict[str, None] = {}
    for span in spans:
        urls = cache.get(span) if cache is not None else None
        if urls is None:
            urls = search_span(span)
            if cache is not None:
                cache[span] = urls
        found.update(dict.fromkeys(urls))
        if len(found) >= enough:
            break
    return list(found)


def fetchable(url: Column) -> Column:
    """Whether a URL can be fetched at all."""
    return U.valid(url)


def replay(pages: DataFrame) -> DataFrame:
    """A table of stored pages in the form that fetch returns."""
    return pages.select("url", "html", F.lit("").alias("markdown"), F.lit("").alias("title"), F.lit(200).alias("status_code"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("success"), F.lit(0.0).alias("seconds"))
