"""Cold-start recall: candidate URLs of keywords, merged, ranked, classified and trimmed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import classify as C
from tidemark.functions import text as T
from tidemark.operators import rank as R
from tidemark.tables import written

#: What lies between words where \\b is Unicode-aware.
WORD_EDGE = "(?U)\\W+"
TRIMS = {"event_seed": 60, "anchor_seed": 40, "evidence": 20}


def rss_matches(items: DataFrame, keywords: DataFrame, translations: Mapping[str, Sequence[str]]) -> DataFrame:
    """keyword, url, ord of the feed items (title, summary, url, ord) that hold the keyword or a translation of it.

    Items are joined to keywords by their words: the first word of a keyword has to be among an item's, which is an
    equi-join; phrases and Chinese keywords, which have no bounds, are tested on what the join leaves.
    """
    cut = lambda text: F.filter(F.split(F.lower(text), WORD_EDGE), lambda w: w != "")
    words = keywords.select("keyword", F.explode(T.rss_keywords(F.col("keyword"), dict(translations))).alias("_w")).where("_w != ''")
    words = words.withColumn("_cjk", F.col("_w").rlike("[\\u4e00-\\u9fff]")).withColumn("_first", F.get(cut(F.col("_w")), F.lit(0)))
    body = F.concat_ws(" ", "title", "summary").alias("_body")
    texts = items.select("url", "ord", body).where("_body != ''")
    word = F.concat(F.lit("(?U)\\b"), F.regexp_replace(F.lower("_w"), "([^\\p{L}\\p{N}])", "\\\\$1"), F.lit("\\b"))
    by_word = texts.withColumn("_first", F.explode(F.array_distinct(cut(F.col("_body"))))).join(words.where("not _cjk and _first is not null"), "_first")
    spaced = by_word.where((F.lower("_w") == F.col("_first")) | F.regexp_like(F.lower("_body"), word)).select("keyword", "url", "ord")
    loose = words.where("_cjk or _first is null")
    rest = texts.join(loose, F.when(F.col("_cjk"), F.contains(F.col("_body"), F.col("_w"))).otherwise(F.regexp_like(F.lower("_body"), word))).select("keyword", "url", "ord")
    return spaced.unionByName(rest).groupBy("keyword", "url").agg(F.min("ord").alias("ord"))


def promote(candidates: DataFrame, by: Sequence[str] = ("keyword",), parents: int = 2) -> DataFrame:
    """by, url, ord: entrances derived from the candidates (url, ord), in order, first occurrence."""
    rows = candidates.select(*by, F.col("ord").alias("_o"), F.posexplode(C.promoted_entrances(F.col("url"), parents)).alias("_p", "url"))
    first = rows.groupBy(*by, "url").agg(F.min(F.struct("_o", "_p")).alias("_at"))
    return first.select(*by, "url", (F.col("_at._o") * 1000 + F.col("_at._p")).alias("ord"))


def rank_candidates(merged: DataFrame, sources: DataFrame, by: Sequence[str] = ("keyword",)) -> DataFrame:
    """merged (by, url, src_rank, ord) with score and sources."""
    return merged.withColumn("score", C.recall_rank(F.col("url"))).join(R.sources_of(sources, [*by, "url"]), [*by, "url"], "left")


def classify_streams(candidates: DataFrame, by: Sequence[str] = ("keyword",), trims: Mapping[str, int] = TRIMS) -> DataFrame:
    """by, kind, url, score, domain, root_domain, reasons, rank, stream_count.

    Candidates (url, ord) are classified; feeds among the event seeds give further entrances, classified and tagged
    unless known already; each stream is counted, then trimmed to its best.
    """
    # written, so that the classifier's large expression is evaluated once a URL and not pushed into every use
    classified = written(candidates.select(*by, "ord", C.classify(F.col("url")).alias("c")), "classified").select(*by, "ord", "c.*")
    first = R.first_wins(classified, [*by, "url"], ["ord"])
    own = first.where(C.kept(F.col("kind"), F.col("score")))
    feeds = own.where("kind = 'event_seed'").where(C.feed(F.col("url")))
    derived = feeds.select(*by, F.col("ord").alias("_o"), F.posexplode(C.entrances_of_feed(F.col("url"))).alias("_p", "_u")).groupBy(*by, "_u").agg(F.min(F.struct("_o", "_p")).alias("_at"))
    derived = derived.select(*by, (F.lit(1 << 40) + F.col("_at._o") * 1000 + F.col("_at._p")).alias("ord"), F.col("_u"))
    derived = written(derived.select(*by, "ord", C.classify(F.col("_u")).alias("c")), "derived").select(*by, "ord", "c.*")
    derived = derived.withColumn("reasons", F.concat("reasons", F.array(F.lit("derived_from_feed")))).where(C.kept(F.col("kind"), F.col("score")))
    derived = R.first_wins(derived, [*by, "url"], ["ord"]).join(first.select(*by, "url"), [*by, "url"], "left_anti")
    both = own.unionByName(derived.select(own.columns))
    counts = both.groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("stream_count"))
    return R.trim(both, by, "kind", "score", "ord", trims).join(counts, [*by, "kind"]).drop("ord")


def search_results(response: DataFrame, key: str, body: str) -> DataFrame:
    """key, pos, url, kind, source, title: the URLs of an instant-answer reply (JSON): primary, official, related, result."""
    item = "array<struct<FirstURL: string, Text: string>>"
    r = F.from_json(body, f"AbstractURL string, Abstract string, AbstractSource string, Heading string, RelatedTopics {item}, Results {item}")
    row = lambda u, k, s, t: F.struct(u.alias("url"), F.lit(k).alias("kind"), s.alias("source"), t.alias("title"))
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    empty = F.array().cast("array<struct<url: string, kind: string, source: string, title: string>>")

    def listed(name: str, kind: str):
        items = F.filter(F.coalesce(F.col(f"r.{name}"), F.array().cast(item)), lambda x: some(x["FirstURL"]))
        return F.transform(items, lambda x: row(x["FirstURL"], kind, F.lit(name), F.substring(F.coalesce(x["Text"], F.lit("")), 1, 100)))

    url = F.col("r.AbstractURL")
    primary = F.when(some(url), F.array(row(url, "primary", F.lit("AbstractURL"), F.substring(F.coalesce("r.Abstract", F.lit("")), 1, 100)))).otherwise(empty)
    official = F.when(some(url) & some(F.col("r.AbstractSource")), F.array(row(url, "official", F.col("r.AbstractSource"), F.coalesce("r.Heading", F.lit(""))))).otherwise(empty)
    return response.select(key, r.alias("r")).select(key, F.posexplode(F.concat(primary, official, listed("RelatedTopics", "related"), listed("Results", "result"))).alias("pos", "x")).select(key, "pos", "x.*")


def encyclopedia_results(response: DataFrame, key: str, body: str, lang: str) -> DataFrame:
    """key, pos, url, title, snippet, wordcount, timestamp of an encyclopedia's search reply (JSON)."""
    from tidemark.functions.urls import wiki_page

    r = F.from_json(body, "query struct<search: array<struct<title: string, snippet: string, wordcount: int, timestamp: string>>>")
    return response.select(key, lang, F.posexplode(r["query"]["search"]).alias("pos", "x")).select(key, "pos", wiki_page(F.col("x.title"), F.col(lang)).alias("url"), "x.*")
