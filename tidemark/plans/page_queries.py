"""Registered queries: texts, the gate, URLs, extraction and the crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import classify as C
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import extract as X
from tidemark.operators import rank as R
from tidemark.operators import recall
from tidemark.operators.frontier import CrawlConfig, crawl
from tidemark.operators.gate import GateConfig, gate
from tidemark.plans.registry import KEYWORD, query, table

GATE = GateConfig(keywords=(KEYWORD,))

# SQL building blocks
_HITS = r"len(regexp_extract_all(lower(text), '\bthe\b'))"
_COLLAPSED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_HASH = f"case when text is null or text = '' then '' else md5({_COLLAPSED}) end"


def _score_sql(hits: str, size: str) -> str:
    values = ", ".join(repr(v) for v in T.score_table(1, 0))
    return f"[{values}][least({hits}, 1) * 4 + case when {size} > 3000 then 3 when {size} > 1000 then 2 when {size} > 500 then 1 else 0 end + 1]"


_GATE = f"""gated as (select *, case when n < 80 then 'discard' when h >= 3 then 'keep' when rs >= 0.35 then 'keep' else 'discard' end as decision,
    case when n < 80 then 'low' when h >= 3 then 'high' when h > 0 and rs >= 0.35 then 'medium' when h = 0 and not (rs >= 0.15 and n >= 250) and rs >= 0.6 then 'medium' else 'low' end as priority,
    case when n < 80 then 0.0 when h >= 3 then least(0.92::double, 0.35::double + h * 0.10::double) else rs end as relevance_score,
    case when n < 80 then 'fast_discard' when h >= 3 then 'keyword_fast_pass' when h > 0 then 'llm_fallback' when rs >= 0.15 and n >= 250 then 'llm_zero_hits_fallback' else 'rule_based' end as method
    from (select *, case when n = 0 then 0.0 else {_score_sql("h", "n")}::double end as rs from (select *, length(text) as n, {_HITS} as h from documents) x) y)"""
_EXPAND = "decision = 'keep' and (priority in ('high', 'medium') or relevance_score >= 0.45)"

_PARTS = r"""parts as (select page_id, url, html, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) as s, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) as host,
    regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) as q from pages)"""
_CANON = (
    _PARTS
    + r""", canon as (select *, s || '://' || lower(host) || case when path in ('', '/') then '/' else regexp_replace(regexp_replace(path, '/{2,}', '/', 'g'), '/$', '') end
    || case when kept = '' then '' else '?' || kept end as canonical from (select *, array_to_string(list_sort(list_filter(string_split(q, '&'),
    lambda x: regexp_matches(x, '^[^=]*=.') and not regexp_matches(x, '^(utm_source|utm_medium|utm_campaign|utm_term|utm_content|spm|from|ref|source|share|scene|timestamp|nsukey|eqid|vd_source)='))), '&') as kept from parts) x)"""
)
_ARTICLE = r"""case when regexp_matches(lower(path), '\.(webp|jpg|jpeg|png|gif|svg|pdf|doc|docx|mp4|mp3|zip|rar)$') or path in ('', '/') or regexp_matches(lower(path), '/index\.(s?html|htm)$') then false
    when regexp_matches(lower(path), 'node_|list_|channel_|column_|search|login|register') or regexp_matches(q, '(^|&)(utm_[^=&]*|spm|from|ref|source|share|page|p|pagesize)=.') then false
    when regexp_matches(lower(path), '\.(shtml|html|htm)$') or regexp_matches(path, '/20\d\d[-/]\d\d?[-/]\d\d?/|/20\d{6}/') then true
    else length(regexp_replace(trim(path, '/'), '[^/]', '', 'g')) >= 2 end"""
_DOMAIN = r"regexp_replace(lower(host), '^www\.', '')"
_WEAK = r"""case when path not in ('', '/') and regexp_matches(regexp_replace(url, '#.*$', ''), '/$') then regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') else regexp_replace(url, '#.*$', '') end"""
# of the classifier's ladder, what this corpus can reach: no library, trusted or knowledge hosts, no news or docs paths
_KIND = r"""classes as (select page_id, weak as url, host as domain, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') as root_domain, path, q,
    case when feed then 'event_seed' when content then 'anchor_seed' when paged then 'event_seed' else 'discard' end as kind,
    case when feed then 30 + case when content then 3 else 0 end when content then 7 when paged then 12 else -2 end as score,
    case when feed and content then ['content_page', 'feed_url'] when feed then ['feed_url'] when content then ['content_page', 'anchor_from_content_or_kb'] when paged then ['pagination_listing'] else ['unclear_type'] end as reasons
    from (select page_id, lower(host) as host, path, q, weak, regexp_matches(lower(weak), 'rss|atom|feed|\.xml') and not contains(lower(weak), 'feedback') as feed,
    regexp_matches(lower(path), '\.(html|htm|pdf|doc|docx|ppt|pptx)$') as content, regexp_matches(q, '(^|&)(page|p|offset)=.') as paged from (select *, """ + _WEAK + """ as weak from parts) x) y)"""


# text
@query(f"select doc_id, {_HITS} as hits from documents")
def keyword_hits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.keyword_hits(F.col("text"), [KEYWORD]).cast("long").alias("hits"))


@query(f"select doc_id, {_HASH} as content_hash from documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query(f"select doc_id, lang, h as content_hash from (select *, row_number() over (partition by h, lang order by doc_id) as n from (select doc_id, lang, {_HASH} as h from documents) x) y where n = 1 or h = ''")
def evaluation_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", T.content_hash(F.col("text")).alias("content_hash"))
    alone = F.when(F.col("content_hash") == "", F.col("doc_id"))  # texts without a hash are never duplicates
    return d.groupBy("content_hash", "lang", alone.alias("alone")).agg(F.min("doc_id").alias("doc_id")).drop("alone")


@query(rf"select doc_id, case when length(c) <= 500 then c else trim(regexp_replace(substr(c, 1, 500), ' [^ ]*$', '') || '...') end as snippet from (select doc_id, {_COLLAPSED} as c from documents) x")
def text_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("select doc_id, case when length(text) <= 200 then text else regexp_replace(substr(text, 1, 200), ' [^ ]*$', '') || '...' end as head from documents")
def truncated_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate(F.col("text"), 200).alias("head"))


@query(
    rf"""select doc_id, coalesce(n >= 500 and h >= 1 and dense >= 0.1, false) as passed, case when n = 0 then 'Empty text' when n < 500 then 'Text too short (' || n || ' < 500)'
    when h < 1 then 'Insufficient keyword hits (' || h || ' < 1)' when dense < 0.1 then 'Low content density (' || printf('%.2f', dense) || ' < 0.1)' else 'Passed fast filter' end as reason
    from (select doc_id, length(text) as n, {_HITS} as h, length(regexp_replace(text, '\s', '', 'g'))::double / length(text) as dense from documents) x"""
)
def fast_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fast_filter(F.col("text"), [KEYWORD]).alias("f")).select("doc_id", "f.*")


@query(r"""select doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n\s*\n', E'\n\n', 'g'), E' \n\t\r')) as cleaned_hash from documents""")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean(F.col("text"))).alias("cleaned_hash"))


@query(
    r"""select doc_id, substr(trim(array_to_string(list_filter(string_split(text, E'\n'), lambda x: not starts_with(trim(x), '>') and not starts_with(trim(x), '```') and not (contains(x, '<!--') and contains(x, '-->'))), E'\n'), E' \n\t\r'), 1, 10000) as main_content from documents"""
)
def markdown_main_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.markdown_main_content(F.col("text")).alias("main_content"))


@query("with " + _GATE + " select doc_id, rs as rule_score from gated")
def rule_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.rule_score(F.col("text"), [KEYWORD]).alias("rule_score"))


# gate
def _gated(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    pages = d.select("doc_id", *extra, F.col("text").alias("main_content"), F.array().cast("array<string>").alias("headings"), T.keyword_hits(F.col("text"), [KEYWORD]).alias("keyword_hits"))
    return gate(pages, GATE)


@query(
    f"""with {_GATE} select doc_id, decision, {_EXPAND} as expand, priority, round(relevance_score, 6) as relevance_score, method,
    case method when 'fast_discard' then 'too short (' || n || ' chars)' when 'keyword_fast_pass' then 'keyword_hits=' || h || ' (fast pass)'
    when 'llm_fallback' then 'llm_failed fallback rule_score=' || printf('%.2f', rs) when 'llm_zero_hits_fallback' then 'llm@0hits failed fallback rule_score=' || printf('%.2f', rs)
    else 'rule_score=' || printf('%.2f', rs) end as reasons from gated"""
)
def gate_rule_tiers(spark, sf_dir):
    return _gated(spark, sf_dir).select("doc_id", "decision", "expand", "priority", F.round("relevance_score", 6).alias("relevance_score"), "method", "reasons")


@query(f"with {_GATE} select method, decision, {_EXPAND} as expand, count(*) as pages from gated group by all")
def gate_summary(spark, sf_dir):
    return _gated(spark, sf_dir).groupBy("method", "decision", "expand").agg(F.count(F.lit(1)).alias("pages"))


@query(
    f"""with {_GATE}, ranked as (select lang, doc_id, round(relevance_score, 6) as relevance_score, row_number() over (partition by lang order by relevance_score desc, doc_id) as rank
    from (select * from (select *, row_number() over (partition by lang, {_HASH} order by doc_id) as d from gated) z where d = 1) y where decision = 'keep') select lang, rank, doc_id, relevance_score from ranked where rank <= 3"""
)
def top3_per_lang(spark, sf_dir):
    """The flagship: gate, evaluation dedup by content, three best pages of each language."""
    g = _gated(spark, sf_dir, "lang").withColumn("content_hash", T.content_hash(F.col("main_content")))
    g = R.first_wins(g, ["lang", "content_hash"], ["doc_id"]).where("decision = 'keep'")
    return R.top_per_group(g, ["lang"], "relevance_score", "doc_id", 3).select("lang", "rank", "doc_id", F.round("relevance_score", 6).alias("relevance_score"))


@query(f"with {_GATE} select decision, quality, count(*) as pages, sum(h)::bigint as hits, count(distinct lang) as langs from gated join labels using (doc_id) group by all")
def label_join_quality(spark, sf_dir):
    return (
        _gated(spark, sf_dir, "lang").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("decision", "quality")
        .agg(F.count(F.lit(1)).alias("pages"), F.sum("keyword_hits").alias("hits"), F.count_distinct("lang").alias("langs"))
    )


@query(f"with {_GATE} select count(*) as processed, count_if(decision = 'keep') as kept, count_if(decision <> 'keep') as discarded, count_if({_EXPAND}) as expanded, count(distinct source) as unique_domains, count(distinct {_HASH}) as unique_contents, count(*) / 10.0::double as pages_per_second from gated")
def run_statistics(spark, sf_dir):
    g = _gated(spark, sf_dir, "source").withColumn("content_hash", T.content_hash(F.col("main_content"))).withColumn("url", F.concat(F.lit("http://"), F.col("source"), F.lit("/")))
    return R.run_statistics(g, 10.0)


@query(f"select role, count(*) as turns, sum({_HITS})::bigint as hits from conversations group by role")
def conversation_keyword_hits(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("hits", T.keyword_hits(F.col("text"), [KEYWORD]))
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.sum("hits").alias("hits"))


@query(f"select d.doc_id, b.item_id from (select doc_id, {_HASH} as h from documents) d join (select item_id, {_HASH} as h from benchmark) b using (h)")
def benchmark_contamination_hash(spark, sf_dir):
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return d.select("doc_id", T.content_hash(F.col("text")).alias("h")).join(b.select("item_id", T.content_hash(F.col("text")).alias("h")), "h").select("doc_id", "item_id")


# URLs
@query(f"with {_CANON} select page_id, canonical from canon")
def canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.canonical(F.col("url")).alias("canonical"))


@query(f"with {_PARTS} select page_id, {_WEAK} as url from parts")
def weak_normal_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.without_fragment(F.col("url")).alias("url"))


@query(f"with {_PARTS} select {_DOMAIN} as domain, count(*) as pages, count(distinct path) as paths from parts group by 1")
def url_domain_counts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.groupBy(U.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("pages"), F.count_distinct(U.path(F.col("url"))).alias("paths"))


@query(f"with {_PARTS} select page_id, {_ARTICLE} as article from parts")
def enqueue_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.looks_like_article(F.col("url")).alias("article"))


@query(
    rf"""with {_PARTS} select page_id, regexp_matches(url, '^https?://') and host <> '' as valid, regexp_matches(lower(host), '\.(edu|ac\.uk|ac\.cn|edu\.cn|gov|gov\.cn|org)$') as educational,
    not regexp_matches(lower(host), '(wikipedia|wikimedia)\.org$') as external_candidate, not contains({_DOMAIN}, 'casino') as allowed,
    regexp_matches(lower(url), 'rss|atom|feed|\.xml$') and not contains(lower(url), 'feedback') as feed, array_to_string(list_slice(string_split({_DOMAIN}, '.'), -2, -1), '.') as root from parts"""
)
def url_predicates(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        U.valid(u).alias("valid"),
        U.educational(u).alias("educational"),
        U.external_candidate(u).alias("external_candidate"),
        U.crawlable(u, block=["casino"]).alias("allowed"),
        U.probable_feed(u).alias("feed"),
        U.root_domain(U.domain(u)).alias("root"),
    )


@query(f"with {_CANON}, ranked as (select page_id, {_DOMAIN} as domain, row_number() over (partition by {_DOMAIN} order by page_id) as rank from canon) select * from ranked where rank <= 10")
def domain_quota(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", U.domain(F.col("url")).alias("domain"))
    return R.quota(p, [], F.col("domain"), "page_id", 10).select("page_id", "domain", "rank")


@query(f"with {_PARTS}, {_KIND} select page_id, url, domain, root_domain, kind, score, array_to_string(reasons, ',') as reasons from classes")
def url_classify(spark, sf_dir):
    c = table(spark, sf_dir, "pages").select("page_id", C.classify(F.col("url")).alias("c")).select("page_id", "c.*")
    return c.withColumn("reasons", F.array_join("reasons", ","))


@query(
    rf"""with {_PARTS}, seg as (select page_id, s || '://' || host as site, string_split(trim(path, '/'), '/') as g, trim(path, '/') as p from parts),
    flat as (select page_id, unnest(list_concat([site || '/'], case when len(g) > 1 then [site || '/' || array_to_string(list_slice(g, 1, len(g) - 1), '/')] else [] end, case when len(g) > 2 then [site || '/' || array_to_string(list_slice(g, 1, len(g) - 2), '/')] else [] end)) as url from seg)
    select url, min(page_id) as first_page, count(distinct page_id) as pages from flat group by url"""
)
def promote_entrances(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(C.promoted_entrances(F.col("url"))).alias("url"))
    return p.groupBy("url").agg(F.min("page_id").alias("first_page"), F.count_distinct("page_id").alias("pages"))


@query(
    rf"""with {_PARTS} select page_id, url, case when regexp_matches(lower(host), '\.(edu|ac\.uk|ac\.cn|edu\.cn|gov|gov\.cn)$') then 10 else 0 end
    + case when regexp_matches(lower(path), '/(news|press|pressroom|releases?|updates?|announcements?|notices?|bulletin|blog|topics?|tags?|category|categories|archives?)(/|$)') then 5 else 0 end
    + case when regexp_matches(lower(path), '/news|/press|/releases|/updates') then 2 else 0 end + case when regexp_matches(url, '/20\d{{2}}/') then 1 else 0 end as score from parts"""
)
def candidate_rank(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", C.recall_rank(F.col("url")).alias("score"))


def _pages_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]+)/", 1).alias("keyword"), F.col("page_id").alias("ord"), "url")


@query(
    f"""with {_PARTS}, {_KIND}, firsts as (select *, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1) as keyword from classes qualify row_number() over (partition by regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1), url order by page_id) = 1),
    own as (select keyword, kind, url, score, page_id as ord from firsts where (kind = 'event_seed' and score >= 8) or (kind = 'anchor_seed' and score >= 6)),
    ranked as (select *, row_number() over (partition by keyword, kind order by score desc, ord) as rank, count(*) over (partition by keyword, kind) as stream_count from own)
    select keyword, kind, url, score, rank, stream_count from ranked where rank <= case kind when 'event_seed' then 60 else 40 end"""
)
def stream_trim(spark, sf_dir):
    return recall.classify_streams(_pages_by_lang(spark, sf_dir)).select("keyword", "kind", "url", "score", "rank", "stream_count")


@query(
    rf"""with {_PARTS}, weak as (select page_id, {_WEAK} as url from parts), a as (select url, min(page_id) as ord from weak where page_id % 2 = 0 group by url), b as (select url, min(page_id) as ord from weak where page_id % 3 = 0 group by url)
    select url, 0 as src_rank, ord from a union all select url, 1 as src_rank, ord from b where url not in (select url from a)"""
)
def union_in_order(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("ord", F.col("page_id"))
    return R.union_in_order([p.where("page_id % 2 = 0"), p.where("page_id % 3 = 0")])


# extraction
@query(
    rf"""with {_PARTS}, flat as (select page_id, s || '://' || host as site, generate_subscripts(h, 1) - 1 as pos, unnest(h) as href from (select *, regexp_extract_all(html, '(?is)<a\s[^>]*?\bhref\s*=\s*"([^"]*)"', 1) as h from parts) x)
    select page_id, link_url, min(pos) as pos from (select page_id, pos, site || case when length(href) > 1 then regexp_replace(href, '/$', '') else href end as link_url from flat where href like '/%') y group by 1, 2"""
)
def html_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", X.hrefs(F.col("html")).alias("links"))
    return X.first_links(p, "page_id", "url", "links").select("page_id", "link_url", F.col("pos").cast("long").alias("pos"))


@query(r"""select page_id, len(regexp_extract_all(html, '(?is)<a\s[^>]*?\bhref\s*=')) as anchors from pages""")
def html_anchor_count(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return X.parse_html(p, "page_id").select("page_id", F.size("html_links").cast("long").alias("anchors"))


_TAGS_AWAY = "html"
for _tag in ("script", "style", "nav", "footer", "header"):
    _TAGS_AWAY = f"regexp_replace({_TAGS_AWAY}, '(?is)<{_tag}[ >].*?(</{_tag}[^>]*>|$)', '<x>', 'g')"
# text between tags, piece by piece: entities read, trimmed, joined by a blank
_PIECES = f"string_split(regexp_replace(regexp_replace({_TAGS_AWAY}, '(?s)<!--.*?-->', '<x>', 'g'), '(?s)<[a-zA-Z/!][^>]*>', chr(1), 'g'), chr(1))"
for _name, _char in (("copy", "chr(169)"), ("middot", "chr(183)"), ("quot", "chr(34)"), ("lt", "'<'"), ("gt", "'>'"), ("amp", "'&'")):
    _PIECES = f"list_transform({_PIECES}, lambda x: regexp_replace(x, '&{_name}(;|$)', {_char}, 'g'))"
_VISIBLE = rf"substr(array_to_string(list_filter(list_transform({_PIECES}, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' '), 1, 10000)"


@query(
    rf"""with {_PARTS}, shown as (select *, {_VISIBLE} as text from parts), collapsed as (select *, {_COLLAPSED} as c from shown),
    flat as (select page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?\bhref\s*=\s*"([^"]*)"', 1)) as href from parts),
    linked as (select page_id, count(distinct case when length(href) > 1 then regexp_replace(href, '/$', '') else href end) as links from flat where href like '/%' group by page_id)
    select md5(url) as data_id, url, {_HITS}::int as keyword_hits, {_HASH} as content_hash,
    case when length(c) <= 500 then c else trim(regexp_replace(substr(c, 1, 500), ' [^ ]*$', '') || '...') end as text_snippet, least(coalesce(links, 0), 50)::int as extracted_links_count, {_DOMAIN} as domain from collapsed left join linked using (page_id)"""
)
def page_extract(spark, sf_dir):
    """The whole extractor over the pages."""
    p = table(spark, sf_dir, "pages").select("url", "html", F.lit("").alias("markdown"), F.lit("").alias("clean_content"), F.lit("").alias("title"))
    return X.extract(p, [KEYWORD]).select("data_id", "url", "keyword_hits", "content_hash", "text_snippet", "extracted_links_count", "domain")


@query(
    r"""select page_id, trim(regexp_extract(html, '(?s)<title>(.*?)(</title>|$)', 1)) as raw_title, len(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>')) as links,
    array_to_string(list_transform(generate_series(1, len(regexp_extract_all(html, '<li><a href="([^"]*)">'))), lambda i: regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1)[i] || '=' || regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 2)[i]), ' ') as pairs from pages where regexp_matches(html, '^[^&]*</nav>')"""
)
def html_link_texts(spark, sf_dir):
    """Titles and links with their texts, of the pages without entities up to there."""
    p = X.with_parsed(table(spark, sf_dir, "pages").where(F.col("html").rlike("^[^&]*</nav>")).select("page_id", "html"))
    pairs = F.array_join(F.transform("html_links", lambda x: F.concat(x["href"], F.lit("="), x["text"])), " ")
    return p.select("page_id", F.col("html_title").alias("raw_title"), F.size("html_links").cast("long").alias("links"), pairs.alias("pairs"))


# control plane
_SLIDES = [(1, "Cover", False, "", []), (2, "Search trees", True, "examples are missing", ["tree", "balance"]), (3, "Hashing", True, "too short", ["hash"])]
_SEEDS = [(0, "https://a.example/x/y/1.html"), (1, "https://b.example/x/y/2.html#top"), (2, "https://a.example/x/y/1.html?utm_source=q")]


@query(
    """select slot_id, keyword, ord, url from (values (2 * 2147483648, 'tree'), (2 * 2147483648 + 1, 'balance'), (3 * 2147483648, 'hash')) s(slot_id, keyword), (values (0, 'https://a.example/x/y/1.html'), (1, 'https://b.example/x/y/2.html')) u(ord, url)"""
)
def slot_fanout(spark, sf_dir):
    from tidemark.operators.frontier import seed_frontier
    from tidemark.sources.readers import slots

    s = slots(spark.createDataFrame(_SLIDES, "slide_number int, title string, should_optimize boolean, reason string, suggested_keywords array<string>"))
    return seed_frontier(s, spark.createDataFrame(_SEEDS, "ord int, url string")).join(s.select("slot_id", "keyword"), "slot_id").select("slot_id", "keyword", "ord", "url")


def replay_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a site of pages: document i links to 2i + 1 and 2i + 2."""
    url = lambda i: F.concat(F.lit("https://host"), (i % 7).cast("string"), F.lit(".example/a/b/"), i.cast("string"), F.lit(".html"))
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    link = lambda k: F.struct(url(k).alias("url"), F.lit("").alias("text"), F.lit(None).cast("string").alias("title"))
    return d.select(
        url(i).alias("url"),
        F.lit(True).alias("success"),
        F.lit("").alias("title"),
        F.col("text").alias("main_content"),
        F.array().cast("array<string>").alias("headings"),
        T.keyword_hits(F.col("text"), [KEYWORD]).alias("keyword_hits"),
        T.content_hash(F.col("text")).alias("content_hash"),
        T.snippet(F.col("text")).alias("text_snippet"),
        F.array(link(i * 2 + 1), link(i * 2 + 2)).alias("extracted_links"),
    )


def _crawl_sql(depths: int, pages: int, per_domain: int, seeds: int) -> str:
    """The crawl over the replayed tree, level by level: a document's number is its URL's."""
    steps = [_GATE, f"judged as (select doc_id as i, decision, {_EXPAND} as expand, method, {_HASH} as hash from gated)", f"f0 as (select s.slot, x.i, x.i as ord from (values (1), (2)) s(slot), (select unnest(generate_series(0, {seeds - 1})) as i) x)"]
    for k in range(depths + 1):
        done = " union all ".join(f"select slot, i from p{j}" for j in range(k)) or "select 0 as slot, 0 as i where false"
        seen = " union all ".join(f"select slot, hash from e{j}" for j in range(k)) or "select 0 as slot, '' as hash where false"
        steps += [
            f"""d{k} as (select f.*, row_number() over (partition by f.slot, f.i % 7 order by ord) + coalesce(u.n, 0) as nd from f{k} f
                left join (select slot, i % 7 as host, count(*) as n from ({done}) x group by all) u on u.slot = f.slot and u.host = f.i % 7)""",
            f"""p{k} as (select slot, i, ord from (select d.*, row_number() over (partition by d.slot order by ord) + coalesce(u.n, 0) as n from (select * from d{k} where nd <= {per_domain}) d
                left join (select slot, count(*) as n from ({done}) x group by all) u on u.slot = d.slot) y where n <= {pages})""",
            f"""e{k} as (select slot, i, ord, decision, expand, method, hash, {k} as depth from (select p.*, j.* exclude (i), row_number() over (partition by slot, hash order by ord) as c from p{k} p join judged j using (i)) x
                where (c = 1 or hash = '') and (hash = '' or (slot, hash) not in ({seen})))""",
            f"""f{k + 1} as (select slot, i, row_number() over (partition by slot order by ord, pos) as ord from (select slot, i * 2 + 1 + pos as i, ord, pos from e{k}, (values (0), (1)) t(pos) where expand) x
                where (slot, i) not in ({done} union all select slot, i from p{k}))""",
        ]
    found = " union all ".join(f"select * from e{k}" for k in range(depths + 1))
    url = "'https://host' || (i % 7) || '.example/a/b/' || i || '.html'"
    return f"with {', '.join(steps)} select slot::bigint as slot_id, depth, row_number() over (partition by slot order by depth, ord)::int as ord, {url} as url, decision, expand, method from ({found}) z"


@query(_crawl_sql(5, 60, 10, 12))
def bfs_crawl(spark, sf_dir):
    """Budgeted breadth-first crawl over replayed pages."""
    slots = spark.createDataFrame([(1,), (2,)], "slot_id long")
    seeds = spark.createDataFrame([(i, f"https://host{i % 7}.example/a/b/{i}.html") for i in range(12)], "ord int, url string")
    out = crawl(slots, seeds, replay_pages(spark, sf_dir), CrawlConfig(max_depth=5, max_pages=60, max_pages_per_domain=10, gate=GATE))
    return out.select("slot_id", "depth", "ord", "url", "decision", "expand", "method")


@query(
    """select * from (values (1, true, 0.5::double, 'ok'), (2, null, null, null), (3, false, null, 'no')) t(reply_id, keep_page, relevance_score, reasons)"""
)
def scorer_replies(spark, sf_dir):
    from tidemark.schemas import REPLY

    raw = [(1, 'Here: {"keep_page": true, "relevance_score": 0.5, "reasons": "ok"} done'), (2, "no json at all"), (3, '{"keep_page": false, "reasons": "no"}')]
    r = spark.createDataFrame(raw, "reply_id int, reply string").select("reply_id", T.json_object(F.col("reply"), REPLY).alias("r"))
    return r.select("reply_id", "r.keep_page", "r.relevance_score", "r.reasons")


@query("select 3 as slides, 2 as to_process, 3::bigint as keywords")
def slide_statistics(spark, sf_dir):
    s = spark.createDataFrame(_SLIDES, "slide_number int, title string, should_optimize boolean, reason string, suggested_keywords array<string>")
    return s.agg(F.count(F.lit(1)).cast("int").alias("slides"), F.count_if("should_optimize").cast("int").alias("to_process"), F.sum(F.size("suggested_keywords")).alias("keywords"))


@query(r"select doc_id, regexp_matches(lower(text), '\bthe\b') as matches from documents")
def keyword_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.keyword_match(F.col("text"), KEYWORD).alias("matches"))


@query("select doc_id, lang || '||' || source as context from documents")
def context_signature(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.context_signature(F.col("lang"), F.col("source")).alias("context"))


@query(
    rf"""with {_PARTS} select page_id, case when regexp_matches(lower(host), '\.(edu|ac\.uk|ac\.cn|edu\.cn|gov|gov\.cn|org)$') then 10 else 0 end
    + case when regexp_matches(url, '/research|/publication|/course') then 3 else 0 end + case when regexp_matches(url, '/20\d{{2}}/') then 2 else 0 end as score from parts"""
)
def discovery_rank(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.discovery_rank(F.col("url")).alias("score"))


@query(
    rf"""with {_PARTS} select page_id, case when regexp_matches(lower(host), '\.(edu|ac\.uk|ac\.cn|edu\.cn|gov|gov\.cn|org)$') then 10 else 0 end + case page_id % 3 when 0 then 5 when 1 then 3 else 0 end as score from parts"""
)
def search_rank(spark, sf_dir):
    kind = F.when(F.col("page_id") % 3 == 0, "official").when(F.col("page_id") % 3 == 1, "primary").otherwise("related")
    return table(spark, sf_dir, "pages").select("page_id", C.search_rank(F.col("url"), kind).alias("score"))


@query(rf"with {_PARTS} select s as scheme, count(*) as pages, count_if(regexp_matches(lower(host), '\.(edu|ac\.uk|ac\.cn|edu\.cn|gov|gov\.cn|org)$')) as educational from parts group by s")
def educational_counts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.groupBy(U.scheme(F.col("url")).alias("scheme")).agg(F.count(F.lit(1)).alias("pages"), F.count_if(U.educational(F.col("url"))).alias("educational"))


@query(f"with {_PARTS}, {_KIND} select page_id, s || '://' || host || '/' as entrance from parts where page_id in (select page_id from classes where kind = 'event_seed' and list_contains(reasons, 'feed_url'))")
def feed_entrances(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where(C.feed(F.col("url")))
    return p.select("page_id", F.explode(C.entrances_of_feed(F.col("url"))).alias("entrance"))


@query(f"with {_CANON} select distinct canonical from canon where canonical not in (select canonical from canon where page_id % 2 = 0)")
def frontier_except(spark, sf_dir):
    """Candidates that were neither queued nor visited: an anti join on the canonical URL."""
    p = table(spark, sf_dir, "pages").select("page_id", U.canonical(F.col("url")).alias("canonical"))
    return R.except_known(p, p.where("page_id % 2 = 0"), ["canonical"])


@query("select page_id, md5(url) as data_id, page_id % 3 = 0 as success, case when page_id % 3 = 0 then null else 'no cached page' end as error from pages")
def page_cache_lookup(spark, sf_dir):
    from tidemark.sources.readers import cached

    p = table(spark, sf_dir, "pages")
    known = p.where("page_id % 3 = 0").select(F.md5("url").alias("data_id"), "html").dropDuplicates(["data_id"])
    return cached(p.select("page_id", F.md5("url").alias("data_id")), known).select("page_id", "data_id", "success", "error")


@query(
    f"""with {_PARTS}, labelled as (select {_WEAK} as url, case when page_id % 2 = 0 then 'even' else 'odd' end as source from parts union all select {_WEAK}, 'third' from parts where page_id % 3 = 0)
    select url, array_to_string(list_sort(list_distinct(list(source))), ',') as sources, count(*) as times from labelled group by url"""
)
def candidate_sources(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("url", U.without_fragment(F.col("url")))
    labelled = p.select("url", F.when(F.col("page_id") % 2 == 0, "even").otherwise("odd").alias("source")).unionByName(p.where("page_id % 3 = 0").select("url", F.lit("third").alias("source")))
    counts = labelled.groupBy("url").agg(F.count(F.lit(1)).alias("times"))
    return R.sources_of(labelled, ["url"]).join(counts, "url").select("url", F.array_join("sources", ",").alias("sources"), "times")

