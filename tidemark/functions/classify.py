"""Sorting URLs into event seeds, anchor seeds, evidence and discards, by their spelling alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.functions.text import let

LIBRARIES = (
    "web.archive.org archive.org books.google.com books.google.co.uk books.googleusercontent.com worldcat.org id.worldcat.org bnf.fr catalogue.bnf.fr "
    "data.bnf.fr loc.gov id.loc.gov d-nb.info ndl.go.jp id.ndl.go.jp aleph.nkp.cz kopkatalogs.lv nli.org.il hdl.handle.net doi.org api.semanticscholar.org"
).split()
PAPERS = (
    "arxiv.org pubmed.ncbi.nlm.nih.gov ncbi.nlm.nih.gov ui.adsabs.harvard.edu jstor.org citeseer.ist.psu.edu citeseerx.ist.psu.edu projecteuclid.org "
    "eprints.ecs.soton.ac.uk research-portal.uws.ac.uk research-information.bris.ac.uk dblp.org semanticscholar.org"
).split()
GOSSIP = "lifeandstyle|celebrity|entertainment|fashion|gossip|lifestyle|tabloid"
TRUSTED = "nasa.gov jpl.nasa.gov mars.nasa.gov esa.int jaxa.jp cnsa.gov.cn science.org nature.com ieee.org acm.org mit.edu stanford.edu harvard.edu berkeley.edu cornell.edu ox.ac.uk cam.ac.uk".split()
KNOWLEDGE_ROOTS = "getty.edu wikidata.org wikipedia.org wikiversity.org wikisource.org wikimedia.org loc.gov ndl.go.jp".split()
KNOWLEDGE_HOSTS = "vocab.getty.edu id.loc.gov id.ndl.go.jp".split()
_LISTING = "/(tags?|topics?|category|categories|archives?)/"
_ANCHOR = "/(docs|documentation|doc|manual|handbook|guide|tutorial|reference|api|spec|standards|courses?|syllabus|lectures?|teaching|learn|learning|kb|wiki)/|/(introduction|overview|getting[-_]started)"
_NEWSROOM = "^/(news|press|pressroom|press-releases|releases|updates|announcements|notices|bulletin|blog)(/|$)"
_FEEDS = "(?i)(?<![^/])feeds/"
_FORUM_HOST = "stackoverflow\\.com|stackexchange\\.com|reddit\\.com|quora\\.com|zhihu\\.com|tieba\\.baidu\\.com|discuss|forum|bbs"
#: Kind -> smallest score that is kept.
KEEP_FROM = {"event_seed": 8, "anchor_seed": 6, "evidence": 0}


def _low_path(url: Column) -> Column:
    return F.lower(U.path(url))


def host(url: Column) -> Column:
    return F.lower(U.netloc(url))


def blocked(domain: Column, url: Column) -> Column:
    names = [*LIBRARIES, *PAPERS]
    return domain.isin(names) | U.root_domain(domain).isin(names) | F.lower(url).rlike(GOSSIP)


def trusted(domain: Column) -> Column:
    return domain.isin(TRUSTED) | U.root_domain(domain).isin(TRUSTED) | domain.rlike("\\.(edu|ac\\.uk|ac\\.cn|edu\\.cn|gov|gov\\.cn)$")


def knowledge_base(domain: Column) -> Column:
    return domain.isin(KNOWLEDGE_HOSTS) | U.root_domain(domain).isin(KNOWLEDGE_ROOTS)


def many_tracking_keys(url: Column) -> Column:
    # keys are distinct as they are spelled, before lower-casing
    keys = F.transform(F.array_distinct(F.transform(U.query_pairs(url), lambda p: p["k"])), F.lower)
    tracking = F.size(F.filter(keys, lambda k: k.rlike("^(utm_|gclid|fbclid|mc_cid|mc_eid)")))
    return ((F.size(keys) >= 6) & (tracking >= 1)) | (tracking >= 2)


def feed(url: Column) -> Column:
    u = F.lower(url)
    return u.rlike("rss|atom|feed|\\.xml") & ~F.contains(u, F.lit("feedback"))


def _page_key(url: Column) -> Column:
    return F.arrays_overlap(U.query_keys(url), F.array(*map(F.lit, ("page", "p", "offset"))))


def taxonomy_listing(url: Column) -> Column:
    return _low_path(url).rlike(_LISTING)


def paginated(url: Column) -> Column:
    return F.contains(_low_path(url), F.lit("/page/")) | _page_key(url)


def detail_article(url: Column) -> Column:
    p = _low_path(url)
    slashes = F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))
    dated = F.lower(url).rlike("/20\\d{2}/\\d{1,2}/\\d{1,2}/")
    news = F.contains(p, F.lit("/news/"))
    return F.when(dated, True).when(news, ~(taxonomy_listing(url) | paginated(url))).otherwise((F.length(p) > 90) & (slashes >= 3))


def _segments(p: Column) -> Column:
    return F.size(F.filter(F.split(p, "/"), lambda s: s != ""))


def newsroom_entrance(url: Column) -> Column:
    p = F.regexp_replace(_low_path(url), "/+$", "")
    return ~detail_article(url) & p.rlike(_NEWSROOM) & (_segments(p) <= 2)


def anchor_like(url: Column) -> Column:
    return _low_path(url).rlike(_ANCHOR)


def content_file(url: Column) -> Column:
    p = _low_path(url)
    return p.rlike("\\.(html|htm|pdf|doc|docx|ppt|pptx)$") | p.rlike("/works?/20?\\d{2}/") | p.rlike("/full-?text") | (_segments(p) >= 5)


def classify(raw: Column) -> Column:
    """struct<url, domain, root_domain, kind, score, reasons> of a URL."""
    none = F.array().cast("array<string>")
    because = lambda cond, reason: F.when(cond, F.array(F.lit(reason))).otherwise(none)
    points = lambda cond, n: F.when(cond, n).otherwise(0)

    def facts(url: Column) -> Column:
        d, p = host(url), _low_path(url)
        tests = {
            "invalid": (url == "") | ~F.startswith(U.scheme(url), F.lit("http")) | (d == ""),
            "blocked": blocked(d, url),
            "forum": d.rlike(_FORUM_HOST) | F.lower(url).rlike("/forum|/discuss|/thread"),
            "track": many_tracking_keys(url),
            "trust": trusted(d),
            "kb": knowledge_base(d),
            "detail": detail_article(url),
            "content": content_file(url),
            "feed": feed(url),
            "taxonomy": taxonomy_listing(url),
            "paged": paginated(url),
            "room": newsroom_entrance(url),
            "anchor": anchor_like(url),
            "docs": p.rlike("/docs|/documentation|/manual|/handbook|/reference"),
            "course": p.rlike("/courses?|/syllabus|/lectures"),
            "security": p.rlike("/changelog|/release-notes|/security|/advisory"),
        }
        return F.struct(url.alias("url"), d.alias("d"), U.root_domain(d).alias("root"), *(t.alias(k) for k, t in tests.items()))

    def ladder(x: Column) -> Column:
        reasons = F.concat(because(x["track"], "many_tracking_params"), because(x["trust"], "trusted_domain"), because(x["kb"], "knowledge_base"))
        base = points(x["track"], -8) + points(x["trust"], 8) + points(x["kb"], 1)
        paged = F.concat(reasons, because(x["content"], "content_page"))
        hints, hint_points = F.concat(because(x["docs"], "docs_hint"), because(x["course"], "course_hint")), points(x["docs"], 3) + points(x["course"], 2)

        def verdict(kind: str, score, why: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), (F.lit(score) if isinstance(score, int) else score).cast("int").alias("score"), why.alias("reasons"))

        def event(reason: str, score: int, bonus: int) -> Column:
            return verdict("event_seed", base + score + points(x["trust"], bonus) + points(x["security"], 4), F.concat(reasons, F.array(F.lit(reason)), because(x["security"], "update_security_hint")))

        as_anchor = F.when(x["anchor"], F.array(F.lit("anchor_like"))).otherwise(F.array(F.lit("anchor_from_content_or_kb")))
        return (
            F.when(x["invalid"], verdict("discard", -999, F.array(F.lit("invalid_url"))))
            .when(x["blocked"], verdict("discard", -999, F.array(F.lit("blocked_domain_or_token"))))
            .when(x["forum"], verdict("discard", -50, F.array(F.lit("forum_like"))))
            .when(x["detail"], verdict("evidence", base + 2, F.concat(reasons, F.array(F.lit("detail_article")))))
            .when(x["feed"], verdict("event_seed", base + points(x["content"], 3) + 30, F.concat(paged, F.array(F.lit("feed_url")))))
            .when(x["content"] | x["kb"], verdict("anchor_seed", base + points(x["content"], 3) + F.when(x["anchor"], 6).otherwise(4) + hint_points, F.concat(paged, as_anchor, hints)))
            .when(x["taxonomy"], event("taxonomy_listing", 16, 3))
            .when(x["paged"], event("pagination_listing", 12, 2))
            .when(x["room"], event("newsroom_entrance", 10, 2))
            .when(x["anchor"], verdict("anchor_seed", base + 10 + hint_points, F.concat(reasons, F.array(F.lit("anchor_like")), hints)))
            .otherwise(verdict("discard", base - 2, F.concat(reasons, F.array(F.lit("unclear_type")))))
        )

    def result(x: Column) -> Column:
        return let(ladder(x), lambda v: F.struct(x["url"].alias("url"), x["d"].alias("domain"), x["root"].alias("root_domain"), v["kind"].alias("kind"), v["score"].alias("score"), v["reasons"].alias("reasons")))

    return let(U.without_fragment(raw), lambda url: let(facts(url), result))


def kept(kind: Column, score: Column) -> Column:
    test = F.lit(False)
    for k, least in KEEP_FROM.items():
        test = test | ((kind == k) & (score >= least))
    return test


def entrances_of_feed(feed_url: Column) -> Column:
    """Sorted array of the listing pages that a feed URL points to."""
    kinds = "categories category tag tags topic topics".split()
    none = F.array().cast("array<string>")

    def split(u: Column) -> Column:
        p = F.regexp_replace(F.regexp_replace(U.path(u), "^/+|/+$", ""), "(?i)\\.(rss|xml)$", "")
        topic = F.regexp_extract(p, f"{_FEEDS}(?:categor(?:y|ies)|tags?|topics?)/([^/]+)\\z", 1)
        plain = F.regexp_extract(p, f"{_FEEDS}([^/]+)\\z", 1)
        ok = F.startswith(U.scheme(u), F.lit("http")) & (U.netloc(u) != "")
        return F.struct(F.concat(U.scheme(u), F.lit("://"), U.netloc(u)).alias("site"), topic.alias("topic"), plain.alias("plain"), ok.alias("ok"))

    def listed(x: Column) -> Column:
        pages = lambda names, slug: F.array(*(F.concat(x["site"], F.lit(f"/{k}/"), slug) for k in names))
        more = F.when(x["topic"] != "", pages(kinds, x["topic"])).when(x["plain"] != "", pages([*kinds, "blog", "news"], x["plain"])).otherwise(none)
        return F.when(x["ok"], F.array_sort(F.array_distinct(F.transform(F.concat(F.array(F.concat(x["site"], F.lit("/"))), more), U.without_fragment)))).otherwise(none)

    return let(U.without_fragment(feed_url), lambda u: let(split(u), listed))


def promoted_entrances(url: Column, parents: int = 2) -> Column:
    """Array, in order: the site's root, up to ``parents`` parent folders, and newsroom folders among the first three segments."""
    site = F.concat(U.scheme(url), F.lit("://"), U.netloc(url))
    trimmed = F.regexp_replace(U.path(url), "^/+|/+$", "")
    seg = F.split(trimmed, "/", -1)
    none = F.array().cast("array<string>")
    n = F.size(seg)
    cuts = F.when(n > 1, F.sequence(n - 1, F.greatest(n - parents, F.lit(1)), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    up = F.transform(cuts, lambda k: F.concat(site, F.lit("/"), F.array_join(F.slice(seg, 1, k), "/"), F.lit("/")))
    low = F.filter(F.transform(F.slice(seg, 1, 3), F.lower), lambda s: s.isin("blog", "news", "press", "releases", "updates"))
    rooms = F.transform(low, lambda s: F.concat(site, F.lit("/"), s, F.lit("/")))
    all_of = F.concat(F.array(F.concat(site, F.lit("/"))), F.when(trimmed == "", none).otherwise(F.concat(up, rooms)))
    ok = F.startswith(U.scheme(url), F.lit("http")) & (U.netloc(url) != "")
    return F.when(ok, F.array_distinct(F.transform(all_of, U.without_fragment))).otherwise(none)


_ENTRANCE = "/(news|press|pressroom|releases?|updates?|announcements?|notices?|bulletin|blog|topics?|tags?|category|categories|archives?)(/|$)"


def recall_rank(url: Column) -> Column:
    """Coarse score of a recalled URL: trust 10, entrance 5, news 2, a year 1."""
    p = _low_path(url)
    edu = host(url).rlike("\\.(edu|ac\\.uk|ac\\.cn|edu\\.cn|gov|gov\\.cn)$")
    return (F.when(edu, 10).otherwise(0) + F.when(p.rlike(_ENTRANCE), 5).otherwise(0) + F.when(p.rlike("/news|/press|/releases|/updates"), 2).otherwise(0) + F.when(url.rlike("/20\\d{2}/"), 1).otherwise(0)).cast("int")


def discovery_rank(url: Column) -> Column:
    """Score of an external link: education (.org too) 10, research words 3, a date 2."""
    u = F.lower(url)
    return (F.when(U.educational(url), 10).otherwise(0) + F.when(url.rlike("/research|/publication|/course"), 3).otherwise(0) + F.when(url.rlike("/20\\d{2}/"), 2).otherwise(0)).cast("int")


def search_rank(url: Column, kind: Column) -> Column:
    """Score of a search result: education 10, official 5, primary 3."""
    return (F.when(U.educational(url), 10).otherwise(0) + F.when(kind == "official", 5).otherwise(0) + F.when(kind == "primary", 3).otherwise(0)).cast("int")


def entrance_like(url: Column) -> Column:
    p = _low_path(url)
    share = F.lower(url).rlike("login|signup|subscribe|share|facebook\\.com|twitter\\.com|t\\.co")
    return F.startswith(url, F.lit("http")) & p.rlike(_ENTRANCE) & ~share


