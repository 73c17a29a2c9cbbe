"""URL functions and predicates as native Column expressions, on a split after RFC 3986."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let, strip

_SPLIT = "^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?"
TRACKING = tuple("eqid from nsukey ref scene share source spm timestamp utm_campaign utm_content utm_medium utm_source utm_term vd_source".split())
MEDIA = tuple("doc docx gif jpeg jpg mp3 mp4 pdf png rar svg webp zip".split())
WIKI_FAMILY = tuple("mediawiki wikibooks wikidata wikimedia wikinews wikipedia wikiquote wikisource wikivoyage wiktionary".split())


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SPLIT, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 2)


def path_params(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 3)


def path(url: Column) -> Column:
    """Path without the last segment's ;params."""
    return F.regexp_replace(path_params(url), ";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 4)


def _has_authority(url: Column) -> Column:
    return url.rlike("^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//")


def _resolved(base_path: Column, rel: Column) -> Column:
    """Path of a relative reference, dot segments removed."""
    whole = F.when(F.startswith(rel, F.lit("/")), rel).otherwise(F.concat(F.regexp_replace(base_path, "[^/]*$", ""), rel))
    none = F.array().cast("array<string>")

    def walk(parts: Column) -> Column:
        last = F.element_at(parts, -1)
        own = F.concat(F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda s: s != ""), F.array(last))
        kept = F.aggregate(own, none, lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
        return let(kept, lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(last.isin(".", "..") & (F.size(k) > 0), F.lit("/")).otherwise(F.lit(""))))

    return let(F.split(F.regexp_replace(whole, "^/", ""), "/", -1), walk)


def _tail(url: Column) -> Column:
    return F.regexp_extract(url, "^[^?#]*(\\?[^#]*)", 1)


def join(base: Column, url: Column) -> Column:
    """The URL that a reference means on a page; fragments are dropped."""

    def resolved(x: Column) -> Column:
        site = F.concat(x["bs"], F.lit("://"), x["bn"])
        moved = F.concat(site, _resolved(x["bp"], x["p"]), x["t"])
        return (
            F.when(x["u"] == "", x["b"])
            .when(x["s"] != "", F.when((x["s"] == x["bs"]) & ~x["abs"], moved).otherwise(x["u"]))
            .when(x["abs"], F.concat(x["bs"], F.lit(":"), x["u"]))
            .when((x["p"] == "") & (x["t"] == ""), F.concat(site, x["bp"], x["bt"]))
            .when(x["p"] == "", F.concat(site, x["bp"], x["t"]))
            .otherwise(moved)
        )

    parts = {"b": base, "u": url, "bs": scheme(base), "bn": netloc(base), "bp": path_params(base), "bt": _tail(base), "s": scheme(url), "abs": _has_authority(url), "p": path_params(url), "t": _tail(url)}
    return let(F.struct(*(v.alias(k) for k, v in parts.items())), resolved)


def _unquote(text: Column) -> Column:
    """Form decoding that leaves bad escapes as they are."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _quote(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_pairs(url: Column) -> Column:
    """array<struct<k, v>> of the decoded parameters that have a value."""
    items = F.filter(F.split(query(url), "&"), lambda x: x.rlike("(?s)^[^=]*=."))
    return F.transform(items, lambda x: F.struct(_unquote(F.regexp_extract(x, "^[^=]*", 0)).alias("k"), _unquote(F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1)).alias("v")))


def query_keys(url: Column) -> Column:
    """Distinct lower-cased keys of the parameters that have a value."""
    return F.array_distinct(F.transform(F.array_distinct(F.transform(query_pairs(url), lambda p: p["k"])), F.lower))


def canonical(url: Column, base: Column | None = None) -> Column:
    """One spelling for each page: resolved, lower-cased host, default port, index page, tracking keys and fragment dropped.

    Null for empty URLs, for mailto:, tel:, javascript:, data: and fragment links, and without a host.
    """

    def spelled(x: Column) -> Column:
        s = F.when(x["s"] == "", "https").otherwise(x["s"])
        host = F.when(x["s"] == "http", F.regexp_replace(x["n"], ":80$", "")).when(x["s"].isin("https", ""), F.regexp_replace(x["n"], ":443$", "")).otherwise(x["n"])
        p = F.regexp_replace(F.regexp_replace(F.when(x["p"] == "", "/").otherwise(x["p"]), "/{2,}", "/"), "(?i)/index\\.(html?|shtml)$", "/")
        q = F.array_join(F.transform(x["q"], lambda y: F.concat(_quote(y["k"]), F.lit("="), _quote(y["v"]))), "&")
        mark = F.when(F.size(x["q"]) == 0, "").otherwise("?")
        return F.when(x["bad"] | (x["n"] == ""), None).otherwise(F.concat(s, F.lit("://"), host, F.regexp_replace(p, "(?<=.)/$", ""), mark, q))

    def split(full: Column, bad: Column) -> Column:
        pairs = F.array_sort(F.filter(query_pairs(full), lambda y: ~F.lower(y["k"]).isin(*TRACKING)))
        return F.struct(bad.alias("bad"), scheme(full).alias("s"), F.lower(netloc(full)).alias("n"), path(full).alias("p"), pairs.alias("q"))

    def whole(u: Column) -> Column:
        bad = u.isNull() | (u == "") | u.rlike("^(mailto:|tel:|javascript:|data:|#)")
        if base is None:
            return let(split(u, bad), spelled)
        full = F.when(base.isNull() | (base == ""), u).otherwise(join(base, u))
        return let(full, lambda f: let(split(f, bad), spelled))

    return let(strip(url), whole)


def without_fragment(url: Column) -> Column:
    """The weak normal form: no fragment, no single trailing slash behind a path."""
    return let(F.regexp_replace(url, "(?s)#.*$", ""), lambda b: F.when(F.endswith(b, F.lit("/")) & (F.length(path(b)) > 1), F.regexp_replace(b, "/$", "")).otherwise(b))


def domain(url: Column) -> Column:
    """Lower-cased authority without a leading www. (port and user stay)."""
    return F.regexp_replace(F.lower(netloc(url)), "^www\\.", "")


def root_domain(name: Column) -> Column:
    """Last two labels."""
    bare = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "^\\.+|\\.+$", "")
    return F.when(bare.rlike("^[^.]*(\\.[^.]*)?$"), bare).otherwise(F.regexp_extract(bare, "[^.]*\\.[^.]*$", 0))


def allowed_domain(url: Column, allow: Sequence[str] = (), block: Sequence[str] = ()) -> Column:
    """Substring tests on the domain; blocking wins, an empty allow list allows all."""
    return allowed_name(domain(url), allow, block)


def allowed_name(d: Column, allow: Sequence[str] = (), block: Sequence[str] = ()) -> Column:
    """The same tests on a domain."""
    within = lambda names: F.exists(F.array(*(F.lit(n.lower()) for n in names)), lambda n: F.contains(d, n))
    ok = within(allow) if allow else F.lit(True)
    return (ok & ~within(block)) if block else ok


def _media(p: Column) -> Column:
    return p.rlike("\\.(" + "|".join(MEDIA) + ")$")


def crawlable(url: Column, allow: Sequence[str] = (), block: Sequence[str] = (), same_as: Column | None = None) -> Column:
    """Not a media file, of an allowed domain and, if asked, of the referrer's domain (visited URLs: an anti join)."""
    ok = ~_media(F.lower(path(url))) & allowed_domain(url, allow, block)
    return ok if same_as is None else ok & (same_as.isNull() | (same_as == "") | (domain(url) == same_as))


def valid(url: Column) -> Column:
    return F.coalesce(url.rlike("^https?://") & (netloc(url) != ""), F.lit(False))


def looks_like_article(url: Column) -> Column:
    """Whether a link is worth a visit, judged by its spelling."""

    def judged(x: Column) -> Column:
        p = x["p"]
        listing = F.exists(x["keys"], lambda k: F.startswith(k, F.lit("utm_")) | k.isin("from", "p", "page", "pagesize", "ref", "share", "source", "spm"))
        depth = F.length(F.regexp_replace(F.regexp_replace(p, "^/+|/+$", ""), "[^/]", ""))
        return (
            F.when(x["u"].isNull() | (x["u"] == ""), False)
            .when(_media(p) | p.isin("", "/") | p.rlike("/index\\.(s?html|htm)$"), False)
            .when(p.rlike("node_|list_|channel_|column_|search|login|register") | listing, False)
            .when(p.rlike("\\.(shtml|html|htm)$") | p.rlike("/20\\d\\d[-/]\\d\\d?[-/]\\d\\d?/|/20\\d{6}/"), True)
            .otherwise(depth >= 2)
        )

    return let(F.struct(url.alias("u"), F.lower(path(url)).alias("p"), query_keys(url).alias("keys")), judged)


def external_candidate(url: Column) -> Column:
    host = F.lower(netloc(url))
    wiki = host.rlike("(" + "|".join(WIKI_FAMILY) + ")\\.org$")
    return F.coalesce(F.startswith(url, F.lit("http")) & (host != "") & ~wiki & ~url.rlike("(?i)\\.(gif|jpe?g|mp[34]|pdf|png|rar|svg|zip)$"), F.lit(False))


def educational(url: Column) -> Column:
    return F.coalesce(F.lower(netloc(url)).rlike("\\.(edu|ac\\.uk|ac\\.cn|edu\\.cn|gov|gov\\.cn|org)$"), F.lit(False))


def probable_feed(url: Column) -> Column:
    u = F.lower(url)
    return F.coalesce(F.startswith(u, F.lit("http")) & ~F.contains(u, F.lit("feedback")) & u.rlike("rss|atom|feed|\\.xml$"), F.lit(False))


def wiki_page(title: Column, lang: Column) -> Column:
    return F.concat(F.lit("https://"), lang, F.lit(".wikipedia.org/wiki/"), F.replace(title, F.lit(" "), F.lit("_")))


def unwrap_redirect(href: Column) -> Column:
    """The target of a search engine's uddg= link."""
    target = F.regexp_extract(href, "[?&]uddg=([^&]*)", 1)
    return F.when(target == "", href).otherwise(_unquote(target))
