"""Scalar text functions as native Column expressions.

Positions and lengths count code points. White space is spelled out, because Java's classes know fewer characters.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_CJK = ("一", "鿿")


def is_cjk(keyword: str) -> bool:
    return any(_CJK[0] <= c <= _CJK[1] for c in keyword)


def quoted(text: str) -> str:
    """A Java regex that matches text itself."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: expressions that use a large value often stay small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+\\z", "")


def keyword_hits(text: Column, keywords: Sequence[str]) -> Column:
    """Occurrences of all keywords, ignoring case: word-bounded, or plain substrings for Chinese keywords.

    Null and empty texts have none; empty keywords are skipped.
    """
    low = F.lower(text)
    total = F.lit(0)
    for k in keywords:
        if not k:
            continue
        key = k.lower()
        if is_cjk(k):
            n = ((F.length(low) - F.length(F.replace(low, F.lit(key), F.lit("")))) / len(key)).cast("int")
        else:
            n = F.regexp_count(low, F.lit(f"(?U)\\b{quoted(key)}\\b"))
        total = total + F.coalesce(n, F.lit(0))
    return total.cast("int")


def keyword_match(text: Column, keyword: str) -> Column:
    """Whether the keyword occurs; the test for Chinese keywords respects case."""
    if not keyword:
        return F.lit(False)
    if is_cjk(keyword):
        return F.coalesce(F.contains(text, F.lit(keyword)), F.lit(False))
    return F.coalesce(F.lower(text).rlike(f"(?U)\\b{quoted(keyword.lower())}\\b"), F.lit(False))


def headings(markdown: Column, most: int = 10) -> Column:
    """Texts of the first Markdown headings."""
    found = F.regexp_extract_all(markdown, F.lit(f"(?md)^#{{1,6}}{SPACE}+(.+)$"), 1)
    return F.slice(F.transform(F.coalesce(found, F.array().cast("array<string>")), strip), 1, most)


def collapse(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def snippet(text: Column, size: int = 500) -> Column:
    cut = lambda c: strip(F.concat(F.regexp_replace(F.substring(c, 1, size), " [^ ]*$", ""), F.lit("...")))
    return let(collapse(F.coalesce(text, F.lit(""))), lambda c: F.when(F.length(c) <= size, c).otherwise(cut(c)))


def content_hash(text: Column) -> Column:
    """MD5 of the collapsed text; "" for a null or empty text."""
    return F.when(text.isNull() | (text == ""), "").otherwise(F.md5(collapse(text)))


def fast_filter(text: Column, keywords: Sequence[str], min_length: int = 500, min_hits: int = 1) -> Column:
    """struct<passed, reason>: cheap checks of length, keyword hits and share of characters that aren't blank."""
    size, hits = F.length(text), keyword_hits(text, keywords)
    dense = F.length(F.regexp_replace(text, SPACE, "")) / size
    no = lambda reason: F.struct(F.lit(False).alias("passed"), reason.alias("reason"))
    return (
        F.when(text.isNull() | (text == ""), no(F.lit("Empty text")))
        .when(size < min_length, no(F.format_string(f"Text too short (%d < {min_length})", size)))
        .when(hits < min_hits, no(F.format_string(f"Insufficient keyword hits (%d < {min_hits})", hits)))
        .when(dense < 0.1, no(F.format_string("Low content density (%.2f < 0.1)", dense)))
        .otherwise(F.struct(F.lit(True).alias("passed"), F.lit("Passed fast filter").alias("reason")))
    )


def clean(text: Column) -> Column:
    """Unix line ends, single blanks, at most one empty line in a row."""
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, "[ \\t]+", " ")
    return strip(F.regexp_replace(t, f"\\n{SPACE}*\\n", "\n\n"))


def markdown_main_content(markdown: Column, most: int = 10_000) -> Column:
    """Lines outside fenced code that are neither quotes nor one-line comments, up to a length."""
    line = lambda x: strip(x)
    start = F.struct(F.lit(False).alias("code"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, raw: Column) -> Column:
        s = line(raw)
        fence = F.startswith(s, F.lit("```"))
        comment = F.contains(raw, F.lit("<!--")) & F.contains(raw, F.lit("-->"))
        drop = fence | state["code"] | comment | F.startswith(s, F.lit(">"))
        return F.struct(F.when(fence, ~state["code"]).otherwise(state["code"]).alias("code"), F.when(drop, state["kept"]).otherwise(F.concat(state["kept"], F.array(raw))).alias("kept"))

    kept = F.aggregate(F.split(F.coalesce(markdown, F.lit("")), "\n", -1), start, step)["kept"]
    return F.substring(strip(F.array_join(kept, "\n")), 1, most)


def truncate(text: Column, size: int) -> Column:
    """Cut at the last space within size characters, with "..."."""
    head = F.substring(text, 1, size)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.regexp_replace(head, " [^ ]*$", ""), F.lit("...")))


def keyword_signature(keywords: Sequence[str]) -> str:
    return "|".join(sorted(keywords))


def context_signature(title: Column, reason: Column) -> Column:
    t, r = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(reason, F.lit("")))
    return F.when((t == "") & (r == ""), "").otherwise(F.concat(t, F.lit("||"), r))


def context_is_useful(title: Column, reason: Column, stop: Sequence[str]) -> Column:
    """Whether a title (over 5 characters) or reason (over 10) says something, i.e. holds no stop phrase."""
    ok = lambda c, n: (F.length(strip(c)) > n) & ~F.exists(F.array(*map(F.lit, stop)).cast("array<string>"), lambda s: F.contains(F.lower(c), F.lower(s)))
    return F.coalesce(ok(reason, 10), F.lit(False)) | F.coalesce(ok(title, 5), F.lit(False))


def heading_hits(heads: Column, keywords: Sequence[str]) -> Column:
    """Headings that hold any keyword as a plain substring, ignoring case."""
    if not keywords:
        return F.lit(0)
    keys = F.array(*(F.lit(k.lower()) for k in keywords))
    return F.size(F.filter(F.coalesce(heads, F.array().cast("array<string>")), lambda h: F.exists(keys, lambda k: F.contains(F.lower(h), k))))


def score_table(keywords: int, most_headings: int = 10) -> list[float]:
    """Rule scores of all states, rounded as Python rounds: by hits, length class, then (headings, heading hits)."""
    out = []
    for hits in range(keywords + 1):
        for share in (0.2, 0.5, 0.7, 1.0):
            for n in range(most_headings + 1):
                for met in range(n + 1):
                    s = 0.0
                    if keywords:
                        s += 0.4 * min(hits / keywords, 1.0)
                    s += 0.3 * share
                    s += 0.3 * min(met / n, 1.0) if n else 0.1
                    out.append(round(s, 3))
    return out


def score_index(hits: Column, size: Column, heads: Column, met: Column, keywords: int, most_headings: int = 10) -> Column:
    """Place (from 0) of a state in score_table."""
    states = (most_headings + 1) * (most_headings + 2) // 2
    length = F.when(size > 3000, 3).when(size > 1000, 2).when(size > 500, 1).otherwise(0)
    return (F.least(hits, F.lit(keywords)) * 4 + length) * states + (heads * (heads + 1) / 2).cast("int") + met


def rule_score(text: Column, keywords: Sequence[str], heads: Column | None = None) -> Column:
    """Rule-based relevance from 0 to 1 with three decimals; 0 for a null or empty text. heads has 10 at most."""
    heads = F.array().cast("array<string>") if heads is None else F.coalesce(heads, F.array().cast("array<string>"))
    table = F.lit(score_table(len(keywords)))
    at = score_index(keyword_hits(text, keywords), F.length(text), F.size(heads), heading_hits(heads, keywords), len(keywords))
    return F.when(text.isNull() | (text == ""), 0.0).otherwise(F.get(table, at))


def json_object(reply: Column, schema: str) -> Column:
    """The object between the first { and the last } of a reply; its fields are null if it isn't valid JSON."""
    inner = F.regexp_extract(reply, "(?s)\\{.*\\}", 0)
    return F.from_json(F.when(inner != "", inner).otherwise(reply), schema)


def rss_keywords(keyword: Column, translations: dict[str, Sequence[str]]) -> Column:
    """The keyword's translations, or itself."""
    pairs = [x for k, v in translations.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    known = F.element_at(F.create_map(*pairs), keyword) if pairs else F.lit(None).cast("array<string>")
    return F.coalesce(known, F.array(keyword))


def safe_filename(text: Column, most: int = 120) -> Column:
    """A text's first ``most`` characters as a file name.

    They are those of the text's head, if its name is longer still: only what ends it depends on what follows. Where
    runs of marks or blanks leave too little of the head, the whole text is read.
    """

    def named(c: Column) -> Column:
        t = F.regexp_replace(F.lower(strip(c)), f"{SPACE}+", "_")
        return F.regexp_replace(t, "[^0-9a-zA-Z_\\u4e00-\\u9fff\\-.]+", "_")

    head = let(named(F.substring(text, 1, 8 * most)), lambda h: F.when(F.length(h) > most, h).otherwise(named(text)))
    return F.substring(head, 1, most)
