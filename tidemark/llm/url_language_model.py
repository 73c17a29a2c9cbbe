"""URL filters: ratio of two character language models.

Two variable-order Markov models (orders 0 to ORDER, Witten-Bell smoothing, each order falling back on the one
below, the lowest on a uniform law over ALPHABET characters) are estimated over all URLs: one for rejected URLs
(whose host holds one of the seed TERMS), one for accepted URLs (all others). A URL's score is the sum over its
characters of ln P(accepted) - ln P(rejected), divided by their number. The threshold is calibrated on both groups:
the point that lies equally many standard deviations below the accepted mean and above the rejected mean. URLs are
lower-cased, without their scheme, begun with ORDER start marks and ended with an end mark.

All of it is declarative SQL: n-grams are counted once at the highest order, lower orders are sums of that table.

Defined results: a null or empty URL has no characters, its score is null and it isn't kept; each page row gets the
score of its URL, repeated rows and null page_ids included; a URL counts as often as it occurs; when one of the two
groups is empty there is nothing to compare, every URL with characters is kept with score 0; a score equal to the
threshold is kept; an empty table gives an empty result; columns other than page_id and url aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.tables import written

ORDER = 4
ALPHABET = 128
TERMS = ("spam", "casino", "bets", "pills", "adult", "ads-", "porn", "viagra", "lottery", "jackpot")


_HOST = "regexp_extract(u, '^[^/]*', 0)"
_URL = "regexp_replace(lower(url), '^[a-z][a-z0-9+.-]*://', '')"


def _gram_steps(pages: str, explode: str) -> list[str]:
    """grams: one row an n-gram of each distinct URL (u, its count n, bad: 1 for a rejected seed); top: n-gram counts."""
    terms = " or ".join(f"{_HOST} like '%{t}%'" for t in TERMS)
    return [
        f"""urls as (select u, count(*) as n, max(case when {terms} then 1 else 0 end) as bad
            from (select {_URL} as u from {pages}) x where u is not null and u <> '' group by u)""",
        f"padded as (select u, n, bad, concat(repeat(chr(2), {ORDER}), u, chr(3)) as s from urls)",
        f"spots as (select u, n, bad, s, {explode} as i from padded)",
        f"grams as (select u, n, bad, substr(s, cast(i as int), {ORDER + 1}) as g from spots)",
        "top as (select g, sum(case when bad = 0 then n else 0 end) as a, sum(case when bad = 1 then n else 0 end) as r from grams group by g)",
    ]


def _weight_steps() -> list[str]:
    """From top to weights: ln P(accepted) - ln P(rejected) of each n-gram's last character after the others."""
    steps = [
        f"c0 as (select substr(g, {ORDER + 1}, 1) as g, sum(a) as a, sum(r) as r from top group by 1)",
        f"""p0 as (select g, case when na = 0 then 1 / {ALPHABET}.0 else (a + ta / {ALPHABET}.0) / (na + ta) end as pa,
            case when nr = 0 then 1 / {ALPHABET}.0 else (r + tr / {ALPHABET}.0) / (nr + tr) end as pr from
            (select g, cast(a as double) as a, cast(r as double) as r from c0) x cross join
            (select cast(sum(a) as double) as na, cast(sum(r) as double) as nr, cast(sum(case when a > 0 then 1 else 0 end) as double) as ta,
             cast(sum(case when r > 0 then 1 else 0 end) as double) as tr from c0) y)""",
    ]
    for k in range(1, ORDER + 1):
        if k < ORDER:
            steps.append(f"c{k} as (select substr(g, {ORDER + 1 - k}, {k + 1}) as g, sum(a) as a, sum(r) as r from top group by 1)")
        counts = "top" if k == ORDER else f"c{k}"
        steps.append(
            f"""h{k} as (select substr(g, 1, {k}) as h, cast(sum(a) as double) as na, cast(sum(r) as double) as nr,
                cast(sum(case when a > 0 then 1 else 0 end) as double) as ta, cast(sum(case when r > 0 then 1 else 0 end) as double) as tr
                from {counts} group by 1)"""
        )
        steps.append(
            f"""p{k} as (select c.g, case when na = 0 then b.pa else (c.a + ta * b.pa) / (na + ta) end as pa,
                case when nr = 0 then b.pr else (c.r + tr * b.pr) / (nr + tr) end as pr
                from {counts} c join h{k} on h{k}.h = substr(c.g, 1, {k}) join p{k - 1} b on b.g = substr(c.g, 2, {k}))"""
        )
    return [*steps, f"weights as (select g, ln(pa) - ln(pr) as w from p{ORDER})"]


_RAW = "select u, n, bad, sum(w) / count(*) as score from grams join weights using (g) group by u, n, bad"


def _verdict(pages: str) -> str:
    return f"""stats as (select sum(n) as n, sum(case when bad = 1 then n else 0 end) as nb,
            sum(case when bad = 0 then n * score end) / sum(case when bad = 0 then n end) as ma,
            sum(case when bad = 1 then n * score end) / sum(case when bad = 1 then n end) as mr,
            sum(case when bad = 0 then n * score * score end) / sum(case when bad = 0 then n end) as qa,
            sum(case when bad = 1 then n * score * score end) / sum(case when bad = 1 then n end) as qr from raw),
        calibrated as (select nb > 0 and nb < n as both_groups, case when sa + sr > 0 then (ma * sr + mr * sa) / (sa + sr) else (ma + mr) / 2 end as threshold from
            (select n, nb, ma, mr, sqrt(greatest(qa - ma * ma, 0)) as sa, sqrt(greatest(qr - mr * mr, 0)) as sr from stats) x),
        judged as (select u, case when both_groups then score else 0 end as score, case when both_groups then score >= threshold else true end as ok from raw cross join calibrated)
        select p.page_id, round(j.score, 6) as url_score, coalesce(j.ok, false) as keep
        from (select page_id, {_URL} as u from {pages}) p left join judged j on j.u = p.u"""


ORACLE = "with " + ", ".join([*_gram_steps("pages", f"unnest(generate_series(1, length(s) - {ORDER}))"), *_weight_steps(), f"raw as ({_RAW})", _verdict("pages")])


def score(pages: DataFrame) -> DataFrame:
    """page_id, url_score, keep for each row of pages.

    The n-gram counts and the URLs' scores are written tables, so that each is computed once and no plan holds the
    whole chain. Nothing is collected; AQE broadcasts the n-gram weights if they are small.
    """
    spark, view = pages.sparkSession, pages.select("page_id", "url")
    first = ", ".join(_gram_steps("{pages}", f"explode(sequence(1, length(s) - {ORDER}))"))
    top = written(spark.sql(f"with {first} select * from top", pages=view), "url-grams")
    weights = written(spark.sql(f"with {', '.join(s.replace('from top', 'from {top}') for s in _weight_steps())} select * from weights", top=top), "url-weights")
    raw = written(spark.sql(f"with {first} {_RAW.replace('weights', '{weights}')}", pages=view, weights=weights), "url-scores")
    return spark.sql("with " + _verdict("{pages}").replace("from raw", "from {raw}"), pages=view, raw=raw)


def op10_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/pages.parquet"))
