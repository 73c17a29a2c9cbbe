"""Registered queries: scorer tiers, overrides, prompts, headings, signatures and metrics."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import gate as G
from tidemark.operators import rank as R
from tidemark.plans.page_queries import _COLLAPSED, _GATE, GATE, _gated
from tidemark.plans.registry import KEYWORD, query, table

_TWO = "printf('%.2f', rs)"
_FALLBACK = f"""case method when 'fast_discard' then 'too short (' || n || ' chars)' when 'keyword_fast_pass' then 'keyword_hits=' || h || ' (fast pass)'
    when 'llm_fallback' then 'llm_failed fallback rule_score=' || {_TWO} when 'llm_zero_hits_fallback' then 'llm@0hits failed fallback rule_score=' || {_TWO} else 'rule_score=' || {_TWO} end"""


def scripted(questions: list[str]) -> list[str | None]:
    """A scorer that answers by the number in the page's URL: keeps, refuses, mumbles, is silent, fails, says little."""
    out = []
    for q in questions:
        n = int(re.search(r"URL: u(\d+)", q)[1])
        if n % 6 == 4:
            raise RuntimeError(f"no answer for {n}" if len(questions) == 1 else "no answer")
        out.append(
            {
                0: "Well: " + json.dumps({"keep_page": True, "expand_links": False, "priority": "high", "relevance_score": 0.8, "reasons": "good"}),
                1: json.dumps({"keep_page": False, "expand_links": True, "relevance_score": 0.2, "reasons": ""}),
                2: "{broken",
                5: json.dumps({"keep_page": True, "relevance_score": 0.3}),
            }.get(n % 6)
        )
    return out


@query(
    f"""with {_GATE}, t as (select *, replace(method, '_fallback', '') as tier, case when method like '%_fallback' then doc_id % 6 else -1 end as k from gated),
    said as (select doc_id, case when k in (0, 5) then 'keep' when k in (1, 4) then 'discard' else decision end as decision,
        case when k = 0 then 'high' when k in (1, 5) then case tier when 'llm' then 'medium' else 'low' end when k = 4 then 'low' else priority end as priority,
        case k when 0 then 0.8 when 1 then 0.2 when 5 then 0.3 when 4 then 0.0 else relevance_score end as score, case when k in (0, 1, 5) then tier when k = 4 then 'error' else method end as method, k,
        case when k = 0 then 'good' when k in (1, 5) then 'llm judged (rule_score=' || {_TWO} || ')' when k = 4 then 'Evaluation error: no answer for ' || doc_id else {_FALLBACK} end as reasons from t)
    select doc_id, decision, k = 1 or (decision = 'keep' and (priority in ('high', 'medium') or score >= 0.45)) as expand, priority, round(score, 6) as relevance_score, method, reasons from said"""
)
def gate_scorer_tiers(spark, sf_dir):
    """The gate with a scorer that keeps, refuses, mumbles, is silent and fails."""
    d = table(spark, sf_dir, "documents")
    pages = d.select("doc_id", F.concat(F.lit("u"), "doc_id").alias("url"), F.col("text").alias("main_content"), F.array().cast("array<string>").alias("headings"), T.keyword_hits(F.col("text"), [KEYWORD]).alias("keyword_hits"))
    return G.gate(pages, GATE, scripted).select("doc_id", "decision", "expand", "priority", F.round("relevance_score", 6).alias("relevance_score"), "method", "reasons")


@query(
    f"""with {_GATE} select doc_id, case when doc_id % 5 = 0 then case when doc_id % 2 = 0 then 'keep' else decision end else decision end as decision,
    case when doc_id % 5 = 0 then 'urgent' else priority end as priority, case when doc_id % 5 = 0 then 'coordinated' else method end as method from gated"""
)
def decision_override(spark, sf_dir):
    g = _gated(spark, sf_dir)
    c = table(spark, sf_dir, "documents").where("doc_id % 3 != 1 or doc_id % 5 = 0").select(
        "doc_id", (F.col("doc_id") % 5 == 0).alias("should_override"), F.when(F.col("doc_id") % 2 == 0, "keep").alias("decision"), F.lit(None).cast("boolean").alias("expand"), F.lit("urgent").alias("priority"), F.lit("why").alias("reasons")
    )
    return G.override(g, c, "doc_id").select("doc_id", "decision", "priority", "method")


@query(
    rf"""select doc_id, md5(array_to_string(['Judge how relevant the page is to the keywords, by meaning rather than by wording, across languages.', 'Context ' || source, 'Keywords: the, of', 'URL: u' || doc_id, 'Title: ' || lang,
    E'Headings:\n- ' || source || E'\n- end', E'Text:\n' || case when length(text) <= 1400 then text else regexp_replace(substr(text, 1, 1400), ' [^ ]*$', '') || '...' end, 'Keyword hits: ' || (doc_id % 3),
    E'Links:\n- ' || substr(source || ' page number one of the collection here', 1, 40) || ': http://a/' || doc_id || E'\n- : http://b/',
    'Answer with JSON only: {{"keep_page": bool, "expand_links": bool, "priority": "high|medium|low", "relevance_score": 0..1, "reasons": text}}'], E'\n')) as prompt_hash from documents"""
)
def scorer_prompt(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    link = lambda text, url: F.struct(text.alias("text"), url.alias("url"))
    links = F.array(link(F.concat("source", F.lit(" page number one of the collection here")), F.concat(F.lit("http://a/"), "doc_id")), link(F.lit(None).cast("string"), F.lit("http://b/")))
    p = G.prompt(F.concat(F.lit("u"), "doc_id"), F.col("lang"), F.col("text"), F.array("source", F.lit("end")), F.col("doc_id") % 3, links, ["the", "of"], F.concat(F.lit("Context "), "source"))
    return d.select("doc_id", F.md5(p).alias("prompt_hash"))


_OUTLINE = "concat('# ', lang, chr(10), 'plain ', chr(10), '##  the ', source, '  ', chr(10), '####### seven', chr(10), '#none', chr(10), '### ', source)"


@query("select doc_id, lang || '|the ' || source || '|' || source as headings, 1 + case when contains(lower(source), 'the') then 1 else 0 end + case when contains(lower(lang), 'the') then 1 else 0 end as hits from documents")
def markdown_headings(spark, sf_dir):
    h = T.headings(F.expr(_OUTLINE))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(h, "|").alias("headings"), T.heading_hits(h, [KEYWORD]).alias("hits"))


@query(
    rf"""select doc_id, case when text is null or text = '' then 0.0 else round(0.4 * least(h, 1) + 0.3 * case when n > 3000 then 1.0 when n > 1000 then 0.7 when n > 500 then 0.5 else 0.2 end + 0.3 * met / 3.0, 3) end::double as rule_score
    from (select *, length(text) as n, len(regexp_extract_all(lower(text), '\bthe\b')) as h, 1 + case when contains(lower(source), 'the') then 1 else 0 end + case when contains(lower(lang), 'the') then 1 else 0 end as met from documents) x"""
)
def rule_score_with_headings(spark, sf_dir):
    heads = F.array("lang", F.concat(F.lit("the "), "source"), "source")
    return table(spark, sf_dir, "documents").select("doc_id", T.rule_score(F.col("text"), [KEYWORD], heads).alias("rule_score"))


@query(r"select doc_id, (len(regexp_extract_all(lower(text), '\bthe\b')) + len(regexp_extract_all(lower(text), '\bof\b')) + doc_id % 4)::int as hits, doc_id % 4 > 0 as matches from documents")
def keyword_hits_mixed(spark, sf_dir):
    """Several keywords, a Chinese and an empty one among them."""
    t = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.expr("repeat('算法好', cast(doc_id % 4 as int))"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.keyword_hits(t, ["the", "", "of", "算法"]).alias("hits"), T.keyword_match(t, "算法").alias("matches"))


@query("select doc_id, 'hash|tree' as signature, lang || source in ('', '||') as empty_context from documents where doc_id < 50")
def keyword_signature(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id < 50")
    return d.select("doc_id", F.lit(T.keyword_signature(["tree", "hash"])).alias("signature"), (T.context_signature(F.col("lang"), F.col("source")) == "").alias("empty_context"))


@query(
    """select doc_id, (length('need ' || source) > 10 and not contains(lower('need ' || source), 'site')) or (length(lang || ' topic') > 5 and lang <> 'en') as useful from documents"""
)
def context_usefulness(spark, sf_dir):
    """Reasons of over 10 characters and titles of over 5 count unless they hold a stop phrase."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.context_is_useful(F.concat("lang", F.lit(" topic")), F.concat(F.lit("need "), "source"), ["site", "EN topic"]).alias("useful"))


@query("select lang as step, count(*) as processed, count_if(n_chars >= 500) as success, count_if(n_chars < 500) as failed, sum(n_chars)::double as total_time from documents group by lang")
def step_metrics(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.col("lang").alias("step")).agg(*R.step_metrics(F.col("n_chars") >= 500, F.col("n_chars")))


@query(
    r"""select doc_id, case when fits then 'c' || doc_id || ' ' || lang end as kept from (select *, doc_id % 4 in (0, 1) as fits from documents) x"""
)
def fenced_markdown(spark, sf_dir):
    """Main text of Markdown: code, quotes and comments go."""
    md = F.concat(F.when(F.col("doc_id") % 4 == 1, "> quote\n<!-- c -->\n").otherwise(""), F.when(F.col("doc_id") % 4 > 1, "```py\n").otherwise("```\nx\n```\n"), F.lit("c"), "doc_id", F.lit(" "), "lang", F.lit("\n"))
    main = T.markdown_main_content(md)
    return table(spark, sf_dir, "documents").select("doc_id", F.nullif(main, F.lit("")).alias("kept"))


@query(rf"select doc_id, substr(regexp_replace(regexp_replace(lower(trim({_COLLAPSED})), ' +', '_', 'g'), '[^0-9a-zA-Z_\x{{4e00}}-\x{{9fff}}.-]+', '_', 'g'), 1, 120) as name from documents")
def safe_filename(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.safe_filename(F.col("text")).alias("name"))


@query("select doc_id, doc_id % 2 = 0 as keep_page, case when doc_id % 2 = 0 then lang end as reasons, true as unreadable from documents")
def json_replies(spark, sf_dir):
    """Objects inside chatter; what isn't JSON gives null."""
    from tidemark.schemas import REPLY

    d = table(spark, sf_dir, "documents")
    says = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.lit(True).alias("keep_page"), F.col("lang").alias("reasons")))).otherwise('{"keep_page": false}')
    r = T.json_object(F.concat(F.lit("so: "), says, F.lit(" end")), REPLY)
    broken = T.json_object(F.concat(F.lit("none at all "), "lang"), REPLY)
    return d.select("doc_id", r["keep_page"].alias("keep_page"), r["reasons"].alias("reasons"), broken["keep_page"].isNull().alias("unreadable"))
