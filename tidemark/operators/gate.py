"""Quality gate: cheap rules first, an optional scorer for what they leave open."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.schemas import REPLY
from tidemark.tables import written

VERDICT = ("decision", "expand", "priority", "reasons", "relevance_score", "method")
#: Columns without which a page can't be judged.
REQUIRED = ("main_content", "keyword_hits", "headings")


@dataclass(frozen=True)
class GateConfig:
    keywords: Sequence[str] = field(default_factory=tuple)
    threshold: float = 0.35
    discard_below: int = 80
    pass_from: int = 3
    enable_expand: bool = True
    expand_from: float = 0.45
    scorer_enabled: bool = True
    scorer_on_zero_hits: bool = True
    zero_hits_rule_score: float = 0.15
    zero_hits_chars: int = 250


def should_expand(decision: Column, priority: Column, score: Column, config: GateConfig) -> Column:
    return F.lit(config.enable_expand) & (decision == "keep") & (priority.isin("high", "medium") | (score >= config.expand_from))


def _tiers(text: Column, hits: Column, rule: Column, config: GateConfig) -> Column:
    """The tier of a page; scorer tiers are those a scorer would see."""
    n = F.length(F.coalesce(text, F.lit("")))
    tier = F.when(n < config.discard_below, "fast_discard").when(hits >= config.pass_from, "keyword_fast_pass")
    if config.scorer_enabled:
        tier = tier.when(hits > 0, "llm")
        if config.scorer_on_zero_hits:
            tier = tier.when((hits == 0) & (rule >= config.zero_hits_rule_score) & (n >= config.zero_hits_chars), "llm_zero_hits")
    return tier.otherwise("rule_based")


def _by_rules(tier: Column, hits: Column, n: Column, rule: Column, config: GateConfig) -> dict[str, Column]:
    keep = rule >= config.threshold
    decision = F.when(tier == "fast_discard", "discard").when(tier == "keyword_fast_pass", "keep").otherwise(F.when(keep, "keep").otherwise("discard"))
    priority = (
        F.when(tier == "keyword_fast_pass", "high")
        .when((tier == "llm") & keep, "medium")
        .when((tier == "rule_based") & (rule >= 0.6), "medium")
        .otherwise("low")
    )
    score = F.when(tier == "fast_discard", 0.0).when(tier == "keyword_fast_pass", F.least(F.lit(0.92), F.lit(0.35) + hits * F.lit(0.10))).otherwise(rule)
    method = F.when(tier == "llm", "llm_fallback").when(tier == "llm_zero_hits", "llm_zero_hits_fallback").otherwise(tier)
    two = F.format_string("%.2f", rule)
    reasons = (
        F.when(tier == "fast_discard", F.format_string("too short (%d chars)", n))
        .when(tier == "keyword_fast_pass", F.format_string("keyword_hits=%d (fast pass)", hits))
        .when(tier == "llm", F.concat(F.lit("llm_failed fallback rule_score="), two))
        .when(tier == "llm_zero_hits", F.concat(F.lit("llm@0hits failed fallback rule_score="), two))
        .otherwise(F.concat(F.lit("rule_score="), two))
    )
    return {"decision": decision, "priority": priority, "relevance_score": score, "method": method, "reasons": reasons}


def prompt(url: Column, title: Column, text: Column, heads: Column, hits: Column, links: Column, keywords: Sequence[str], context: Column | None = None) -> Column:
    """What a scorer is asked: page, at most 10 headings, 1400 characters, 8 links and 8 keywords."""
    bullet = lambda items: F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise("(none)")
    shown = F.transform(F.slice(links, 1, 8), lambda x: F.concat(F.substring(F.coalesce(x["text"], F.lit("")), 1, 40), F.lit(": "), x["url"]))
    return F.concat_ws(
        "\n",
        F.lit("Judge how relevant the page is to the keywords, by meaning rather than by wording, across languages."),
        context if context is not None else F.lit(None).cast("string"),
        F.lit("Keywords: " + ", ".join(list(keywords)[:8])),
        F.concat(F.lit("URL: "), url),
        F.concat(F.lit("Title: "), F.coalesce(title, F.lit(""))),
        F.concat(F.lit("Headings:\n"), bullet(F.slice(heads, 1, 10))),
        F.concat(F.lit("Text:\n"), T.truncate(text, 1400)),
        F.concat(F.lit("Keyword hits: "), hits.cast("string")),
        F.concat(F.lit("Links:\n"), bullet(shown)),
        F.lit('Answer with JSON only: {"keep_page": bool, "expand_links": bool, "priority": "high|medium|low", "relevance_score": 0..1, "reasons": text}'),
    )


def ask(pages: DataFrame, scorer: Callable[[list[str]], list[str | None]], question: str = "_prompt") -> DataFrame:
    """pages with columns _reply and _error: the scorer's raw answers, batch by batch.

    If it raises on a batch, its questions are asked one by one; a question on which it raises again, or batches
    with another number of answers than questions, have an error in place of a reply.
    """
    at = pages.columns.index(question)

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            return scorer([text])[0], None
        except Exception as e:
            return None, str(e) or type(e).__name__

    def answers(texts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            replies = list(scorer(texts))
        except Exception:
            return [one(t) for t in texts]
        if len(replies) != len(texts):
            return [(None, f"{len(replies)} replies to {len(texts)} questions")] * len(texts)
        return [(r if r is None or isinstance(r, str) else str(r), None) for r in replies]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = answers(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x[k] for x in said], pa.string()) for k in (0, 1))], [*b.schema.names, "_reply", "_error"])

    none = F.lit(None).cast("string")
    return pages.mapInArrow(run, pages.select("*", none.alias("_reply"), none.alias("_error")).schema)


def can_gate(pages: DataFrame) -> bool:
    """Whether the table has what the gate reads."""
    return set(REQUIRED) <= set(pages.columns)


def gate(pages: DataFrame, config: GateConfig, scorer: Callable[[list[str]], list[str | None]] | None = None, context: Column | None = None) -> DataFrame:
    """pages (main_content, headings, keyword_hits, ...) with decision, expand, priority, reasons, relevance_score, method.

    Without a scorer its tiers fall back on rules. With one, only the rows of those tiers reach it: they are split
    off by a filter, asked, and united with the rest (a UDF under CASE WHEN would see all rows). Replies are written
    at once, so that no question is asked twice. Where the scorer fails the row is discarded by method "error"; a
    reply that can't be read leaves the row to the rules.
    """
    if not can_gate(pages):
        raise ValueError("the gate needs the columns " + ", ".join(c for c in REQUIRED if c not in pages.columns))
    text, hits = F.col("main_content"), F.col("keyword_hits")
    p = pages.withColumn("_rule", T.rule_score(text, config.keywords, F.col("headings")))
    p = p.withColumn("_tier", _tiers(text, hits, F.col("_rule"), config))
    n = F.length(F.coalesce(text, F.lit("")))

    def ruled(df: DataFrame) -> DataFrame:
        df = df.withColumns(_by_rules(F.col("_tier"), hits, n, F.col("_rule"), config))
        return df.withColumn("expand", should_expand(F.col("decision"), F.col("priority"), F.col("relevance_score"), config))

    columns = [*(c for c in pages.columns if c not in VERDICT), *VERDICT]
    if scorer is None:
        return ruled(p).select(columns)
    asked = p.where(F.col("_tier").isin("llm", "llm_zero_hits"))
    links = F.col("extracted_links") if "extracted_links" in pages.columns else F.array().cast("array<struct<url: string, text: string>>")
    title = F.col("title") if "title" in pages.columns else F.lit("")
    url = F.col("url") if "url" in pages.columns else F.lit("")
    asked = ask(asked.withColumn("_prompt", prompt(url, title, text, F.col("headings"), hits, links, config.keywords, context)), scorer)
    said = written(asked.withColumn("_r", T.json_object(F.col("_reply"), REPLY)).drop("_prompt", "_reply"), "gate-replies")
    said = said.withColumn("_ok", F.col("_r").isNotNull() & F.col("_r.keep_page").isNotNull())
    failed = said.where("_error is not null").withColumns(
        {"decision": F.lit("discard"), "expand": F.lit(False), "priority": F.lit("low"), "reasons": F.concat(F.lit("Evaluation error: "), F.col("_error")), "relevance_score": F.lit(0.0), "method": F.lit("error")}
    )
    fallback = ruled(said.where("_error is null and not _ok"))
    good = said.where("_error is null and _ok").withColumns(
        {
            "decision": F.when(F.col("_r.keep_page"), "keep").otherwise("discard"),
            "priority": F.coalesce(F.col("_r.priority"), F.when(F.col("_tier") == "llm", "medium").otherwise("low")),
            "relevance_score": F.coalesce(F.col("_r.relevance_score"), F.lit(0.0)),
            "method": F.col("_tier"),
            "reasons": F.when(F.coalesce(F.col("_r.reasons"), F.lit("")) != "", F.col("_r.reasons")).otherwise(F.concat(F.lit("llm judged (rule_score="), F.format_string("%.2f", F.col("_rule")), F.lit(")"))),
        }
    )
    good = good.withColumn("expand", F.coalesce(F.col("_r.expand_links"), F.lit(False)) | should_expand(F.col("decision"), F.col("priority"), F.col("relevance_score"), config))
    rest = ruled(p.where(~F.col("_tier").isin("llm", "llm_zero_hits")))
    return rest.select(columns).unionByName(fallback.select(columns)).unionByName(good.select(columns)).unionByName(failed.select(columns))


def override(gated: DataFrame, coordination: DataFrame, key: str) -> DataFrame:
    """Decisions of a coordinator replace those of the gate where should_override is set."""
    c = coordination.select(key, *(F.col(x).alias(f"_{x}") for x in ("should_override", "decision", "expand", "priority", "reasons")))
    on = F.coalesce(F.col("_should_override"), F.lit(False))
    j = gated.join(c, key, "left")
    for x in ("decision", "expand", "priority", "reasons"):
        j = j.withColumn(x, F.when(on, F.coalesce(F.col(f"_{x}"), F.col(x))).otherwise(F.col(x)))
    return j.withColumn("method", F.when(on, "coordinated").otherwise(F.col("method"))).select(gated.columns)
