"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from tidemark.llm import jaccard_join, substring_dedup, url_language_model
from tidemark.llm.bpe_codec import op6_bpe_codec
from tidemark.llm.hash_neighbours import op7_hash_neighbours
from tidemark.llm.jaccard_join import op5_jaccard_join
from tidemark.llm.license_scan import op4_license_scan
from tidemark.llm.quality_classifier import op8_quality_classifier
from tidemark.llm.source_mixing import op1_source_mixing
from tidemark.llm.substring_dedup import op9_substring_dedup
from tidemark.llm.suffix_repetition import op2_suffix_repetition
from tidemark.llm.toxicity_grammar import op3_toxicity_grammar
from tidemark.llm.url_language_model import op10_url_language_model

QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mixing,
        op2_suffix_repetition,
        op3_toxicity_grammar,
        op4_license_scan,
        op5_jaccard_join,
        op6_bpe_codec,
        op7_hash_neighbours,
        op8_quality_classifier,
        op9_substring_dedup,
        op10_url_language_model,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op5_jaccard_join": jaccard_join.ORACLE,
    "op9_substring_dedup": substring_dedup.ORACLE,
    "op10_url_language_model": url_language_model.ORACLE,
}
