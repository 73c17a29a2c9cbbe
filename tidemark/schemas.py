"""Row types."""

from __future__ import annotations

SLIDES = "input_file string, total_pages int, should_optimize_count int, teaching_chain string, decisions array<struct<slide_number: int, title: string, should_optimize: boolean, reason: string, suggested_keywords: array<string>, optimization_strategy: string>>"
SEED_CATALOG = "preset_urls map<string, struct<name: string, urls: array<string>, status: string, last_updated: string, maintainer: string, description: string>>, meta struct<version: string, last_updated: string, total_types: int, pending_review: int, notes: string>"
RAW_PAGE = "url string, html string, markdown string, clean_content string, title string, status_code int, error string, timestamp string"
LINK = "struct<url: string, text: string, title: string>"
EXTRACTED = f"data_id string, url string, depth int, title string, main_content string, headings array<string>, keyword_hits int, content_hash string, text_snippet string, extracted_links array<{LINK}>, extracted_links_count int, domain string"
PAGE_RECORD = "url string, depth int, domain string, title string, keyword_hits int, content_hash string, text_snippet string, extracted_links_count int, headings array<string>, decision string, priority string, reasons string, relevance_score double, expand boolean, main_content string"
REPLY = "keep_page boolean, expand_links boolean, priority string, relevance_score double, reasons string"
RECALL = "results array<struct<keyword: string, language: string, ranked_candidates: array<struct<url: string, score: int, sources: array<string>>>>>"
