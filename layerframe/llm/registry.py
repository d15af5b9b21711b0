"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import codec, language_id, line_dedup, mixing, ngram_join, quality_model, quality_rules, search, token_file, url_filter

QUERIES = {
    "op1_token_files": token_file.query,
    "op2_mix_sources": mixing.query,
    "op3_quality_rules": quality_rules.query,
    "op4_language_id": language_id.query,
    "op5_ngram_join": ngram_join.query,
    "op6_bm25_search": search.query,
    "op7_quality_model": quality_model.query,
    "op8_line_dedup": line_dedup.query,
    "op9_bpe_codec": codec.query,
    "op10_url_filter": url_filter.query,
}
ORACLES = {
    "op2_mix_sources": mixing.ORACLE,
    "op3_quality_rules": quality_rules.ORACLE,
    "op5_ngram_join": ngram_join.ORACLE,
    "op6_bm25_search": search.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
}
