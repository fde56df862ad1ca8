"""Queries op1..op10 and the pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm import oracles
from tidemark.llm.decontaminate import op3_decontaminate
from tidemark.llm.html_extract import op8_html_extract
from tidemark.llm.language_id import op9_language_id
from tidemark.llm.length_buckets import op7_length_buckets
from tidemark.llm.ngram_join import op5_ngram_jaccard
from tidemark.llm.quality import op1_quality
from tidemark.llm.secret_scan import op4_secret_scan
from tidemark.llm.substring_dedup import op10_substring_dedup
from tidemark.llm.token_counts import op6_token_counts
from tidemark.llm.token_packing import op2_token_packing

QUERIES = {
    "op1_quality": op1_quality,
    "op2_token_packing": op2_token_packing,
    "op3_decontaminate": op3_decontaminate,
    "op4_secret_scan": op4_secret_scan,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_token_counts": op6_token_counts,
    "op7_length_buckets": op7_length_buckets,
    "op8_html_extract": op8_html_extract,
    "op9_language_id": op9_language_id,
    "op10_substring_dedup": op10_substring_dedup,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_quality": oracles.OP1.strip(),
    "op3_decontaminate": oracles.OP3.strip(),
    "op4_secret_scan": oracles.OP4.strip(),
    "op5_ngram_jaccard": oracles.OP5.strip(),
    "op10_substring_dedup": oracles.OP10.strip(),
}
