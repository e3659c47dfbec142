"""Queries and oracles of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from tabulon.llm.bloomlm import op6_bloom_lm
from tabulon.llm.chat import OP9_SQL, op9_chat_trees
from tabulon.llm.exactdedup import OP5_SQL, op5_exact_dedup
from tabulon.llm.html_extract import op4_html_main
from tabulon.llm.mixing import OP3_SQL, op3_source_mix
from tabulon.llm.piece_dropout import op1_piece_dropout
from tabulon.llm.quality import OP10_SQL, op10_quality_rules
from tabulon.llm.secret_scan import op7_secret_scan
from tabulon.llm.simhash import op8_simhash
from tabulon.llm.toxicity import op2_toxicity

QUERIES = {"pipeline": corpus_pipeline.run, "op4_html_main": op4_html_main, "op2_toxicity": op2_toxicity, "op1_piece_dropout": op1_piece_dropout, "op7_secret_scan": op7_secret_scan, "op6_bloom_lm": op6_bloom_lm, "op8_simhash": op8_simhash, "op9_chat_trees": op9_chat_trees, "op3_source_mix": op3_source_mix, "op5_exact_dedup": op5_exact_dedup, "op10_quality_rules": op10_quality_rules}
ORACLES = {"op9_chat_trees": OP9_SQL, "op3_source_mix": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op10_quality_rules": OP10_SQL}
