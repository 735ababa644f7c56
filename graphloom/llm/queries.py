"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import licences, masked_lm, minhash, packing, page_text, pivot_search, positional_index, run_length_index, suffix_automaton, toxicity
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_benchmark_decontamination": positional_index.op2,
    "op3_minhash_near_dedup": minhash.op3,
    "op4_lm_scoring": masked_lm.op4,
    "op5_substring_dedup": suffix_automaton.op5,
    "op6_licence_scan": licences.op6,
    "op7_exact_top_k": pivot_search.op7,
    "op8_packing": packing.op8,
    "op9_suffix_array_dedup": run_length_index.op9,
    "op10_html_extraction": page_text.op10,
}


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
