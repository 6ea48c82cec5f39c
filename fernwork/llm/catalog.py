"""Registered queries of the subpackage and the DuckDB texts of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from fernwork.plans.scale import tune

from . import decontaminate, langid, lexical, linededup, linefreq, maintext, mixing, pii, simhash, topk, toxicity, trie, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": linededup.op1,
    "op2_benchmark_decontamination": decontaminate.op2,
    "op3_exact_top_k": topk.op3,
    "op4_simhash_near_dedup": simhash.op4,
    "op5_source_mixing": mixing.op5,
    "op6_language_id": langid.op6,
    "op7_url_filter": urlfilter.op7,
    "op8_toxicity_severity": toxicity.op8,
    "op9_pii_surrogates": pii.op9,
    "op10_main_text": maintext.op10,
    "op11_line_frequency": linefreq.op11,
    "op12_prefix_trie": trie.op12,
    "op13_ranked_search": lexical.op13,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": linededup.ORACLE,
    "op2_benchmark_decontamination": decontaminate.ORACLE,
    "op3_exact_top_k": topk.ORACLE,
    "op5_source_mixing": mixing.ORACLE,
    "op7_url_filter": urlfilter.ORACLE,
    "op11_line_frequency": linefreq.ORACLE,
    "op12_prefix_trie": trie.ORACLE,
    "op13_ranked_search": lexical.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(fn):
        return lambda spark, sf_dir: fn(tune(spark), sf_dir)

    return {name: runner(fn) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
