"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import html_content, licenses, line_crf, mixing, near_dup, packing, quality_rules, sharding, surrogates, topk, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dup": near_dup.op1_minhash_near_dup,
    "op2_surrogate_pii": surrogates.op2_surrogate_pii,
    "op3_rendezvous_shards": sharding.op3_rendezvous_shards,
    "op4_impact_ordered_topk": topk.op4_impact_ordered_topk,
    "op5_license_paragraphs": licenses.op5_license_paragraphs,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_line_crf_quality": line_crf.op7_line_crf_quality,
    "op8_dictionary_warc": warc.op8_dictionary_warc,
    "op9_risk_controlled_rules": quality_rules.op9_risk_controlled_rules,
    "op10_pack_documents": packing.op10_pack_documents,
    "op11_tree_html_text": html_content.op11_tree_html_text,
    "op12_exact_whitening": whitening.op12_exact_whitening,
}

ORACLES: dict[str, str] = {"op11_tree_html_text": html_content.ORACLE, "op3_rendezvous_shards": sharding.ORACLE, "op4_impact_ordered_topk": topk.ORACLE, "op8_dictionary_warc": warc.ORACLE, "op9_risk_controlled_rules": quality_rules.ORACLE}
