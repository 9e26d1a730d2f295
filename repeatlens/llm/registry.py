"""The registered queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from repeatlens.llm import (bpe, conversation_repair, decontam, license_scan, line_dedup, near_dup,
                            para_dedup, prefix_trie, quality, secrets, toxicity, url_filter, warc)

_QUERIES = [
    bpe.op1_bpe_codec, para_dedup.op2_substring_dedup, warc.op3_warc_archives,
    license_scan.op4_license_scans, secrets.op5_secret_scans,
    url_filter.op6_url_filters, toxicity.op7_toxicity, decontam.op8_benchmark_decontamination,
    quality.op9_quality_rules, near_dup.op10_minhash_near_dedup,
    line_dedup.op11_line_dedup, prefix_trie.op12_conversation_prefix_trie,
    conversation_repair.op13_conversation_repair,
]
_ORACLES = {
    "op3_warc_archives": warc.oracle(),
    "op5_secret_scans": secrets.oracle(), "op6_url_filters": url_filter.oracle(),
    "op9_quality_rules": quality.oracle(), "op11_line_dedup": line_dedup.oracle(),
    "op12_conversation_prefix_trie": prefix_trie.oracle(),
    "op13_conversation_repair": conversation_repair.oracle(),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
