"""The registered queries of the operators: each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from echosieve.llm import (
    alignment, chat, decontaminate, html_extract, licenses, line_dedup, near_dedup, order_minhash,
    packing, quality, repair, url_filter, warc,
)
from echosieve.workspace import Workspace

#: Fixed values of the url query: (host, path, verdict).
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

#: Arguments of the tool that chat turns are taken for.
CHAT_SCHEMAS = {"reply": {"prompt": ("string", True), "words": ("integer", True)}}

#: The vocabulary of byte_bpe_50k.json as ranks, for the faster of the two libraries.
PACKING_RANKS = "byte_bpe_50k.tiktoken"

#: The two vocabularies that are aligned.
ALIGNED_A, ALIGNED_B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(_table(spark, sf_dir, "documents"), Workspace(spark)).select(
        "doc_id", "source", "text", "n_chars", "n_lines", "n_dropped"
    )


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_fingerprints(
        _table(spark, sf_dir, "documents"), Workspace(spark)
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), Workspace(spark)
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(_table(spark, sf_dir, "pages"), Workspace(spark))
    return warc.read_archives(archives).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok"
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), Workspace(spark)
    ).select("doc_id", "junk_score", "toxic_score", "accepted")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = chat.exchanges(_table(spark, sf_dir, "conversations"))
    return chat.link_tools(messages, CHAT_SCHEMAS, Workspace(spark))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(
        _table(spark, sf_dir, "documents"), Workspace(spark), tokenizer_path(PACKING_RANKS)
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), rules)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), Workspace(spark))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(
        _table(spark, sf_dir, "documents"), licenses.templates(spark), Workspace(spark)
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_conversations(
        _table(spark, sf_dir, "conversations"), Workspace(spark)
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(
        _table(spark, sf_dir, "documents"), Workspace(spark), tokenizer_path(ALIGNED_A),
        tokenizer_path(ALIGNED_B),
    )


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_line_dedup, op2_order_minhash, op3_decontaminate, op4_warc, op5_quality_classifier,
        op6_html_extraction, op7_tool_calls, op8_best_fit_packing, op9_url_filter,
        op10_near_dedup, op11_license_scan, op12_conversation_repair, op13_token_alignment,
    ]
    return {f.__name__: f for f in named}
