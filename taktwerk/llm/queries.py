"""The registered queries of the corpus operators: thin, with production parameters, over whole tables.

Where the last step runs Python on long texts, the query writes its few columns to the shared folder and returns that
table: the step runs in small batches, and the session keeps its own setting.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from taktwerk.llm import bpe, common, conversation_repair, decontaminate, filter_audit, jaccard_join, language, licenses, line_rules, nearest, passages, quality, sql, toxicity, warc


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.save(bpe.digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")), "op3")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full payload digests and lengths as the archives' records carry them; a response's are checked against its body."""
    read = warc.archive_and_read(common.table(spark, sf_dir, "pages"))
    return common.save(read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "op10")


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.verdicts(common.table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.drop("hit_spans")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(common.table(spark, sf_dir, "documents"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(common.table(spark, sf_dir, "documents"))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.save(language.identify(common.table(spark, sf_dir, "documents")), "op1")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.save(toxicity.graded(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")), "op5")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.posteriors(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = common.table(spark, sf_dir, "conversations")
    return conversation_repair.repaired(conversations, conversation_repair.damaged(conversations))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(common.table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_byte_bpe": op3_byte_bpe, "op10_warc": op10_warc, "op4_line_frequency": op4_line_frequency, "op2_decontaminate": op2_decontaminate, "op8_jaccard_join": op8_jaccard_join, "op6_passages": op6_passages, "op1_language": op1_language, "op5_toxicity": op5_toxicity, "op7_licenses": op7_licenses, "op9_quality": op9_quality, "op11_filter_audit": op11_filter_audit, "op12_conversation_repair": op12_conversation_repair, "op13_nearest": op13_nearest}

#: DuckDB statements for the same rows, where SQL can express them on whole tables.
ORACLE_SQL: dict[str, str] = {"op2_decontaminate": sql.OP2, "op4_line_frequency": sql.OP4, "op7_licenses": sql.OP7, "op8_jaccard_join": sql.OP8, "op11_filter_audit": sql.OP11}
