"""The operators as named queries over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm import (
    bpe,
    chat,
    collocations,
    decontaminate,
    fill_middle,
    html_blocks,
    jaccard_join,
    pii,
    quality,
    simhash,
    substrings,
    syncmers,
    url_rules,
)

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.url_verdicts(table(spark, folder, "pages"))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.without_repeats(table(spark, folder, "documents"))


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(table(spark, folder, "documents"), VOCABULARY)


def as_tool_calls(conversations: DataFrame) -> DataFrame:
    """Conversations as transcripts of calls, so that turns can be linked.

    A user's turn is a call ``reply`` with the identifier ``t<turn>``, which
    comes after the conversation's first user turn; the assistant's turn that
    follows it is its result. Other turns stay plain messages.
    """
    opening = conversations.where("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("opening"))
    rows = conversations.select(*chat.KEYS).join(opening, "conv_id", "left")
    arguments = F.struct(F.col("text").alias("question"), F.col("turn").alias("turn"))
    call = F.struct(
        F.concat(F.lit("t"), F.col("turn")).alias("id"),
        F.lit("reply").alias("name"),
        arguments.alias("arguments"),
        F.when(F.col("turn") > F.col("opening"), F.array(F.concat(F.lit("t"), F.col("opening")))).alias("after"),
    )
    result = F.struct(F.concat(F.lit("t"), F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"),
        F.when(F.col("role") == "user", F.to_json(F.struct(F.array(call).alias("tool_calls"))))
        .when(F.col("role") == "assistant", F.to_json(result))
        .otherwise(F.col("text"))
        .alias("text"),
    )


def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    schemas = spark.createDataFrame(
        [("reply", "question", "string", True), ("reply", "turn", "integer", True)],
        "name string, parameter string, type string, required boolean",
    )
    return chat.formatted(as_tool_calls(table(spark, folder, "conversations")), schemas)


def op8_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.edited_fingerprints(table(spark, folder, "documents"))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_blocks.extracted(table(spark, folder, "pages"))


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, folder, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )


def op12_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar_sets(table(spark, folder, "documents"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_quality,
        op3_substring_dedup,
        op4_pii,
        op5_simhash,
        op6_bpe,
        op7_chat,
        op8_syncmers,
        op9_decontamination,
        op10_html,
        op11_fill_in_middle,
        op12_jaccard_join,
        op13_collocations,
    )
}
