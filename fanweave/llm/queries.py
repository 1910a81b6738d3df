"""The registered queries of the training-data operators: thin wrappers that apply an operator to
its whole table and derive the digest columns of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanweave.llm import (
    chat, ctph, decontaminate, langid, piece_transducer, prefix_trie, quality, repeats, simhash,
    token_archive, toxicity, warc, whitening)
from fanweave.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"),
                                    table(spark, sf_dir, "labels"))


def op2_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, archived in ascending doc_id order, and read back."""
    return token_archive.archive_documents(
        table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_report(table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations plus conversation -7, formatted, written and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.sql(
        "select cast(-7 as bigint) conv_id, cast(turn as bigint) turn, role, :probe as text "
        "from values (0, 'user'), (1, 'assistant') as t(turn, role)", args={"probe": probe})
    done = chat.formatted_conversations(rows.unionByName(extra))
    done = done.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"),
                       F.array_join(chat.masked_texts(F.col("formatted"), F.col("loss_mask")), "")
                       .alias("loss"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlap_report(table(spark, sf_dir, "documents"),
                                        table(spark, sf_dir, "benchmark"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.fingerprint_report(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.component_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived as a WARC record and read back."""
    return warc.archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document, decoded again."""
    return piece_transducer.encode_documents(table(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"),
                                   table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return prefix_trie.node_report(
        table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_archive": op2_token_archive,
    "op3_language_id": op3_language_id,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_simhash": op8_simhash,
    "op9_warc": op9_warc,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_quality": op11_quality,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_whitening": op13_whitening,
}
