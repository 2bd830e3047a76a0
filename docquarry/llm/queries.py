"""The queries of this subpackage: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf_html, divergence, kneser_ney, line_dedup, ngram_join, pu_toxicity, templates, token_store, transducer, tree_bpe

from .scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that link by their 3-word shingles at 90 per cent."""
    return ngram_join.link_documents(table(spark, sf_dir, "documents"), 3, 90, Scratch(spark, "ngrams"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids in patched frame-of-reference files, read back."""
    return token_store.token_output(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all texts, learned from the rows that are not held out."""
    documents, held_out = table(spark, sf_dir, "documents"), lambda c: kneser_ney.crc32_remainder(c, 3) == 1
    classifier = pu_toxicity.train(documents, table(spark, sf_dir, "labels"), lambda c: ~held_out(c))
    return pu_toxicity.score(documents, classifier).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts scored by a Kneser-Ney bigram model of the documents that are not held out."""
    return kneser_ney.score(table(spark, sf_dir, "documents"), kneser_ney.crc32_remainder(F.col("doc_id"), 7) == 2)


def op5_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE by monoid tree reduction, decoded again."""
    return tree_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), digest=True)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeat or nearly repeat an earlier line, with the line that is kept."""
    return line_dedup.duplicate_lines(table(spark, sf_dir, "documents"), Scratch(spark, "lines")).drop("row")


def op7_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict by divergence from the languages' references."""
    documents = table(spark, sf_dir, "documents")
    return divergence.judge(documents, divergence.learn(documents))


def op8_crf_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of pages by a linear-chain conditional random field."""
    return crf_html.extract(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts by a compiled transducer."""
    return transducer.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in documents, by templates."""
    return templates.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_token_output": op2_token_output,
        "op3_toxicity": op3_toxicity,
        "op4_kneser_ney": op4_kneser_ney,
        "op5_tree_bpe": op5_tree_bpe,
        "op6_line_dedup": op6_line_dedup,
        "op7_divergence": op7_divergence,
        "op8_crf_html": op8_crf_html,
        "op9_token_counts": op9_token_counts,
        "op10_templates": op10_templates,
    }


def oracle_sql() -> dict[str, str]:
    return {}
