"""Registered queries of the llm operators, with production parameters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chunk_dedup, decontaminate, fill_in_middle, html_blocks, language_id, line_runs, near_dedup, piece_sampling,
               quality_nbsvm, quality_rules, simhash_trees, spelling_groups, url_reputation)
from .common import table


def _fold(parts: int) -> Column:
    """crc32 of the doc_id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def op1_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scores = quality_nbsvm.quality_scores(docs, labels.where(_fold(5) != 0))
    return scores.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predict = language_id.predictor(spark, language_id.fit(docs.where(_fold(4) != 2)))
    return docs.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), predict("text").alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def op3_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.sampled_pieces(table(spark, sf_dir, "documents"), keep_pieces=False)


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one holds."""
    return chunk_dedup.kept_texts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_passages", "n_words", F.sha2("kept_text", 256).alias("kept_sha256"), "first_ids")


def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.main_texts(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rule_results(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "n_failed_lines", "kept_chars", "kept")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the quality label of the document that a page's url names by
    its number."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    number = F.regexp_extract("url", r"://[^/?#]*/[^?#]*?(\d+)", 1).try_cast("long")
    outcomes = pages.select("url", number.alias("doc_id")).join(labels, "doc_id").select("url", F.col("quality").alias("good"))
    def grid(c: str) -> Column:
        return (F.floor(F.col(c) * 2.0**20 + 0.5) / 2.0**20).alias(f"good_{c}")

    return url_reputation.judge_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict", "level", grid("mean"), grid("upper"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"), keep_output=False)


def op12_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trees.simhash_duplicates(table(spark, sf_dir, "documents"))


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.spelling_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_nbsvm, op2_language_id, op3_piece_sampling, op4_chunk_dedup, op5_html_blocks,
                            op6_line_dedup, op7_decontaminate, op8_quality_rules, op9_near_dedup, op10_url_reputation, op11_fill_in_middle,
                            op12_simhash_trees, op13_spelling_groups)
}
