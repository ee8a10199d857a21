"""The corpus pipeline: stages over `documents`, each written before the next.

All stages take empty tables, null columns, very long texts and extra columns
of any name; all but the last keep the columns of their input.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlab.llm import decontaminate, language_id, line_runs, near_dedup, piece_sampling
from gridlab.llm.common import run_folder, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. The model is learned from the
    documents' own known languages. Null, empty and letterless texts have none
    and go; equal texts share their fate; repeated rows stay as often as they
    came; null columns other than text do not matter."""
    predict = language_id.predictor(spark, language_id.fit(docs))
    return docs.where(~predict("text").rejected)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; no row goes.
    Null and empty texts are one empty line; a line that several documents hold
    stays in the smallest doc_id, rows without one come last; rows that repeat a
    doc_id are one document, and all of them keep its lines."""
    return line_runs.replace_text(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, from a similarity of 0.8. The
    bands find a link at 0.8 with probability over 0.9999995. The smallest
    doc_id of a group stays, and of rows that repeat it the one with the smallest
    text; empty texts are groups of their own."""
    return near_dedup.one_of_each(docs, percent=80, bands=37)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark. Null and empty texts
    hold none; every row is judged by itself, so copies share their fate; an
    empty benchmark removes nothing."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, pieces_sha256, lossless and pieces of each document.
    Null and empty texts have no pieces; equal rows get equal pieces; rows
    without a doc_id are keyed by their text."""
    return piece_sampling.sampled_pieces(docs)


STAGES = [("language ID", language), ("line dedup", line_dedup), ("near-dedup", near_dedup_stage),
          ("benchmark decontamination", decontamination), ("SentencePiece sampling", pieces)]

#: Language ID, MinHash and sampled segmentation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to `documents`; every stage's rows are written to the
    shared folder and read again by the next one."""
    folder = run_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{k}")
    return docs
