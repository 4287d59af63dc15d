"""The corpus pipeline: documents in, token ids out, each stage one operator of paperloom.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes as Parquet and reads again as the next stage's docs. All stages but the
last return the columns of documents, whatever these are called. Stages judge
rows and not ids: rows that share an id, or have none, are told apart by text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import decontamination, language_id, mixing, ngram_join, token_files
from paperloom.llm.workspace import Workspace, closing

#: SQL expresses neither the trained language model nor the tokenizer.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language the model rejects.

    Null and empty texts and those without a letter go; so do texts that no
    learned language explains. Without a labelled row nothing can be learned, and
    all rows go. Long texts are read whole; equal rows share their fate.
    """
    return language_id.accepted(spark, docs, language_id.train(docs, "doc_id", "text", "lang"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies: five-word shingles, similarity 0.8.

    The row of the smallest id stays, rows without id last; of rows that are equal
    in every column one. Texts without words are in no class and stay.
    """
    return ngram_join.deduplicate(spark, docs, words=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a benchmark passage stands, be their id null or repeated; null and empty texts stay."""
    return decontamination.clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents to the target weights of their sources, in random order.

    A null source is one source. Every row has a draw of its own; only rows equal in
    all columns share one.
    """
    return mixing.mix(spark, docs, numbered=False)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write Huffman-coded token files, read them back and return a digest of each document.

    Null texts count as empty, null ids come first; an empty table gives no rows.
    """
    path = Workspace(spark, "pipeline").path("tokens")
    token_files.write(spark, docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read(spark, path, digest=True)


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_files", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each on the table the stage before has written.

    What a stage leaves behind, and its input, go as soon as its result is written.
    """
    ws = Workspace(spark, "pipeline-stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        with closing():
            docs = ws.save(stage(spark, docs, sf_dir), f"{i}_{name}")
        if i:
            ws.drop(f"{i - 1}_{STAGES[i - 1][0]}")
    return docs
