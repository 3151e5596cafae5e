"""From the documents table to token ids: five stages, each one operator of ``pagemill.llm``.

Each stage takes (spark, docs, sf_dir) and gives the rows it keeps; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.llm import decontaminate, language, lines, sentencepieces, simhash
from pagemill.llm.common import table
from pagemill.llm.jobs import PIECES, language_model
from pagemill.session import stored

ORACLE_SQL = None  # a conditional random field is not SQL


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts in no language: no letter in them, or no language with a share of three tenths."""
    return language.reject(docs, language_model(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without repeated lines. A document of which no word is left goes; n_chars follows the text."""
    found = lines.with_counts(docs).where((F.col("n_removed") == 0) | F.col("row.text").rlike(r"\S"))
    length = F.when(F.col("n_removed") > 0, F.length("row.text").cast("long")).otherwise(F.col("row.n_chars"))
    return found.select(*[length.alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of the SimHash operator: three-word shingles, two bits or fewer apart."""
    return simhash.keep_first(docs, width=3, radius=2)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (with begin and end ids), n_tokens, decoded_sha256."""
    return sentencepieces.encoded_and_decoded(docs, PIECES)


STAGES = [
    ("language", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate_documents),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what each keeps is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
