"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.llm import decontaminate, language, lines, minhash, negatives, resample, secrets, sentencepieces, simhash, spans, suffixes, topk, urlfilter
from pagemill.llm.common import table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

URL_RULES = [  # verdict, host, path
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(table(spark, sf_dir, "documents"), PIECES)


def held_out():
    """crc32 of the id as text leaves 0 when divided by 5. Rows without an id are held out, too."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def language_model(documents: DataFrame) -> language.Crf:
    return language.train(documents.where(~held_out()))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = language.predict(documents, language_model(documents))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.scaled(table(spark, sf_dir, "embeddings"), 64)
    return topk.top_k(vectors.where(F.col("vec_id") % 20 == 0), vectors, 20)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, secrets.KINDS), F.sha2(F.col("base_joined").cast("binary"), 256).alias("base_sha256"),
        F.col("all_joined").alias("spans"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"), window=100)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.with_counts(table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce("row.text", F.lit("")).cast("binary"), 256)
    return found.select("row.doc_id", "n_lines", "n_removed", kept.alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "passages", F.col("question_overlap").alias("overlap"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=5, threshold=0.85)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"), anchor_every=100, positives=5, negatives=5, scale=256.0)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=0.25,
                             order=2, buckets=10000, seed=7, least_words=20)


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language_id": op2_language_id,
    "op3_top_k": op3_top_k,
    "op4_secret_scan": op4_secret_scan,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_simhash": op7_simhash,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_url_filter": op10_url_filter,
    "op11_minhash": op11_minhash,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_resample": op13_resample,
}
