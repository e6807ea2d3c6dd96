"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.tokens import decode_corpus, encode_corpus, tokenizer_file
from scorelake.session import read


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(read(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_file("byte_bpe_50k"))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text encoded and decoded again."""
    return decode_corpus(p8_ids(spark, sf_dir), tokenizer_file("byte_bpe_50k")).select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


QUERIES = {"p8_ids": p8_ids, "p8_round_trip": p8_round_trip}

ORACLES = {
    "p8_round_trip": "select doc_id, cast(length(coalesce(text, '')) as bigint) as n_chars, md5(coalesce(text, '')) as text_md5 from documents",
}
