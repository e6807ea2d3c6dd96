"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.broken_pairs import broken_pairs
from scorelake.session import read


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs(read(spark, sf_dir, "model_response"), "response_id", "instance_id", "response", "loaded_at", read(spark, sf_dir, "spider_instance"), "instance_id", "utterance", "user_message")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_found(spark, sf_dir).groupBy("defect").agg(F.count("*").alias("n_responses"))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
ORACLES: dict[str, str] = {}
