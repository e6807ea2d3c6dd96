"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.canonical import canonical_query
from scorelake.llm.canonical_queries import CANON_SQL
from scorelake.llm.cross_split import cross_split_overlaps, overlap_report
from scorelake.llm.near_queries import grams_sql, normal_sql
from scorelake.session import cut, read


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split_overlaps(read(spark, sf_dir, "dev"), "example_id", read(spark, sf_dir, "train_spider"), "example_id", "question", canonical_query(F.col("query")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(spark, sf_dir).select(F.col("a").alias("dev_id"), F.col("b").alias("train_id"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlap_report(cut(overlaps(spark, sf_dir)), read(spark, sf_dir, "dev"), "example_id", "split", "origin")
    return found.withColumnRenamed("source", "origin")


QUERIES = {"p4_found": p4_found, "p4_report": p4_report}

_SIDES = f"""select 'd' as side, example_id as id, {normal_sql("question")} as t from dev where question is not null
  union all select 't', example_id, {normal_sql("question")} from train_spider where question is not null"""
_FOUND = f"""with r as ({_SIDES}), g as ({grams_sql("select * from r")}), c as ({CANON_SQL})
  select a.id as dev_id, b.id as train_id from g a join g b on a.side = 'd' and b.side = 't' and a.gram = b.gram group by a.id, b.id, a.n, b.n having count(*) >= 0.65 * (a.n + b.n - count(*))
  union select a.id, b.id from r a join r b on a.side = 'd' and b.side = 't' and a.t = b.t
  union select d.example_id, t.example_id from c x join c y on x.canon = y.canon and x.canon <> '' join dev d on d.example_id = x.example_id join train_spider t on t.example_id = y.example_id"""

ORACLES = {
    "p4_found": _FOUND,
    "p4_report": f'select "split", origin, count(*) as n_pairs, count(distinct dev_id) as n_records from ({_FOUND}) join dev on example_id = dev_id group by 1, 2',
}
