"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs
from scorelake.session import read


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    dev = read(spark, sf_dir, "dev").select(F.lit("dev").alias("source_table"), F.col("example_id").alias("id"), F.col("question").alias("text"))
    inst = read(spark, sf_dir, "spider_instance").select(F.lit("spider_instance").alias("source_table"), F.col("instance_id").alias("id"), F.col("utterance").alias("text"))
    return dev.unionByName(inst)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(questions(spark, sf_dir), "source_table", "id", "text").withColumnRenamed("group", "source_table")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(questions(spark, sf_dir), "source_table", "id", "text").withColumnRenamed("group", "source_table")


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups}


def normal_sql(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' ')"


def grams_sql(rows: str) -> str:
    """Rows (side, id, t) as (side, id, n, gram), n the number of distinct 3-grams."""
    return f"""select side, id, len(l) as n, unnest(l) as gram from (
      select side, id, list_distinct(list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: substr(t, i, 3))) as l from ({rows}))"""


_ROWS = f"""select 'dev' as side, example_id as id, {normal_sql("question")} as t from dev where question is not null
  union all select 'spider_instance', instance_id, {normal_sql("utterance")} from spider_instance where utterance is not null"""

_LINKS = """select a.side, a.id as a, b.id as b from g a join g b on a.side = b.side and a.gram = b.gram and a.id < b.id group by a.side, a.id, b.id, a.n, b.n having count(*) >= 0.65 * (a.n + b.n - count(*))"""

ORACLES = {
    "p1_found": f"""with r as ({_ROWS}), g as ({grams_sql("select * from r")})
      select side as source_table, a as id_a, b as id_b from (
        {_LINKS} union select a.side, a.id, b.id from r a join r b on a.side = b.side and a.t = b.t and a.id < b.id)""",
    "p1_groups": f"""with recursive r as ({_ROWS}), texts as (select side, t, min(id) as id from r group by 1, 2), g as ({grams_sql("select side, id, t from texts")}),
      links as materialized ({_LINKS}), both_ways as (select side, a, b from links union all select side, b, a from links),
      reach as (select side, id, id as other from texts union select x.side, x.id, y.b from reach x join both_ways y on x.side = y.side and x.other = y.a),
      least as (select side, id, min(other) as group_id from reach group by 1, 2), ends as (select side, a as id, count(*) as n from both_ways group by 1, 2)
      select r.side as source_table, r.id, group_id, coalesce(n, 0) as n_links from r join texts x on r.side = x.side and r.t = x.t
        join least m on m.side = x.side and m.id = x.id left join ends e on e.side = x.side and e.id = x.id""",
}
