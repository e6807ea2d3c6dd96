"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.canonical import canonical_copies, canonical_groups, canonical_query
from scorelake.session import read


def spider_datum(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["example_id", "db_id", "question", "query", "origin"]
    return read(spark, sf_dir, "dev").select(*cols).unionByName(read(spark, sf_dir, "train_spider").select(*cols))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_copies(spider_datum(spark, sf_dir), "example_id", canonical_query(F.col("query")))


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = canonical_groups(spider_datum(spark, sf_dir), "example_id", canonical_query(F.col("query")))
    return groups.select("keep_id", "copies")


QUERIES = {"p7_found": p7_found, "p7_groups": p7_groups}

_W = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_HEAD = rf"(?s)^(.*?\bselect\b)({_W}]*distinct\b)?(.*?)(\bfrom\b.*)$"


def _part(i: int) -> str:
    return f"""regexp_replace(regexp_extract(lower(query), '{_HEAD}', {i}), '{_W};''"`]', '', 'g')"""


#: A select list split at the commas before which as many parentheses are closed as opened.
_SPLIT = """string_split(array_to_string(list_transform(range(1, length(items) + 1), lambda i: if(items[i] = ','
  and length(replace(items[1:i], '(', '')) = length(replace(items[1:i], ')', '')), chr(1), items[i])), ''), chr(1))"""
#: example_id and canonical query of every record; also used by problem 4.
CANON_SQL = f"""
  select example_id, case when regexp_matches(lower(query), '{_HEAD}')
      then {_part(1)} || {_part(2)} || (select array_to_string(list_sort(list_filter({_SPLIT}, lambda x: x <> '')), ',') from (select {_part(3)} as items)) || {_part(4)}
      else regexp_replace(lower(query), '{_W};''"`]', '', 'g') end as canon
  from (select example_id, query from dev union all select example_id, query from train_spider)"""

_GROUPS = f"select canon, min(example_id) as keep_id, count(*) as copies from ({CANON_SQL}) where canon <> '' group by canon"

ORACLES = {
    "p7_found": f"select g.keep_id, c.example_id as copy_id from ({CANON_SQL}) c join ({_GROUPS}) g using (canon) where c.example_id > g.keep_id",
    "p7_groups": f"select keep_id, copies from ({_GROUPS})",
}
