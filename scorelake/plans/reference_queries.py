"""Queries of problem 3: references to stadiums, singers and concerts that do not exist."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from scorelake.operators.references import orphan_references, orphan_report
from scorelake.session import read

FIELDS = {"stadium_id": "concert", "singer_id": "singer_in_concert", "concert_id": "singer_in_concert"}


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    concert, sic = read(spark, sf_dir, "concert"), read(spark, sf_dir, "singer_in_concert")
    parts = [
        orphan_references(concert, "concert_ID", "Stadium_ID", "loaded_at", read(spark, sf_dir, "stadium"), "Stadium_ID", "loaded_at", "deleted_at", "stadium_id"),
        orphan_references(sic, "row_id", "Singer_ID", "loaded_at", read(spark, sf_dir, "singer"), "Singer_ID", "loaded_at", "deleted_at", "singer_id"),
        orphan_references(sic, "row_id", "concert_ID", "loaded_at", concert, "concert_ID", "loaded_at", "deleted_at", "concert_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("ref_field", "child_id", "reason")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(cases(spark, sf_dir), FIELDS)


QUERIES = {"p3_found": p3_found, "p3_report": p3_report}

_SPACES = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _field(name: str, child: str, child_id: str, ref: str, parent: str, key: str) -> str:
    text = f"regexp_replace(cast({ref} as varchar), '^{_SPACES}+|{_SPACES}+$', '', 'g')"
    return f"""
      select '{name}' as ref_field, cast(c.{child_id} as bigint) as child_id, c.loaded_at,
        case when not exists (select 1 from {parent} p where p.{key} = c.k) then 'missing'
             when not exists (select 1 from {parent} p where p.{key} = c.k and not coalesce(p.loaded_at > c.loaded_at, false)) then 'late'
             else 'deleted' end as reason
      from (select {child_id}, loaded_at, try_cast({text} as decimal(38,8)) as k, {text} as t from {child}) c
      where t is not null and t <> '' and not exists (
        select 1 from {parent} p where p.{key} = c.k and p.loaded_at <= c.loaded_at and (p.deleted_at is null or p.deleted_at > c.loaded_at))"""


_CASES = " union all ".join(
    [
        _field("stadium_id", "concert", "concert_ID", "Stadium_ID", "stadium", "Stadium_ID"),
        _field("singer_id", "singer_in_concert", "row_id", "Singer_ID", "singer", "Singer_ID"),
        _field("concert_id", "singer_in_concert", "row_id", "concert_ID", "concert", "concert_ID"),
    ]
)

ORACLES = {
    "p3_found": f"select ref_field, child_id, reason from ({_CASES})",
    "p3_report": f"""select case when ref_field = 'stadium_id' then 'concert' else 'singer_in_concert' end as table_name, ref_field,
        cast(date_trunc('month', loaded_at) as timestamp) as period, reason, count(*) as n_orphans from ({_CASES}) group by all""",
}
