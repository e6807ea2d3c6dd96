"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.names import plain_db_id
from scorelake.llm.quota_sample import draw_sample, plain_category, plan_sample
from scorelake.session import read


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stratum, category, id: one record per response (level) and per row of dev (db_id)."""
    results = read(spark, sf_dir, "evaluation_result").select("response_id", plain_category(F.col("metadata")["level"]).alias("level")).where("response_id is not null")
    levels = results.groupBy("response_id").agg(F.max("level").alias("category")).where("category is not null").select(F.lit("level").alias("stratum"), "category", F.col("response_id").alias("id"))
    bases = read(spark, sf_dir, "dev").select(F.lit("db_id").alias("stratum"), plain_db_id(F.col("db_id")).alias("category"), F.col("example_id").alias("id")).where("category is not null")
    return levels.unionByName(bases)


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_sample(pool(spark, sf_dir), read(spark, sf_dir, "sample_target"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_report(spark, sf_dir).where("shortfall > 0").select("stratum", "category")


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw_sample(pool(spark, sf_dir), p2_report(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p2_sample": p2_sample}

_W = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_TRIM = rf"'^{_W}+|{_W}+$', '', 'g'"
#: The form of a db_id, for a column db_id.
DB_SQL = rf"regexp_replace(lower(regexp_replace(db_id, {_TRIM})), '[ _-]+', '_', 'g')"
_RECORDS = f"""
  select 'level' as stratum, level as category, response_id as id from (
    select response_id, max(nullif(lower(regexp_replace(metadata['level'], {_TRIM})), '')) as level from evaluation_result where response_id is not null group by 1) where level is not null
  union all select 'db_id', {DB_SQL}, example_id from dev where nullif({DB_SQL}, '') is not null"""
_POOL = f"select stratum, category, count(*) as n from ({_RECORDS}) group by 1, 2"
_WANTED = "greatest(t.min_rows, ceil(t.target_pct * t.sample_size / 100.0))::bigint"

# The quotas as lists of a stratum, a round to a row: q is what the free categories get by largest remainder, fixed what
# floors and caps have settled.
_EACH = "list_transform(range(1, len(sh) + 1), lambda i: {})"
_PLAN = f"""
  select t.stratum, t.category, t.target_pct::bigint as target_pct, t.min_rows::bigint as min_rows, t.sample_size, coalesce(p.n, 0) as available, {_WANTED} as wanted
  from sample_target t left join ({_POOL}) p using (stratum, category)"""
_REPORT = f"""
  with recursive p as materialized ({_PLAN}), l as (
    select stratum, max(sample_size) as size, list(category order by category) as cat, list(target_pct order by category) as sh,
      list(least(min_rows, available) order by category) as low, list(available order by category) as cap from p group by 1),
  a as (
    select *, list_transform(sh, lambda x: null::bigint) as fixed, list_transform(sh, lambda x: null::bigint) as q, 0 as stage from l
    union all
    select stratum, size, cat, sh, low, cap, case when lack + surplus = 0 then fixed when lack >= surplus then {_EACH.format("coalesce(fixed[i], if(r[i] < low[i], low[i], null))")}
        else {_EACH.format("coalesce(fixed[i], if(r[i] > cap[i], cap[i], null))")} end as fixed, r as q, if(lack + surplus = 0, -1, stage + 1) as stage
    from (select *, coalesce(list_sum({_EACH.format("if(fixed[i] is null, greatest(low[i] - r[i], 0), 0)")}), 0) as lack, coalesce(list_sum({_EACH.format("if(fixed[i] is null, greatest(r[i] - cap[i], 0), 0)")}), 0) as surplus
    from (select *, {_EACH.format("coalesce(fixed[i], g[i] + if(len(list_filter(range(1, len(sh) + 1), lambda j: m[j] > m[i] or (m[j] = m[i] and j < i))) < extra, 1, 0))")} as r
    from (select *, total - list_sum(g) as extra, {_EACH.format("if(fixed[i] is null, if(whole > 0, total * sh[i] % whole, 0), -1)")} as m
    from (select *, {_EACH.format("if(fixed[i] is null and whole > 0, total * sh[i] // whole, 0)")} as g
    from (select *, if(whole > 0, greatest(size - coalesce(list_sum(fixed), 0), 0), 0) as total
    from (select *, list_sum({_EACH.format("if(fixed[i] is null, sh[i], 0)")}) as whole from a where stage >= 0))))))),
  quotas as (select stratum, unnest(cat) as category, unnest(q) as quota from a where stage = -1)
  select p.*, quota::bigint as quota, greatest(wanted - available, 0) as shortfall from p join quotas using (stratum, category)"""

ORACLES = {
    "p2_found": f"select t.stratum, t.category from sample_target t left join ({_POOL}) p using (stratum, category) where coalesce(p.n, 0) < {_WANTED}",
    "p2_report": _REPORT,
    "p2_sample": f"""select stratum, category, id from (
      select *, row_number() over (partition by stratum, category order by substr(md5(id::varchar || ':0'), 1, 15), id) as rank from ({_RECORDS})) join (select stratum, category, quota from ({_REPORT})) using (stratum, category) where rank <= quota""",
}
