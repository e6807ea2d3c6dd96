"""The relational operators that the graded SQL can say, one query each, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.session import read


def join_inner(s: SparkSession, d: str) -> DataFrame:
    o, c = read(s, d, "orders"), read(s, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def join_theta(s: SparkSession, d: str) -> DataFrame:
    a, b = read(s, d, "supplier").alias("a"), read(s, d, "nation").alias("b")
    near = F.broadcast(b)  # nation has a fixed number of rows
    return a.join(near, (F.col("s_nationkey") > F.col("n_nationkey")) & (F.col("s_nationkey") <= F.col("n_nationkey") + 2)).groupBy("n_name").agg(F.count("*").alias("n_suppliers"))


def join_cross(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "nation").crossJoin(F.broadcast(read(s, d, "region"))).select("n_name", "r_name")


def join_semi(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "customer").join(read(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


def join_anti(s: SparkSession, d: str) -> DataFrame:
    open_ = read(s, d, "orders").where("o_orderstatus = 'P'")
    return read(s, d, "customer").join(open_, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def join_self(s: SparkSession, d: str) -> DataFrame:
    n = read(s, d, "nation")
    return n.alias("a").join(n.alias("b"), (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("first_name"), F.col("b.n_name").alias("second_name"))


def scalar_subquery(s: SparkSession, d: str) -> DataFrame:
    p = read(s, d, "part")
    mean = p.agg(F.avg("p_retailprice").alias("m"))
    return p.join(F.broadcast(mean), F.col("p_retailprice") > F.col("m")).groupBy("p_brand").agg(F.count("*").alias("n_parts"))


def derived_table(s: SparkSession, d: str) -> DataFrame:
    per = read(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return per.groupBy("n").agg(F.count("*").alias("n_customers")).withColumnRenamed("n", "n_orders")


def aggregates(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.max("l_quantity").alias("max_qty"), F.min("l_extendedprice").alias("min_price"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc")
    )


def aggregate_distinct(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n_parts"), F.sum_distinct("l_linenumber").alias("sum_lines"))


def select_distinct(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "customer").select("c_nationkey", "c_mktsegment").distinct()


def group_having(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top")).where("n > 12 and top > 100000").select("o_custkey", "n")


def predicates(s: SparkSession, d: str) -> DataFrame:
    p = read(s, d, "part")
    kept = p.where((F.col("p_size") >= 10) & (F.col("p_size") != 20) & F.col("p_retailprice").between(920, 980) & F.col("p_type").ilike("%edIUm%") & ~F.col("p_brand").isin("Brand#2", "Brand#17"))
    return kept.select("p_partkey", "p_size")


def predicate_connectors(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events")
    return e.where((((F.col("value") > 50) & (F.col("event_type") != "click")) | (F.col("value") < 1)) & ~(F.col("user_id") < 10)).groupBy("event_type").agg(F.count("*").alias("n"))


def predicate_null(s: SparkSession, d: str) -> DataFrame:
    x = read(s, d, "dev")
    return x.groupBy(F.col("question").isNull().alias("no_question"), F.col("origin").isNotNull().alias("has_origin")).agg(F.count("*").alias("n"))


def predicate_in(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "orders").where(F.col("o_orderstatus").isin("F") & ~F.col("o_orderpriority").isin("1-URGENT")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def arithmetic(s: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return read(s, d, "lineitem").groupBy("l_linenumber").agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.sum(F.col("l_extendedprice") / q), 2).alias("unit_prices"), F.sum(F.expr("l_partkey div 2")).alias("halves"), F.round(F.sum(q + F.col("l_tax")), 4).alias("sums")
    )


def top_k(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


def order_rank(s: SparkSession, d: str) -> DataFrame:
    """The whole order as a column: range-partitioned sort, then dense numbers."""
    from scorelake.sources.files import with_ordinal

    return with_ordinal(read(s, d, "customer").select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey"), "place").select("c_custkey", "place")


def union_distinct(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(read(s, d, "supplier").select("s_nationkey")).distinct()


def intersection(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(read(s, d, "supplier").select("s_nationkey"))


def difference(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "orders").select(F.col("o_custkey").alias("k")).subtract(read(s, d, "customer").where("c_acctbal < 0").select("c_custkey"))


QUERIES = {
    "join_inner": join_inner,
    "join_theta": join_theta,
    "join_cross": join_cross,
    "join_semi": join_semi,
    "join_anti": join_anti,
    "join_self": join_self,
    "scalar_subquery": scalar_subquery,
    "derived_table": derived_table,
    "agg_max_min_count_sum_avg": aggregates,
    "agg_distinct": aggregate_distinct,
    "select_distinct": select_distinct,
    "group_having": group_having,
    "pred_compare_between_like": predicates,
    "bool_and_or_not": predicate_connectors,
    "pred_null": predicate_null,
    "pred_in": predicate_in,
    "arith_ops": arithmetic,
    "top_k": top_k,
    "order_by": order_rank,
    "union_distinct": union_distinct,
    "intersect": intersection,
    "except": difference,
}

ORACLES = {
    "join_inner": "select c_mktsegment, count(*) as n_orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey group by 1",
    "join_theta": "select n_name, count(*) as n_suppliers from supplier join nation on s_nationkey > n_nationkey and s_nationkey <= n_nationkey + 2 group by 1",
    "join_cross": "select n_name, r_name from nation cross join region",
    "join_semi": "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders)",
    "join_anti": "select c_custkey, c_name from customer c where not exists (select 1 from orders where o_custkey = c.c_custkey and o_orderstatus = 'P')",
    "join_self": "select a.n_name as first_name, b.n_name as second_name from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey",
    "scalar_subquery": "select p_brand, count(*) as n_parts from part where p_retailprice > (select avg(p_retailprice) from part) group by 1",
    "derived_table": "select n as n_orders, count(*) as n_customers from (select o_custkey, count(*) as n from orders group by 1) group by 1",
    "agg_max_min_count_sum_avg": "select l_returnflag, l_linestatus, max(l_quantity) as max_qty, min(l_extendedprice) as min_price, count(*) as n, round(sum(l_quantity), 2) as sum_qty, round(avg(l_discount), 6) as avg_disc from lineitem group by 1, 2",
    "agg_distinct": "select l_returnflag, count(distinct l_partkey) as n_parts, cast(sum(distinct l_linenumber) as bigint) as sum_lines from lineitem group by 1",
    "select_distinct": "select distinct c_nationkey, c_mktsegment from customer",
    "group_having": "select o_custkey, count(*) as n from orders group by 1 having count(*) > 12 and max(o_totalprice) > 100000",
    "pred_compare_between_like": "select p_partkey, p_size from part where p_size >= 10 and p_size <> 20 and p_retailprice between 920 and 980 and p_type ilike '%edIUm%' and p_brand not in ('Brand#2', 'Brand#17')",
    "bool_and_or_not": "select event_type, count(*) as n from events where ((value > 50 and event_type <> 'click') or value < 1) and not (user_id < 10) group by 1",
    "pred_null": "select question is null as no_question, origin is not null as has_origin, count(*) as n from dev group by 1, 2",
    "pred_in": "select o_orderpriority, count(*) as n from orders where o_orderstatus in ('F') and o_orderpriority not in ('1-URGENT') group by 1",
    "arith_ops": "select l_linenumber, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(sum(l_extendedprice / l_quantity), 2) as unit_prices, cast(sum(l_partkey // 2) as bigint) as halves, round(sum(l_quantity + l_tax), 4) as sums from lineitem group by 1",
    "top_k": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25",
    "order_by": "select c_custkey, row_number() over (order by c_acctbal, c_custkey) - 1 as place from customer",
    "union_distinct": "select c_nationkey as k from customer union select s_nationkey from supplier",
    "intersect": "select c_nationkey as k from customer intersect select s_nationkey from supplier",
    "except": "select o_custkey as k from orders except select c_custkey from customer where c_acctbal < 0",
}
