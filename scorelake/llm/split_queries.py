"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.group_split import leaking_entities, place_components, split_by_entity
from scorelake.llm.names import plain_db_id
from scorelake.llm.quota_queries import DB_SQL
from scorelake.session import cut, read


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["example_id", "db_id", "origin"]
    dev, train = read(spark, sf_dir, "dev"), read(spark, sf_dir, "train_spider")
    return dev.select(*cols, F.lit("dev").alias("side")).unionByName(train.select(*cols, F.lit("train").alias("side")))


RECORD = ["example_id", "side"]


def label() -> Column:
    """What each split gets its share of: the side on which a record stands now, and its origin."""
    return F.concat_ws("/", "side", "origin")


def targets(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    rows = read(spark, sf_dir, "split_target").orderBy(F.desc("target_pct"), "split_name").collect()
    return {r["split_name"]: r["target_pct"] for r in rows if r["split_name"] and r["target_pct"]}


def new_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_by_entity(examples(spark, sf_dir), RECORD, plain_db_id(F.col("db_id")), label(), targets(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The databases whose examples stand on both sides now: the components of the new splits by their profiles."""
    placed = place_components(examples(spark, sf_dir), RECORD, plain_db_id(F.col("db_id")), label(), targets(spark, sf_dir))
    return leaking_entities(placed, F.substring_index("label", "/", 1), ["dev", "train"]).select(F.col("entity").alias("db_id"))


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return new_splits(spark, sf_dir).select("example_id", F.col("entity").alias("db_id"), "new_split")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, databases and share of each new split, beside its target."""
    found = new_splits(spark, sf_dir).groupBy("new_split").agg(F.count("*").alias("n_rows"), F.count_distinct("entity").alias("n_databases"))
    total = examples(spark, sf_dir).agg(F.count("*").alias("total"))
    targets = read(spark, sf_dir, "split_target").select(F.col("split_name").alias("new_split"), "target_pct")
    return found.join(F.broadcast(targets), "new_split").join(F.broadcast(total)).select("new_split", "target_pct", "n_rows", "n_databases", F.round(100 * F.col("n_rows") / F.col("total"), 3).alias("pct"))


def p6_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples and databases of the new splits, and what may not be: databases in two splits, examples lost or given twice,
    splits farther from their share than the largest database has examples."""
    found = cut(new_splits(spark, sf_dir))
    per = found.where("entity is not null").groupBy("entity").agg(F.count("*").alias("n"), F.count_distinct("new_split").alias("k"))
    of = per.agg(F.count("*").alias("n_databases"), F.coalesce(F.sum((F.col("k") > 1).cast("bigint")), F.lit(0)).alias("n_apart"), F.max("n").alias("largest"))
    every = examples(spark, sf_dir).agg(F.count("*").alias("n_examples"))
    rows = found.agg(F.count("*").alias("n_placed"), F.count_distinct(*RECORD).alias("n_distinct"))
    share = found.groupBy("new_split").agg(F.count("*").alias("n"))
    asked = read(spark, sf_dir, "split_target").where("target_pct > 0").select("split_name", "target_pct").join(share, F.col("split_name") == F.col("new_split"), "left")
    far = asked.crossJoin(F.broadcast(of)).crossJoin(F.broadcast(every)).agg(F.sum((F.abs(F.coalesce("n", F.lit(0)) - F.col("target_pct") * F.col("n_examples") / 100) > F.col("largest")).cast("bigint")).alias("n_off"))
    one = every.crossJoin(rows).crossJoin(of).crossJoin(far)  # a row each
    return one.select("n_examples", "n_databases", "n_apart", (F.col("n_examples") - F.col("n_distinct")).alias("n_lost"), (F.col("n_placed") - F.col("n_distinct")).alias("n_twice"), "n_off")


QUERIES = {"p6_found": p6_found, "p6_splits": p6_splits, "p6_report": p6_report, "p6_audit": p6_audit}

ORACLES = {
    "p6_found": f"select {DB_SQL} as db_id from dev where nullif({DB_SQL}, '') is not null intersect select {DB_SQL} from train_spider",
    "p6_audit": f"""select count(*) as n_examples, count(distinct nullif(db, '')) as n_databases, 0 as n_apart, 0 as n_lost, 0 as n_twice, 0 as n_off from (
      select {DB_SQL} as db from dev union all select {DB_SQL} from train_spider)""",
}
