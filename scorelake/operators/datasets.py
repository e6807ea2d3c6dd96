"""Instances of the SQL domain: examples joined with their schema, grammar, few-shot examples and message."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.prompts import serialize_schema, user_message
from scorelake.sources.files import grammars, sql_examples
from scorelake.sources.schemas import DATABASE_FOLDER, SCHEMAS_FILE, load_schemas


def few_shots(train: DataFrame, tables: DataFrame, ids: list[int]) -> DataFrame:
    """One row, few_shot_examples: the train examples of the given numbers, in the order of ``ids``, as (message, query).

    A number beyond the train examples raises IndexError. ids are a handful that the caller lists.
    """
    spark = train.sparkSession
    total = train.count()
    if bad := [i for i in ids if not -total <= i < total]:
        raise IndexError(f"no train example {bad}")
    wanted = spark.createDataFrame([(k, i % total) for k, i in enumerate(ids)], "pos int, wanted bigint")
    found = train.join(F.broadcast(wanted), F.col("instance_id") == F.col("wanted")).join(tables.withColumnRenamed("schema_name", "_s"), F.col("schema_name") == F.col("_s"))
    shot = F.struct("pos", user_message(serialize_schema(F.col("tables")), F.col("utterance")).alias("input"), F.col("query").alias("output"))
    listed = found.agg(F.array_sort(F.collect_list(shot)).alias("l"))
    return listed.select(F.transform("l", lambda x: F.struct(x["input"].alias("input"), x["output"].alias("output"))).alias("few_shot_examples"))


def sql_instances(examples: DataFrame, tables: DataFrame, train: DataFrame, grammar: DataFrame, few_shot_ids: list[int]) -> DataFrame:
    """The columns of types.SQL_INSTANCE. An example whose schema is missing fails the job (KeyError where it is known early)."""
    shots = few_shots(train, tables, few_shot_ids)
    joined = examples.join(tables.withColumnRenamed("schema_name", "_s"), F.col("schema_name") == F.col("_s"), "left").join(grammar.withColumnRenamed("schema_name", "_g"), F.col("schema_name") == F.col("_g"), "left")
    checked = F.when(F.col("_s").isNull(), F.raise_error(F.concat(F.lit("no schema "), F.coalesce("schema_name", F.lit("null"))))).otherwise(serialize_schema(F.col("tables")))
    with_schema = joined.withColumn("schema_str", checked).crossJoin(F.broadcast(shots))  # one row
    return with_schema.select(
        "instance_id", "utterance", "schema_name", F.col("query").alias("gold"), "schema_str", "lark_grammar", "few_shot_examples", "tables", user_message(F.col("schema_str"), F.col("utterance")).alias("user_message")
    )


def sql_dataset(spark: SparkSession, folder: str, grammar_json_path: str | None = None, few_shot_example_ids: list[int] | None = None) -> DataFrame:
    """Instances of a folder with dev.json, train_spider.json and tables.json. Few-shot numbers default to 10, 100 and 1000."""
    tables = load_schemas(spark, os.path.join(folder, SCHEMAS_FILE), os.path.join(folder, DATABASE_FOLDER)).select("schema_name", "tables")
    dev, train = (sql_examples(spark, os.path.join(folder, f)) for f in ("dev.json", "train_spider.json"))
    ids = [10, 100, 1000] if few_shot_example_ids is None else few_shot_example_ids
    return sql_instances(dev, tables, train, grammars(spark, grammar_json_path), ids)
