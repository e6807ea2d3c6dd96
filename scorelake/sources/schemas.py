"""Database schemas with the values of their columns."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.session import ship
from scorelake.sources.databases import Databases, run_query
from scorelake.sources.files import schema_entries, schema_tables
from scorelake.types import TABLE

#: Names of the files of a folder of examples.
SCHEMAS_FILE, DATABASE_FOLDER, DETAILS_FILE = "tables.json", "database", "db_schema_details.json"
OPEN_DATABASES = 8


def load_schemas(spark: SparkSession, schemas_path: str, db_path: str | None = None) -> DataFrame:
    """schema_name, tables, primary_keys. A details file in db_path, a JSON map of whole schemas, goes before schemas_path."""
    details = os.path.join(db_path, DETAILS_FILE) if db_path else None
    if details and os.path.exists(details):
        table = TABLE.simpleString()
        found = spark.read.text(details, wholetext=True).select(F.explode(F.from_json("value", f"map<string,struct<name:string,tables:array<{table}>,primary_keys:array<bigint>>>")).alias("schema_name", "s"))
        return found.select("schema_name", "s.tables", "s.primary_keys")
    entries = schema_entries(spark, schemas_path)
    keys = entries.select(F.col("db_id").alias("_d"), "primary_keys")
    return schema_tables(entries).join(keys, F.col("schema_name") == F.col("_d")).drop("_d")


def as_text(value: object) -> str | None:
    """A stored value as picklist text: text itself, bytes as UTF-8 or else Latin-1; numbers and nulls are none."""
    if isinstance(value, bytes):
        try:
            return value.decode("utf-8")
        except UnicodeDecodeError:
            return value.decode("latin-1")
    return value if isinstance(value, str) else None


def schema_values(schemas: DataFrame, db_path: str) -> DataFrame:
    """schema_name, table_name, column_name, value: the distinct texts of every column, times (two colons) left out.

    Databases are ``<db_path>/<name>/<name>.sqlite``; a schema whose folder is absent has none. Each column is read in the
    task that holds it, so a database of many values is spread over tasks; the folder must be shared by the executors.
    """
    ship(schemas.sparkSession)
    columns = schemas.select("schema_name", F.explode("tables").alias("t")).select("schema_name", F.col("t.name").alias("table_name"), F.explode("t.columns").alias("c")).select("schema_name", "table_name", F.col("c.name").alias("column_name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Files(Databases):
            def create(self, key: str):
                self.sources[key] = os.path.join(db_path, key, f"{key}.sqlite")
                return super().create(key)

        open_ = Files({}, OPEN_DATABASES)
        for b in batches:
            for schema, table, column in zip(*(c.to_pylist() for c in b.columns)):
                if not os.path.exists(os.path.join(db_path, schema)):
                    continue
                quoted = '"{}"'.format
                texts = {as_text(v) for (v,) in run_query(open_.get(schema), f"select distinct {quoted(column)} from {quoted(table)}")}
                kept = sorted(v for v in texts if v is not None and v.count(":") != 2)
                if kept:
                    n = len(kept)
                    yield pa.RecordBatch.from_arrays([pa.array([schema] * n), pa.array([table] * n), pa.array([column] * n), pa.array(kept)], names=["schema_name", "table_name", "column_name", "value"])

    spread = columns.repartition("schema_name", "table_name", "column_name")
    return spread.mapInArrow(run, "schema_name string, table_name string, column_name string, value string")
