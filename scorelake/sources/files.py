"""File scans with fixed schemas: patterns, molecule lines, SQL examples, database schemas, grammars."""

from __future__ import annotations

import json
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake import types
from scorelake.types import COLUMN_KINDS


def with_ordinal(df: DataFrame, name: str = "instance_id") -> DataFrame:
    """df with the dense number of each row in file order, from 0: counts per partition first, no single task for all rows.

    A row per partition is broadcast.
    """
    marked = df.withColumn("_m", F.monotonically_increasing_id())
    marked = marked.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1))
    sizes = marked.groupBy("_p").agg(F.count("*").alias("_n"))
    first = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    return marked.join(F.broadcast(first), F.col("_p") == F.col("_q")).withColumn(name, F.col("_first") + F.col("_i")).drop("_m", "_p", "_i", "_q", "_first")


def patterns_from_csv(spark: SparkSession, path: str, column: str) -> DataFrame:
    """instance_id, pattern: the column of an RFC 4180 file with a header. NA-like strings stay strings.

    A header without the column raises KeyError.
    """
    header = spark.read.text(path).limit(1).collect()
    names = spark.read.option("escape", '"').csv(spark.sparkContext.parallelize([header[0][0]])).first() if header else ()
    if column not in list(names or ()):
        raise KeyError(column)
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = spark.read.csv(path, header=True, escape='"', multiLine=True, schema=schema, emptyValue="", nullValue="\x00").select(F.col(column).alias("pattern"))
    return with_ordinal(rows).select("instance_id", "pattern")


def patterns_from_list(spark: SparkSession, patterns: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(patterns)), types.PATTERN_INSTANCE)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, line (without its end)."""
    return with_ordinal(spark.read.text(path), "line_no").select("line_no", F.col("value").alias("line"))


def molecules_from_list(spark: SparkSession, lists: list[list[str]]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lists)), types.MOLECULE_INSTANCE)


def molecules_from_smiles(spark: SparkSession, path: str, n_molecules: int = 20, n_instances: int = 100, seed: int = 1234, keep_line_ends: bool = True) -> DataFrame:
    """instance_id, molecules: per instance ``n_molecules`` distinct lines of the file, drawn with Python's seeded generator.

    The draw is the same as random.seed(seed) and one random.sample of line numbers per instance. More molecules than
    lines raise ValueError. The line numbers, n_molecules * n_instances of them, are broadcast if their size allows.
    """
    numbered = lines(spark, path)
    total = numbered.count()
    generator = random.Random(seed)
    drawn = [(i, pos, line) for i in range(n_instances) for pos, line in enumerate(generator.sample(range(total), n_molecules))]
    wanted = spark.createDataFrame(drawn, "instance_id bigint, pos int, wanted bigint")
    if len(drawn) * 32 <= 32 * 1024 * 1024:
        wanted = F.broadcast(wanted)
    text = F.concat("line", F.lit("\n")) if keep_line_ends else F.col("line")
    found = numbered.join(wanted, F.col("line_no") == F.col("wanted")).select("instance_id", "pos", text.alias("smiles"))
    return found.groupBy("instance_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "smiles"))), lambda x: x["smiles"]).alias("molecules"))


def hash_sample(df: DataFrame, row_id: str, n_instances: int, n_rows: int, seed: int = 0) -> DataFrame:
    """instance_id, pos, row id: per instance the n_rows ids of smallest hash; the scalable counterpart of the seeded draw.

    Hashes are compared where the rows lie with a bound under which some four times n_rows are expected, and only rows
    below it are shuffled; should an instance have fewer, which is all but impossible, the bound is dropped.
    """
    ids = df.select(F.col(row_id).alias("row_id"))
    total = ids.count()
    share = min(1.0, (4 * n_rows + 100) / max(total, 1))

    def drawn(limit: float) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_instances - 1).cast("bigint")))
        hashed = ids.withColumn("instance_id", each).withColumn("h", F.xxhash64(F.lit(seed), "instance_id", "row_id"))
        return hashed.where(F.col("h") <= int(limit * 2**64) - 2**63 - 1) if limit < 1 else hashed

    if share < 1 and drawn(share).groupBy("instance_id").count().where(f"count >= {n_rows}").count() < n_instances:
        share = 1.0
    ranked = drawn(share).withColumn("pos", F.row_number().over(W.partitionBy("instance_id").orderBy("h", "row_id")) - 1)
    return ranked.where(F.col("pos") < n_rows).select("instance_id", "pos", "row_id")


def sql_examples(spark: SparkSession, path: str) -> DataFrame:
    """instance_id, schema_name, utterance, query of a JSON array of examples; other keys aren't read."""
    rows = spark.read.option("multiLine", True).schema("db_id string, question string, query string").json(path)
    return with_ordinal(rows).select("instance_id", F.col("db_id").alias("schema_name"), F.col("question").alias("utterance"), "query")


_SCHEMA_JSON = (
    "db_id string, table_names array<string>, table_names_original array<string>, column_names array<array<string>>, "
    "column_names_original array<array<string>>, column_types array<string>, primary_keys array<bigint>, foreign_keys array<array<bigint>>"
)


def schema_entries(spark: SparkSession, path: str) -> DataFrame:
    """One row per database of a JSON array of schemas."""
    return spark.read.option("multiLine", True).schema(_SCHEMA_JSON).json(path)


def schema_columns(entries: DataFrame) -> DataFrame:
    """schema_name, ordinal, table_no (-1 for *), column name, tpe, nl_name: one row per column; an unknown type raises."""
    zipped = F.arrays_zip(F.col("column_names_original").alias("original"), F.col("column_names").alias("nl"), F.col("column_types").alias("tpe"))
    rows = entries.select(F.col("db_id").alias("schema_name"), F.posexplode(zipped).alias("ordinal", "z"))
    tpe = F.col("z.tpe")
    return rows.select(
        "schema_name",
        "ordinal",
        F.col("z.original")[0].cast("int").alias("table_no"),
        F.col("z.original")[1].alias("name"),
        F.when(tpe.isin(*COLUMN_KINDS), tpe).otherwise(F.raise_error(F.concat(F.lit("unknown column type "), F.coalesce(tpe, F.lit("null"))))).alias("tpe"),
        F.col("z.nl")[1].alias("nl_name"),
    )


def schema_tables(entries: DataFrame) -> DataFrame:
    """schema_name, tables: array of tables with their columns in order; the column * belongs to none."""
    columns = schema_columns(entries).where("table_no >= 0").groupBy("schema_name", "table_no").agg(F.array_sort(F.collect_list(F.struct("ordinal", "name", "tpe", "nl_name"))).alias("cs"))
    plain = F.transform("cs", lambda c: F.struct(c["name"].alias("name"), c["tpe"].alias("tpe"), c["nl_name"].alias("nl_name")))
    names = entries.select(F.col("db_id").alias("s"), F.posexplode(F.arrays_zip(F.col("table_names_original").alias("o"), F.col("table_names").alias("n"))).alias("no", "t"))
    joined = names.join(columns, (F.col("s") == F.col("schema_name")) & (F.col("no") == F.col("table_no")), "left")
    empty = F.array().cast("array<struct<name:string,tpe:string,nl_name:string>>")
    table = F.struct("no", F.struct(F.col("t.o").alias("name"), F.col("t.n").alias("nl_name"), F.coalesce(plain, empty).alias("columns")).alias("table"))
    return joined.groupBy(F.col("s").alias("schema_name")).agg(F.transform(F.array_sort(F.collect_list(table)), lambda x: x["table"]).alias("tables"))


def foreign_keys(entries: DataFrame) -> DataFrame:
    """schema_name, column_id, other_column_id."""
    return entries.select(F.col("db_id").alias("schema_name"), F.explode("foreign_keys").alias("k")).select("schema_name", F.col("k")[0].cast("int").alias("column_id"), F.col("k")[1].cast("int").alias("other_column_id"))


def parser_schema(path: str) -> dict[str, list[str]]:
    """table -> columns, lower case, of a JSON list of {table, col_data: [{column_name}]}."""
    with open(path, encoding="utf-8") as f:
        return {t["table"].lower(): [c["column_name"].lower() for c in t["col_data"]] for t in json.load(f)}


def raw_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def grammars(spark: SparkSession, path: str | None) -> DataFrame:
    """schema_name, lark_grammar of a JSON map, one document; none for no path."""
    if not path:
        return spark.createDataFrame([], "schema_name string, lark_grammar string")
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("schema_name", "lark_grammar"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The picklist of a column: its distinct values as text; bytes are read as UTF-8, else as Latin-1."""
    c = F.col(column)
    if dict(df.dtypes)[column] == "binary":
        c = F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")).otherwise(F.decode(c, "ISO-8859-1"))
    return df.select(c.alias("value")).distinct()


def without_times(values: DataFrame) -> DataFrame:
    """Picklist values that aren't null and hold other than two colons."""
    text = F.col("value").cast("string")
    return values.where(text.isNotNull() & ((F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))) != 2))


