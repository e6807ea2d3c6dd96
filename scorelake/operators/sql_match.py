"""Execution match of a predicted and a gold query, and how far their trees agree."""

from __future__ import annotations

import json
import re
import sqlite3
import threading
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ParseException
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions.sql.grade import MATCHERS, count_parts, hardness_of, keywords
from scorelake.functions.sql.normal import normalize
from scorelake.functions.sql.reader import Query, Schema, SqlError, as_json, read_sql
from scorelake.sources.databases import Databases, catalogue, run_query
from scorelake.sources.files import with_ordinal

MATCH = "exec_match boolean, reason string, level string, gold_level string"


def output_columns(q: Query, rows: list[tuple]) -> dict:
    """key of each select item -> its values in row order. The item's own aggregate isn't part of the key, so that items
    alike but for it share one, the last; of ``*`` the first column stands for all."""
    keys = [i.expr.left if i.expr.right is None else tuple(i.expr) for i in q.items]
    return {k: [r[n] for r in rows] for n, k in enumerate(keys)}


def same_rows(pred: Query, pred_rows: list[tuple], gold: Query, gold_rows: list[tuple], strict: bool) -> bool:
    """strict: columns by key, in row order. Else: columns by place, rows as a bag unless the gold query orders them."""
    if strict:
        return output_columns(pred, pred_rows) == output_columns(gold, gold_rows)
    return pred_rows == gold_rows if gold.direction else Counter(pred_rows) == Counter(gold_rows)


def match_pair(connection: sqlite3.Connection, schema: Schema, keys: dict[str, str], pred: str, gold: str, strict: bool = True, timeout: float | None = None) -> tuple[bool, str | None, str | None, str | None]:
    """(exec_match, reason, level, gold_level). reason: None, mismatch, or invalid where a query can't be read (no level then).

    A query that fails or takes longer than ``timeout`` seconds is a mismatch. level is the predicted query's difficulty.
    """
    try:
        p, g = (normalize(read_sql(s, schema), schema, keys) for s in (pred, gold))
    except (SqlError, RecursionError):
        return False, "invalid", None, None
    try:
        same = same_rows(p, run_query(connection, pred, timeout), g, run_query(connection, gold, timeout), strict)
    except (sqlite3.Error, sqlite3.Warning, IndexError, TypeError):
        same = False
    return same, None if same else "mismatch", hardness_of(count_parts(p)), hardness_of(count_parts(g))


def sql_match(pairs: DataFrame, sources: dict[str, str], keys: dict[str, dict[str, str]], db: str = "db_id", pred: str = "pred", gold: str = "gold", strict: bool = True, timeout: float | None = None) -> DataFrame:
    """pairs with exec_match, reason, level and gold_level.

    sources: of each database a file or a script that builds it; keys: of each database its foreign key map (see
    foreign_key_map). A null or unknown database, and a null query, are invalid. Each distinct (db, pred, gold) is judged
    once, near its database: distinct pairs are spread by database and query, and a worker keeps its databases open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = Databases(sources)
        schemas: dict[str, Schema] = {}
        for b in batches:
            out = []
            for d, p, g in zip(*(b.column(i).to_pylist() for i in range(3))):
                if d not in sources or p is None or g is None:
                    out.append((False, "invalid", None, None))
                    continue
                connection = open_.get(d)
                if d not in schemas:
                    schemas[d] = catalogue(connection)
                out.append(match_pair(connection, schemas[d], keys.get(d, {}), p, g, strict, timeout))
            cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.bool_(), pa.string(), pa.string(), pa.string()))] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], names=["_d", "_p", "_g", "exec_match", "reason", "level", "gold_level"])

    distinct = pairs.select(F.col(db).alias("_d"), F.col(pred).alias("_p"), F.col(gold).alias("_g")).distinct()
    judged = distinct.mapInArrow(run, f"_d string, _p string, _g string, {MATCH}")
    on = F.col(db).eqNullSafe(F.col("_d")) & F.col(pred).eqNullSafe(F.col("_p")) & F.col(gold).eqNullSafe(F.col("_g"))
    return pairs.join(judged, on).drop("_d", "_p", "_g")


def score_of_reason(df: DataFrame) -> DataFrame:
    """df of sql_match with score, desc (valid, mismatch, invalid) and metadata (level)."""
    return df.select("*", F.col("exec_match").cast("double").alias("score"), F.coalesce("reason", F.lit("valid")).alias("desc"), F.create_map(F.lit("level"), F.col("level")).alias("metadata"))


_SCHEMAS: dict[str, Schema] = {}


def _schema(text: str | None) -> Schema:
    """table -> columns of a row's tables as JSON; read once per worker for as long as it stays in use."""
    if text is None:
        return {}
    if text not in _SCHEMAS:
        if len(_SCHEMAS) >= 1000:
            _SCHEMAS.clear()
        _SCHEMAS[text] = {t["name"]: t["columns"] for t in json.loads(text)}
    return _SCHEMAS[text]


def judge(df: DataFrame, keys: list[str], texts: list[str], tables: str, rule: Callable[..., list], out: str) -> DataFrame:
    """keys, and the rows (lists or tuples by ``out``, a DDL string) that ``rule(schema, *texts)`` gives for each row of df.

    ``tables`` is the row's own schema, an array of structs with name and columns (structs with name); rule sees it as
    table -> columns in lower case, empty for null. A text that can't be read, or is null, gives no rows.
    """
    fields = pa.schema([pa.field(c.name, _ARROW[c.dataType.typeName()]) for c in _parse(df.sparkSession, out)])
    kept = df.select(*keys)
    schema = F.to_json(F.transform(tables, lambda t: F.struct(F.lower(t["name"]).alias("name"), F.transform(t["columns"], lambda c: F.lower(c["name"])).alias("columns"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, (known, *given) in enumerate(zip(*(b.column(k).to_pylist() for k in range(len(keys), b.num_columns)))):
                if any(x is None for x in given):
                    continue
                try:
                    found = rule(_schema(known), *given)
                except (SqlError, TypeError, AttributeError, RecursionError):
                    continue
                at += [i] * len(found)
                rows += found
            if rows:
                own = [b.column(k).take(pa.array(at)) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(list(c), f.type) for c, f in zip(zip(*rows), fields))], names=[*keys, *fields.names])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    return df.select(*keys, schema.alias("_schema"), *texts).mapInArrow(run, f"{types}, {out}")


_ARROW = {"integer": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}


def _parse(spark: SparkSession, ddl: str) -> T.StructType:
    return spark.createDataFrame([], ddl).schema


def sql_trees(df: DataFrame, sql: str, schema: Schema) -> DataFrame:
    """df with ast (JSON, null where the query can't be read), keywords, n_clauses, n_nested, n_others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                try:
                    q = read_sql(text, schema)
                    out.append((text, json.dumps(as_json(q)), sorted(keywords(q)), *count_parts(q)))
                except (SqlError, TypeError, AttributeError):
                    out.append((text, None, None, None, None, None))
            types = (pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["_q", "ast", "keywords", "n_clauses", "n_nested", "n_others"])

    read = df.select(F.col(sql).alias("_q")).where("_q is not null").distinct().mapInArrow(run, "_q string, ast string, keywords array<string>, n_clauses int, n_nested int, n_others int")
    return df.join(read, F.col(sql) == F.col("_q"), "left").drop("_q")


def sql_components(df: DataFrame, pred: str, gold: str, schema: Schema, keys: dict[str, str]) -> DataFrame:
    """One row per pair and part: pred, gold, part, label_total, pred_total, matched, without_agg; none for invalid pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    one, two = (normalize(read_sql(s, schema), schema, keys) for s in (p, g))
                except (SqlError, TypeError, AttributeError):
                    continue
                out += [(p, g, part, *f(one, two)) for part, f in MATCHERS.items()]
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["pred", "gold", "part", "label_total", "pred_total", "matched", "without_agg"])

    return df.select(F.col(pred).alias("pred"), F.col(gold).alias("gold")).distinct().mapInArrow(run, "pred string, gold string, part string, label_total int, pred_total int, matched int, without_agg int")


_OUTSIDE = r"(?=(?:[^'\"]*(?:'[^']*'|\"[^\"]*\"))*[^'\"]*$)"
_OPERAND = r"(?:\b(?:max|min|count|sum|avg)\s*\([^()]*\)|\([^()]*\)|[\w.]+)"
_DIVISION = re.compile(rf"({_OPERAND})\s*/\s*({_OPERAND}){_OUTSIDE}", re.I)
_WHOLE = "('tinyint', 'smallint', 'int', 'bigint')"


def spark_dialect(sql: str) -> str:
    """A query of the subset in Spark's words: LIKE without regard to case; whole numbers divide to whole numbers, and
    nothing divided by zero is null; a trailing semicolon goes."""
    out = re.sub(rf"\blike\b{_OUTSIDE}", "ilike", sql.strip().rstrip(";"), flags=re.I)
    return _DIVISION.sub(rf"if(typeof(\1) in {_WHOLE} and typeof(\2) in {_WHOLE}, cast(\1 as bigint) div nullif(cast(\2 as bigint), 0), try_divide(\1, \2))", out)


def _comparable(df: DataFrame, names: list[str]) -> DataFrame:
    """Values as SQLite compares them: numbers by value, whatever their type, and never equal to texts."""
    one = lambda f, n: F.struct(F.col(n).cast("double").alias("number"), F.lit(None).cast("string").alias("text")) if isinstance(f.dataType, (T.NumericType, T.BooleanType)) else F.struct(F.lit(None).cast("double").alias("number"), F.col(n).cast("string").alias("text"))
    named = df.toDF(*names)
    return named.select(*[one(f, n).alias(n) for f, n in zip(named.schema, names)])


def match_on_spark(spark: SparkSession, pred: str, gold: str, timeout: float | None = None) -> tuple[bool, str | None]:
    """(exec_match, reason): the relaxed match of two queries over the session's views, by place, as bags, in order if the
    gold query orders. reason: None, mismatch, or invalid where a query names what isn't there or can't be read.

    A query that fails while it runs, or takes longer than ``timeout`` seconds, is a mismatch; what else goes wrong is raised.
    """
    try:
        one, two = spark.sql(spark_dialect(pred)), spark.sql(spark_dialect(gold))
    except (AnalysisException, ParseException):
        return False, "invalid"
    if len(one.columns) != len(two.columns):
        return False, "mismatch"
    names = [f"c{i}" for i in range(len(one.columns))]
    one, two = _comparable(one, names), _comparable(two, names)
    if re.search(rf"\border\s+by\b{_OUTSIDE}", gold, re.I):
        one, two = with_ordinal(one, "ord"), with_ordinal(two, "ord")
    tag = f"match-{uuid.uuid4().hex}"
    timer = threading.Timer(timeout, spark.interruptTag, (tag,)) if timeout else None
    spark.addTag(tag)
    try:
        if timer:
            timer.start()
        same = one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    except (CapturedException, Py4JJavaError):  # failed while it ran, or was interrupted
        same = False
    finally:
        spark.removeTag(tag)
        if timer:
            timer.cancel()
    return same, None if same else "mismatch"


def exec_match_on_spark(spark: SparkSession, pred: str, gold: str, timeout: float | None = None) -> bool:
    return match_on_spark(spark, pred, gold, timeout)[0]


def sql_match_on_spark(pairs: DataFrame, pred: str = "pred", gold: str = "gold", timeout: float | None = None) -> DataFrame:
    """pairs with exec_match and reason, for a database whose tables are views of the session and too large for SQLite.

    Each distinct pair is judged once. Every statement is a job of its own over all executors, so the driver walks over the
    texts of the distinct pairs; rows of tables and of results don't come to it.
    """
    spark = pairs.sparkSession
    distinct = pairs.select(F.col(pred).alias("_p"), F.col(gold).alias("_g")).where("_p is not null and _g is not null").distinct()
    found = [(r["_p"], r["_g"], *match_on_spark(spark, r["_p"], r["_g"], timeout)) for r in distinct.toLocalIterator()]
    judged = spark.createDataFrame(found, "_p string, _g string, exec_match boolean, reason string")
    joined = pairs.join(judged, (F.col(pred) == F.col("_p")) & (F.col(gold) == F.col("_g")), "left").drop("_p", "_g")
    return joined.withColumn("reason", F.when(F.col("exec_match").isNull(), "invalid").otherwise(F.col("reason"))).withColumn("exec_match", F.coalesce("exec_match", F.lit(False)))
