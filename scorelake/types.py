"""Fixed schemas of all records; readers use them instead of inference."""

from __future__ import annotations

from pyspark.sql import types as T

COLUMN_KINDS = ("text", "number", "time", "boolean", "others")

COLUMN = T.StructType([T.StructField("name", T.StringType()), T.StructField("tpe", T.StringType()), T.StructField("nl_name", T.StringType())])
TABLE = T.StructType([T.StructField("name", T.StringType()), T.StructField("nl_name", T.StringType()), T.StructField("columns", T.ArrayType(COLUMN))])
EXAMPLE = T.StructType([T.StructField("input", T.StringType()), T.StructField("output", T.StringType())])
MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])

RESPONSE = T.StructType([T.StructField("response", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
OUTPUT = T.StructType([T.StructField("responses", T.ArrayType(RESPONSE)), T.StructField("runtime_seconds", T.DoubleType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("desc", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
ENSEMBLE = T.StructType([T.StructField("weighted_accuracy", T.DoubleType()), T.StructField("runtime_seconds", T.DoubleType()), T.StructField("results", T.ArrayType(RESULT))])

PATTERN_INSTANCE = T.StructType([T.StructField("instance_id", T.LongType()), T.StructField("pattern", T.StringType())])
MOLECULE_INSTANCE = T.StructType([T.StructField("instance_id", T.LongType()), T.StructField("molecules", T.ArrayType(T.StringType()))])
DATUM = T.StructType([T.StructField("schema_name", T.StringType()), T.StructField("utterance", T.StringType()), T.StructField("query", T.StringType())])
SQL_INSTANCE = T.StructType(
    [
        T.StructField("instance_id", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("utterance", "schema_name", "gold", "schema_str", "lark_grammar")],
        T.StructField("few_shot_examples", T.ArrayType(EXAMPLE)),
        T.StructField("tables", T.ArrayType(TABLE)),
        T.StructField("user_message", T.StringType()),
    ]
)
