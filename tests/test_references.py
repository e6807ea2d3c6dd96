from datetime import datetime

from scorelake.operators.references import bloom_filter, key_of, orphan_references, orphan_report
from pyspark.sql import functions as F

T = [datetime(2024, 1, d) for d in range(1, 29)]
PARENT = "k int, born timestamp, ended timestamp, extra string"
CHILD = "id bigint, ref string, at timestamp, extra int"


def cases(spark, child, parent):
    c, p = spark.createDataFrame(child, CHILD), spark.createDataFrame(parent, PARENT)
    return sorted((r["child_id"], r["reason"]) for r in orphan_references(c, "id", "ref", "at", p, "k", "born", "ended", "f").collect())


def test_reasons(spark):
    parent = [(1, T[1], None, "x"), (2, T[1], T[5], "x"), (3, T[9], None, "x"), (4, T[1], T[3], "x"), (4, T[8], None, "x"), (None, T[1], None, "x")]
    child = [
        (1, "1", T[2], 0), (2, " 01.0 ", T[2], 0), (3, "1", T[0], 0), (4, "2", T[4], 0), (5, "2", T[5], 0), (6, "3", T[2], 0), (7, "4", T[5], 0), (8, "4", T[9], 0),
        (9, "9", T[2], 0), (10, "none", T[2], 0), (11, "", T[2], 0), (12, None, T[2], 0), (13, "  ", T[2], 0), (14, "1.5", T[2], 0), (15, "1", None, 0), (16, "1" * 50, T[2], 0),
    ]
    assert cases(spark, child, parent) == [(3, "late"), (5, "deleted"), (6, "late"), (7, "deleted"), (9, "missing"), (10, "missing"), (14, "missing"), (15, "deleted"), (16, "missing")]


def test_empty_and_repeated(spark):
    assert cases(spark, [], [(1, T[1], None, "x")]) == []
    assert cases(spark, [(1, "1", T[2], 0)], []) == [(1, "missing")]
    assert cases(spark, [(1, "7", T[2], 0)] * 3, [(1, T[1], None, "x")] * 2) == [(1, "missing")] * 3


def test_filter_never_loses_a_key(spark):
    numbers = spark.range(5000)
    keys = numbers.select(key_of(numbers, "id").alias("key"))
    child = spark.range(5000).select("id", F.col("id").cast("string").alias("ref"), F.lit(T[2]).alias("at"), F.lit(0).alias("extra"))
    parent = spark.range(5000).select(F.col("id").cast("int").alias("k"), F.lit(T[1]).alias("born"), F.lit(None).cast("timestamp").alias("ended"), F.lit("").alias("extra"))
    assert orphan_references(child, "id", "ref", "at", parent, "k", "born", "ended", "f").count() == 0
    assert bloom_filter(keys, 209).count() <= 209


def test_report(spark):
    c = spark.createDataFrame([(1, "5", T[2], 0), (2, "5", T[3], 0), (3, "5", None, 0)], CHILD)
    p = spark.createDataFrame([], PARENT)
    rows = orphan_report(orphan_references(c, "id", "ref", "at", p, "k", "born", "ended", "f"), {"f": "t"}).collect()
    assert sorted((r["table_name"], r["reason"], str(r["period"]), r["n_orphans"]) for r in rows) == [("t", "missing", "2024-01-01 00:00:00", 2), ("t", "missing", "None", 1)]
