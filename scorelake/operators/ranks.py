"""Ranks within groups of any size, without one task per group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a part of a group that one task ranks.
PART_ROWS = 250_000


def text_key(c: Column, seed: int = 0) -> Column:
    """A random key below 2 ** 60 of a value: the first 15 hexadecimal digits of the MD5 of its text and the seed."""
    return F.conv(F.substring(F.md5(F.concat(c.cast("string"), F.lit(f":{seed}"))), 1, 15), 16, 10).cast("bigint")


def distributed_rank(df: DataFrame, group: list[str], key: Column, ids: list[str], out: str, rows: int, limit: str | None = None) -> DataFrame:
    """df with ``out``: 0, 1, 2 ... within each ``group``, in the order of ``key``, a number from 0 to 2 ** 60 (ties: by ``ids``).

    ``rows`` is how many rows df has, or a bound. A group is cut into ranges of the key, so many that evenly spread keys put
    PART_ROWS rows of the whole into each; the sizes of the parts, counted first with map-side combine, give each part its
    first rank, so no task sees a whole group. With ``limit`` (a column, equal within a group) only rows of a rank below it
    are kept, and parts beyond it are dropped before the shuffle. Null groups are groups of their own.
    """
    bits = min(20, max(0, math.ceil(math.log2(max(rows, 1) / PART_ROWS)) if rows else 0))
    hashed = df.withColumn("_h", key).withColumn("_part", F.shiftright("_h", 60 - bits))
    sizes = hashed.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    first = sizes.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_first"))
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    joined = hashed.join(first, same)
    if limit:
        joined = joined.where(F.col("_first") < F.col(limit))
    inner = F.row_number().over(W.partitionBy(*group, "_part").orderBy("_h", *ids)) - 1
    ranked = joined.withColumn(out, F.col("_first") + inner)
    if limit:
        ranked = ranked.where(F.col(out) < F.col(limit))
    return ranked.drop("_h", "_part", "_p", "_first", *[f"_{g}" for g in group])
