"""Bootstrap confidence intervals."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.sources.files import with_ordinal

METRICS: dict[str, Callable[[str], Column]] = {
    "mean": lambda c: F.avg(c),
    "median": lambda c: F.percentile(c, F.lit(0.5)),
    "std": lambda c: F.stddev_pop(c),
}


def resampled(values: DataFrame, value: str, n_bootstrap: int, index: Callable[[Column, Column, Column], Column], n: int) -> DataFrame:
    """b, x: for each resample b, n values drawn by ``index`` (of b, i and n) with replacement.

    values has pos, 0 .. n - 1. The draws, n_bootstrap * n of them, are made where they are needed and joined on pos.
    """
    spark = values.sparkSession
    draws = spark.range(n_bootstrap * n).select(F.floor(F.col("id") / n).alias("b"), F.pmod("id", F.lit(n)).alias("i"))
    drawn = draws.select("b", index(F.col("b"), F.col("i"), F.lit(n)).alias("at"))
    return drawn.join(values.select(F.col("pos"), F.col(value).cast("double").alias("x")), F.col("at") == F.col("pos")).select("b", "x")


def interval(samples: DataFrame, metric: str | Callable, ci: float) -> DataFrame:
    """lower, upper: percentiles, with linear interpolation, of the metric of each resample."""
    if callable(metric):
        per = samples.groupBy("b").applyInPandas(lambda pdf: pd.DataFrame({"m": [float(metric(pdf["x"].to_numpy()))]}), "m double")
    else:
        per = samples.groupBy("b").agg(METRICS[metric]("x").alias("m"))
    return per.agg(F.percentile("m", F.lit((1 - ci) / 2)).alias("lower"), F.percentile("m", F.lit((1 + ci) / 2)).alias("upper"))


def bootstrap_ci(df: DataFrame, value: str, metric: str | Callable = "mean", ci: float = 0.95, n_bootstrap: int = 10_000, seed: int = 0) -> tuple[float, float, float]:
    """(metric, lower, upper) of a column: percentile bootstrap. metric: mean, median, std (of the population) or a function
    of an array. ci outside (0, 1) and an empty column are ValueErrors; null values are left out.

    Draws are hashes of seed, resample and position, so a result depends on the values in their order alone.
    """
    if not 0 < ci < 1:
        raise ValueError("ci must be between 0 and 1")
    values = with_ordinal(df.select(F.col(value).cast("double").alias("x")).where("x is not null"), "pos")
    n = values.count()
    if not n:
        raise ValueError("values must not be empty")
    samples = resampled(values, "x", n_bootstrap, lambda b, i, k: F.pmod(F.xxhash64(F.lit(seed), b, i), k), n)
    bounds = interval(samples, metric, ci).first()
    if callable(metric):
        whole = values.withColumn("b", F.lit(0)).groupBy("b").applyInPandas(lambda pdf: pd.DataFrame({"m": [float(metric(pdf.sort_values("pos")["x"].to_numpy()))]}), "m double").first()[0]
    else:
        whole = values.agg(METRICS[metric]("x")).first()[0]
    return whole, bounds["lower"], bounds["upper"]
