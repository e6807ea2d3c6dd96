import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.default.parallelism", "4")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import glob

    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def cells(frame):
    """Rows as comparable text, whatever the column order and number types."""

    def text(x):
        if x is None or x is __import__("pandas").NA or x != x:
            return "null"
        if isinstance(x, bool):
            return str(x)
        try:
            return f"{float(x):.9g}"
        except (TypeError, ValueError):
            return str(x)

    return sorted(tuple(map(text, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))
