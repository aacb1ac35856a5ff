import os
import sys
import tempfile

import pandas as pd
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{ROOT}/tests:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def values(frame):
    """Rows as sorted tuples of text, columns by name; doubles to nine digits, nulls of any kind alike."""
    frame = frame[sorted(frame.columns)]
    show = lambda x: "null" if x is None or x is pd.NA or x != x else "%.9g" % x if isinstance(x, float) else str(x)
    return list(frame.columns), sorted(tuple(map(show, r)) for r in frame.itertuples(index=False))
