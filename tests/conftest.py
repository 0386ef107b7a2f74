import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(frame) -> list:
    """Rows of a pandas frame in one form whatever engine made them."""
    import numbers

    import pandas as pd

    def value(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x) or x is pd.NaT:
            return None
        if hasattr(x, "tolist") and not isinstance(x, numbers.Number):
            x = x.tolist()
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return bool(x)
        if isinstance(x, numbers.Number):
            return round(float(x), 6)
        return str(x)

    columns = sorted(frame.columns)
    return sorted((tuple(value(x) for x in row) for row in frame[columns].astype(object).itertuples(index=False, name=None)), key=repr)
