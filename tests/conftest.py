import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the small tables as views."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def rows(frame):
    """Rows of a pandas frame as comparable tuples, columns and rows in order."""
    frame = frame[sorted(frame.columns)]
    value = lambda v: None if v is None or v != v else v if isinstance(v, (str, bool)) else bool(v) if getattr(getattr(v, "dtype", None), "kind", "") == "b" else float(v)
    return sorted((tuple(map(value, r)) for r in frame.itertuples(index=False)), key=repr)
