import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _views():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/sf0.001/{name}.parquet'")
    return con


def _plain(frame):
    import pandas as pd

    columns = sorted(frame.columns)
    rows = [[None if pd.isna(x) else float(x) if isinstance(x, float) else x for x in r] for r in frame[columns].astype(object).values.tolist()]
    return columns, sorted(map(repr, rows))


@pytest.fixture(scope="session")
def same_as_duckdb(spark):
    """Runs a query and its SQL over the smallest tables and compares all rows."""
    con = _views()

    def check(query, sql):
        assert _plain(query(spark, f"{DATA}/sf0.001").toPandas()) == _plain(con.execute(sql).df())

    return check
