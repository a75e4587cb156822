import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    made = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    def run(sql, folder=SMALL):
        c = duckdb.connect()
        for t in TABLES:
            if os.path.exists(f"{folder}/{t}.parquet"):
                c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        return c.sql(sql).df()

    return run


@pytest.fixture(scope="session")
def same(duck):
    """Whether a DataFrame has the rows of a SQL text, in any order."""

    def check(df, sql, folder=SMALL):
        a, b = df.toPandas(), duck(sql, folder)
        cols = sorted(a.columns)
        assert cols == sorted(b.columns)
        rows = [sorted(map(str, x[cols].astype(object).where(x[cols].notna(), None).itertuples(index=False, name=None))) for x in (a, b)]
        assert rows[0] == rows[1]

    return check
