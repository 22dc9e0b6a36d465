import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def matches_sql(spark):
    """Runs a query and its SQL over the smallest tables and compares columns and rows, order aside."""
    import os

    import duckdb

    db = duckdb.connect()
    for file in os.listdir(SF_DIR):
        db.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{file}'")

    def check(query, sql):
        df = query(spark, SF_DIR)
        names = sorted(df.columns)
        got = sorted(repr(tuple(r)) for r in df.select(*(f"`{c}`" for c in names)).collect())
        db.execute(f"CREATE OR REPLACE TEMP VIEW own AS {sql}")  # as the driver does: not all SQL can be a view
        want = db.execute("SELECT * FROM own")
        place = {c[0]: i for i, c in enumerate(want.description)}
        assert names == sorted(place)
        assert got == sorted(repr(tuple(r[place[c]] for c in names)) for r in want.fetchall())

    return check
