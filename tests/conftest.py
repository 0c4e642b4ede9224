import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TZ", "UTC")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def plain(value):
    """A value as text that is the same from both engines."""
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 6) + 0.0)
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return str(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def compare(df, con, sql):
    """Assert that a DataFrame and a DuckDB query give the same rows and columns."""
    columns = sorted(df.columns)
    assert columns == sorted(con.sql(sql).columns)
    got = sorted(tuple(map(plain, row)) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    wanted = con.sql("select {} from ({})".format(", ".join(f'"{c}"' for c in columns), sql)).fetchall()
    assert got == sorted(tuple(map(plain, row)) for row in wanted)
