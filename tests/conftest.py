import sys
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": f"file://{folder}/shared", "spark.local.dir": str(folder), "spark.sql.warehouse.dir": str(folder / "warehouse"), "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """A DuckDB connection with the tables of the smallest data set."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in (DATA / "sf0.001").glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows(df):
    """The rows of a pandas frame as sorted texts, columns by name."""
    columns = sorted(df.columns)
    plain = lambda v: None if v is None or v is pd.NA or v != v else v.item() if hasattr(v, "item") else v
    return columns, sorted(repr(tuple(plain(v) for v in r)) for r in df[columns].itertuples(index=False, name=None))
