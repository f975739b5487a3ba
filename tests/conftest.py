import os
import sys
import tempfile

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = REPO + ":" + os.environ.get("PYTHONPATH", "")

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    with tempfile.TemporaryDirectory(prefix="gridloom-tests-") as folder:
        s = (
            SparkSession.builder.master("local[4]").appName("tests")
            .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{folder}/shared").config("spark.sql.warehouse.dir", f"file://{folder}/warehouse")
            .getOrCreate()
        )
        s.sparkContext.setLogLevel("ERROR")
        yield s
        s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canonical(df):
    """Rows as sorted tuples of text, floats to six digits."""
    import pandas as pd

    def text(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if not isinstance(v, (list, dict)) and pd.isna(v):
            return "null"
        return f"{v + 0.0:.6g}" if isinstance(v, float) else str(v)

    cols = sorted(df.columns)
    return cols, sorted(tuple(text(v) for v in row) for row in df[cols].astype(object).itertuples(index=False))
