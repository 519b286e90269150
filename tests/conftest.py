import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple("\0" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in row)


@pytest.fixture(scope="session")
def same_rows(duck):
    """Compares a DataFrame with a DuckDB statement: columns by name, rows in any order."""

    def check(df, sql):
        names = sorted(df.columns)
        result = duck.execute(sql)
        theirs = [d[0] for d in result.description]
        assert sorted(theirs) == names
        rows = [tuple(r[theirs.index(n)] for n in names) for r in result.fetchall()]
        mine = [tuple(r[n] for n in names) for r in df.collect()]
        assert sorted(map(_key, mine)) == sorted(map(_key, rows))
        return len(mine)

    return check
