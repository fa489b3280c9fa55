import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    built = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
    session = built.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = "/root/testdata/sf0.001"
    if not Path(path).is_dir():
        pytest.skip("no test tables")
    return path


@pytest.fixture(scope="session")
def same_as_duckdb(spark, sf_dir):
    """Compare a query with its SQL: same columns, same rows in any order, floats to six digits."""
    import datetime

    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}'")

    def plain(v):
        if isinstance(v, float):
            return None if v != v else round(v, 6) + 0.0
        return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v

    def check(query, sql):
        df = query(spark, sf_dir)
        names = sorted(df.columns)
        got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
        found = con.execute(sql)
        columns = [c[0] for c in found.description]
        assert sorted(columns) == names
        wanted = sorted(repr(tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in names)) for r in found.fetchall())
        assert got == wanted

    return check
