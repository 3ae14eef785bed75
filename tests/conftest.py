import os

import pytest
from pyspark.sql import SparkSession

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


def canonical(rows):
    """Rows as sorted strings that do not tell 1 from 1.0."""

    def one(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return str(v)
        return float(v)

    return sorted(repr(tuple(map(one, r))) for r in rows)


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def same_as_oracle(df, sql, connection):
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    return canonical(tuple(r) for r in df.select(*columns).collect()) == canonical(connection.sql(f"SELECT {quoted} FROM ({sql})").fetchall())
