import tempfile

import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[8]").appName("tests")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC", "spark.local.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "spark.ui.showConsoleProgress": "false"}
    for k, v in conf.items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def oracle(sf):
    import duckdb

    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(spark, sf, oracle):
    """Holds a query's rows against its SQL on the smallest tables."""

    def check(query, sql):
        df = query(spark, sf)
        rows = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
        cursor = oracle.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted(repr(tuple(r[names.index(c)] for c in sorted(names))) for r in cursor.fetchall())
        assert rows == want
        return rows

    return check
