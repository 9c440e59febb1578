import math
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    own = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-warehouse-"))
        .getOrCreate()
    )
    own.sparkContext.setLogLevel("ERROR")
    yield own
    own.stop()


@pytest.fixture(scope="session")
def small():
    """The folder of the smallest tables."""
    return SMALL


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """A check that a query and its SQL give equal rows, of equal columns and types, on the smallest tables."""
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")

    def plain(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else float(f"{x:.9g}")
        return x

    def kinds(rows, names):
        return {n: {type(r[k]).__name__ for r in rows if r[k] is not None} for k, n in enumerate(names)}

    def check(query, sql):
        df = query(spark, SMALL)
        names = sorted(df.columns)
        got = [tuple(plain(r[n]) for n in names) for r in df.collect()]
        rel = con.sql(sql)
        assert sorted(rel.columns) == names
        at = [rel.columns.index(n) for n in names]
        want = [tuple(plain(r[k]) for k in at) for r in rel.fetchall()]
        assert kinds(got, names) == kinds(want, names)
        assert sorted(got, key=repr) == sorted(want, key=repr)
        return len(got)

    return check
