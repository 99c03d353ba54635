import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(x):
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="session")
def same(spark, duck):
    """Holds a query's rows against its SQL's, regardless of order."""
    from collections import Counter

    def check(query, sql):
        df = query(spark, DATA)
        names = sorted(df.columns)
        cur = duck.execute(sql)
        theirs = [d[0] for d in cur.description]
        assert sorted(theirs) == names
        at = [theirs.index(n) for n in names]
        assert Counter(repr(plain(tuple(r))) for r in df.select(*names).collect()) == Counter(repr(plain(tuple(r[i] for i in at))) for r in cur.fetchall())

    return check
