import glob
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(x):
        if x is None or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, float):
            return repr(round(x, 9) + 0.0)
        if isinstance(x, (list, tuple)):
            return "[" + ",".join(map(text, x)) + "]"
        return str(x)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


def agrees(spark, duck, module, name):
    df = module.queries()[name](spark, DATA)
    mine = canon(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.execute(module.oracle_sql()[name])
    theirs = canon([d[0] for d in rel.description], rel.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in rel.description)
    assert mine == theirs
