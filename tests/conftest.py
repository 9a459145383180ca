import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.driver.memory", "4g").getOrCreate())
    yield s
    s.stop()


def compare(spark, name, query, sql, folder=SF):
    """The rows of a query and of its SQL, sorted by columns by name."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    want = con.execute(sql).df()
    got = query(spark, folder).toPandas()
    columns = sorted(want.columns)
    assert set(columns) <= set(got.columns), name
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, got[columns].astype(object).where(got[columns].notna(), None).map(lambda v: round(v, 6) if isinstance(v, float) else v).to_numpy()), key=key) == sorted(
        map(tuple, want[columns].astype(object).where(want[columns].notna(), None).map(lambda v: round(v, 6) if isinstance(v, float) else v).to_numpy()), key=key), name
