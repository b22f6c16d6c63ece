from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float):
        return round(v, 8)
    return str(v)


def compare(spark, duck, build, sql, sf_dir=SMALL):
    """Asserts that a query and its SQL give the same rows, in any order."""
    df = build(spark, sf_dir)
    other = duck.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(other.columns)
    mine = sorted(tuple(str(_plain(r[c])) for c in cols) for r in df.collect())
    place = [other.columns.index(c) for c in cols]
    theirs = sorted(tuple(str(_plain(r[k])) for k in place) for r in other.fetchall())
    assert mine == theirs


@pytest.fixture(scope="session")
def same(spark, duck):
    return lambda build, sql: compare(spark, duck, build, sql)
