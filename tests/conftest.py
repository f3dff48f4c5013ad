"""A Spark session and the supplied tables for all tests."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, f"{ROOT}/tests", os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    db = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        db.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return db


def plain(rows):
    """Rows in a fixed order, with numbers of one kind."""
    number = lambda x: float(x) if type(x).__name__ in ("float", "Decimal") else x
    return sorted((tuple(map(number, r)) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="session")
def agree(spark, sf_dir, duck):
    def check(query, sql):
        found, stated = query(spark, sf_dir), duck.sql(sql)
        columns = sorted(found.columns)
        assert columns == sorted(stated.columns)
        ours = plain(tuple(r[c] for c in columns) for r in found.collect())
        theirs = plain(stated.project(", ".join(f'"{c}"' for c in columns)).fetchall())
        assert ours == theirs

    return check
