"""Every registered query against its SQL twin on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from matchloom.plans.catalogue import ORACLES, QUERIES

FOLDER = os.environ.get("MATCHLOOM_TEST_DIR", "/root/testdata/sf0.001")
MODEL_FOLDER = os.environ.get("MATCHLOOM_MODEL_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables not found")
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def twins():
    out = {}
    for folder in (FOLDER, MODEL_FOLDER):
        out[folder] = connection = duckdb.connect()
        for path in glob.glob(f"{folder}/*.parquet"):
            connection.execute(f"CREATE OR REPLACE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return out


def plain(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, "nan" if math.isnan(value) else f"{value:.6g}")
    if isinstance(value, datetime.date):
        return (2, value.isoformat())
    return (3, str(value))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, twins, name):
    # the smallest tables hold too few matched sets for a model
    folder = MODEL_FOLDER if name.startswith("cond_logit") else FOLDER
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = ORACLES.get(name)
    if sql is None:
        assert got
        return
    cursor = twins[folder].execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(names) == columns
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == kinds
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())


def test_entry(spark):
    out = entry_point.entry(spark)
    assert out.columns == ["person_id", "date", "code", "source", "window_start", "window_end"]
    assert out.count() > 0
