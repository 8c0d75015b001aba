"""Every query against its SQL oracle in DuckDB, as bags of rows."""

import glob
import math
import os

import duckdb
import pytest

from acceptance.oracles import ORACLES
from acceptance.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def kind(value):
    if value is None:
        return ""
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def bag(rows):
    return sorted((tuple(kind(v) for v in row) for row in rows), key=repr)


def types(names, kinds):
    return dict(zip(names, kinds))


SPARK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


#: What a fitted model says of each text; its quality is a query of its own.
NO_SQL = {"fitted_model_rows"}


def test_every_query_has_an_oracle():
    assert set(QUERIES) - NO_SQL == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert {c: SPARK_TYPES[t] for c, t in got.dtypes} == types(
        want.columns, [str(t) for t in want.types]
    )
    ours = bag(tuple(r[c] for c in columns) for r in got.collect())
    theirs = bag(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
    assert ours
