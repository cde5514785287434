"""Every registered query against its reference SQL, on whole tables."""

import math
from pathlib import Path

import pytest

from veilwork import queries

duckdb = pytest.importorskip("duckdb")
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def reference(data):
    connection = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    yield connection
    connection.close()


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(queries.all_queries()))
def test_query(spark, data, reference, name):
    df = queries.all_queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    cursor = reference.execute(queries.all_sql()[name])
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(names) == columns
    assert {c: TYPES[df.schema[c].dataType.simpleString()] for c in columns} == types
    at = [names.index(c) for c in columns]
    expected = sorted(tuple(cell(r[i]) for i in at) for r in cursor.fetchall())
    assert got == expected
