"""Each query against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest
from textloom.plans import registry

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the tables aren't there")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows(pdf):
    one = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 5) if isinstance(v, float) else v.tolist() if hasattr(v, "tolist") else v
    return sorted((tuple(one(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_sql(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, str(SF)).toPandas(), duck.execute(registry.ORACLE[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, str(SF)).count() > 0
