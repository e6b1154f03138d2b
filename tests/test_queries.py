"""Every query of the library runs over the small tables and equals its SQL form."""

import os

import duckdb
import pandas as pd
import pytest

from recordloom.plans import pairs, records, understanding  # noqa: F401  (each registers its queries)
from recordloom.plans.queries import ORACLES, QUERIES
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    df = df[sorted(df.columns)]
    text = lambda v: "" if v is None or pd.isna(v) else repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v).removesuffix(" 00:00:00")
    return sorted(tuple(text(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got.columns)
    if name in ORACLES:
        want = db.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
