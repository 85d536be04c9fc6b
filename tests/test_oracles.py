"""Every registered query against its SQL, over the smallest tables."""

import os

import duckdb
import pytest

from lectern import plans  # noqa: F401
from lectern.registry import ORACLES, QUERIES

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows(frame):
    cols = sorted(frame.columns)
    frame = frame[cols].astype(object).where(frame[cols].notna(), None)
    return sorted((tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False, name=None)))


def views(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"create view {name.split('.')[0]} as select * from '{folder}/{name}'")
    return con


@pytest.fixture(scope="module")
def db():
    return views(DATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, db, name):
    """The same rows, and some: rows that agree on nothing prove nothing, so a query that is empty on the smallest tables runs on the next ones."""
    for folder, con in ((DATA, db), (LARGER, None)):
        ours, theirs = QUERIES[name](spark, folder).toPandas(), (con or views(folder)).sql(ORACLES[name]).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert rows(ours) == rows(theirs)
        if len(ours):
            return
    raise AssertionError("no rows")
