"""Every query of the catalogue beside its SQL twin."""

import glob
import os

import duckdb
import pytest

from quarrylight.plans.catalogue import QUERIES
from quarrylight.plans.twins import TWINS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.execute(TWINS[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, got.fetchall()))


def test_only_rows(spark):
    assert set(QUERIES) - set(TWINS) == {"hash_embedding", "ivf_approximate"}
    assert {r.norm for r in QUERIES["hash_embedding"](spark, SF).collect()} <= {0.0, 1.0}
