"""Every query of the lending engine against its SQL, row by row."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from credit_engine.plans.registry import ORACLES, QUERIES

#: Models that SQL cannot fit; they have tests of their own.
FITTED = {"fraud_isolation", "late_orders", "late_model_quality"}


def rows(columns, found):
    def plain(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 9) + 0.0
        return str(x) if x is not None and not isinstance(x, (int, str, bool)) else x

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == FITTED


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLES[name])
    expected = rows([d[0] for d in want.description], want.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == expected[0]
    assert got[1] == expected[1], list((got[1] - expected[1]).items())[:3] + list((expected[1] - got[1]).items())[:3]
