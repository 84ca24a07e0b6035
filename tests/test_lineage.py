"""Reach, longest paths and cycles of random graphs against SQL's recursion and plain Python."""

import random

import duckdb
import pandas as pd
import pytest

from credit_engine.operators import lineage


@pytest.mark.parametrize(("seed", "cyclic"), [(1, True), (2, True), (3, False)])
def test_lineage(spark, seed, cyclic):
    rng = random.Random(seed)
    edges = [(rng.randrange(18), rng.randrange(18)) for _ in range(16)] + [(30 + i, 31 + i) for i in range(9)] + [(30, 39), (32, 36)]
    edges = [(a, b) for a, b in edges if cyclic or a < b] + ([(50, 50), (50, 51), (34, 60), (60, 61), (61, 60), (61, 37)] if cyclic else [])
    df = spark.createDataFrame([*edges, *edges[:5], (None, 1), (1, None)], "src long, dst long").repartition(3)
    got = {(r.ancestor, r.node): (r.steps, r.longest, r.cyclic) for r in lineage.lineage(df).collect()}
    con = duckdb.connect()
    con.register("e", pd.DataFrame(edges, columns=["src", "dst"]))
    reach = set(con.execute("WITH RECURSIVE r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT * FROM r").fetchall())
    assert set(got) == reach
    nodes = {x for e in edges for x in e}
    loops = {x for x in nodes if (x, x) in reach}
    follow = {x: {b for a, b in edges if a == x} for x in nodes}

    def fewest(a, b):
        seen, front, n = set(), {a}, 0
        while front:
            n += 1
            front = {y for x in front for y in follow[x]} - seen
            if b in front:
                return n
            seen |= front
        raise AssertionError

    def longest(a, b):
        return max(1 + (0 if x == b and (x, b) not in reach else max([0] * (x == b) + [longest(x, b)] * ((x, b) in reach))) for x in follow[a] if x == b or (x, b) in reach)

    for (a, b), (steps, most, both) in got.items():
        meets = a in loops or b in loops or any((a, x) in reach and (x, b) in reach for x in loops)
        assert steps == fewest(a, b) and both == ((b, a) in reach)
        assert most == (None if meets else longest(a, b))
    assert bool(loops) == cyclic


def test_no_edges(spark):
    assert lineage.lineage(spark.createDataFrame([], "src long, dst long")).count() == 0
