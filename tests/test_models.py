"""Forecast, attribution, isolation forest and boosted trees against plain Python and numpy."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from credit_engine.models import attribution, boosting, forecast, isolation


def brute_seasonal(ys, horizon, held_out, cut, grid):
    ys = ys[: max(0, len(ys) - cut)]
    if not ys:
        return None, None

    def fold(state, values, smoothing):
        a, b, g = smoothing
        level, trend, season, n = state
        season = list(season)
        for y in values:
            s = season[n % 12]
            new = a * (y - s) + (1 - a) * (level + trend)
            trend = b * (new - level) + (1 - b) * trend
            season[n % 12] = g * (y - new) + (1 - g) * s
            level, n = new, n + 1
        return level, trend, season, n

    def ahead(state, h):
        level, trend, season, n = state
        return level + h * trend + season[(n + h - 1) % 12]

    split = len(ys) - held_out if len(ys) > held_out else len(ys)
    early, late = ys[:split], ys[split:]
    begin = (sum(early[:12]) / len(early[:12]), 0.0, [0.0] * 12, 0)
    states = [fold(begin, early, s) for s in grid]
    errors = [round(sum((y - ahead(s, i + 1)) ** 2 for i, y in enumerate(late)), 2) for s in states]
    choice = errors.index(min(errors))
    last = fold(states[choice], late, grid[choice])
    return choice, [ahead(last, h + 1) for h in range(horizon)]


@pytest.mark.parametrize("cut", [0, 6])
def test_seasonal(spark, cut):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 100.0 + 10 * math.sin(t) + rng.random() * i + 3 * t * (i % 3)]) for t in range(n)]) for i, n in enumerate([1, 2, 5, 6, 7, 12, 13, 18, 19, 30, 60, 80, 80, 80])]
    rows.append((99, [float(100 + 50 * (t % 12)) for t in range(60)]))
    grid = [*forecast.GRID, (0.3, 0.1, 0.5)]
    got = {r.k: r for r in forecast.seasonal(spark.createDataFrame(rows, "k int, ys array<double>"), horizon=5, held_out=6, cut=cut, grid=grid).collect()}
    for k, ys in rows:
        choice, ahead = brute_seasonal(ys, 5, 6, cut, grid)
        assert got[k].choice == choice, k
        assert got[k].ahead is None if ahead is None else got[k].ahead == pytest.approx(ahead, rel=1e-9)
    if not cut:
        line = forecast.straight(spark.createDataFrame(rows[-1:], "k int, ys array<double>"), horizon=5).first().line
        missed = [sum((x - 100.0 - 50.0 * h) ** 2 for h, x in enumerate(of)) for of in (got[99].ahead, line)]
        assert missed[0] < missed[1] / 4  # a season is found


def test_series_are_folded_together(spark):
    """Many series at once as one by one in Python; no fold is left to Spark's interpreted lambda functions."""
    rng = random.Random(2)
    rows = [(i, [round(rng.uniform(0, 9e5), 2) for _ in range(rng.choice([1, 3, 6, 7, 11, 20, 43]))]) for i in range(3000)] + [(3000, []), (3001, None), (3002, [1.0, None, 2.0])]
    told = forecast.seasonal(spark.createDataFrame(rows, "k int, ys array<double>").repartition(3), horizon=4)
    assert "aggregate(" not in told._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r for r in told.collect()}
    assert len(got) == len(rows) and all(got[k].choice is None and got[k].ahead is None for k in (3000, 3001, 3002))
    for k, ys in rows[:3000:7]:
        choice, ahead = brute_seasonal(ys, 4, forecast.HELD_OUT, 0, forecast.GRID)
        assert (got[k].choice, got[k].ys) == (choice, ys) and got[k].ahead == pytest.approx(ahead, rel=1e-12), k


def test_series_has_every_month(spark):
    rows = [(1, "2020-11-01", 5.0), (1, "2021-02-01", 7.0), (2, "2020-01-01", 1.0)]
    months = spark.createDataFrame(rows, "k int, m string, x double").withColumn("m", F.to_date("m"))
    assert {r.k: r.ys for r in forecast.series(months, "k", "m", F.col("x")).collect()} == {1: [5.0, 0.0, 0.0, 7.0], 2: [1.0]}
    line = forecast.straight(spark.createDataFrame([(1, [1.0, 3.0, 5.0, 7.0]), (2, [4.0])], "k int, ys array<double>"), horizon=2)
    assert {r.k: r.line for r in line.collect()} == {1: pytest.approx([9.0, 11.0]), 2: [4.0, 4.0]}


def test_shapley(spark):
    """Against all orders of the agents; the shares add up to the difference of the labels, also for missing scores."""
    rng = random.Random(6)
    rows = [(i, *[round(rng.uniform(0, 100), 3) for _ in range(6)]) for i in range(40)] + [(90, *[50.0] * 6), (91, *[100.0] * 6), (92, *[70.0] * 6), (93, None, *[90.0] * 5), (94, float("nan"), *[90.0] * 5)]
    names = list("abcdef")
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in names))
    worths = df.select("id", attribution.coalitions([F.col(c) for c in names], attribution.label_worth).alias("w"))
    got = {r.id: [x.shares for x in r.x] for r in worths.select("id", attribution.attributed(names, F.col("w")).alias("x")).collect()}

    def worth(e, members):
        mean = round(sum(x if i in members else 50.0 for i, x in enumerate(e)) / 6, 6) if all(x is not None or i not in members for i, x in enumerate(e)) else math.nan
        return 0 if math.isnan(mean) else 2 if mean > 70 else 1 if mean > 50 else 0

    for i, *e in rows[::4] + rows[-5:]:
        want = [0] * 6
        for order in itertools.permutations(range(6)):
            for place, who in enumerate(order):
                want[who] += worth(e, order[: place + 1]) - worth(e, order[:place])
        assert got[i] == want
        assert sum(want) == 720 * (worth(e, range(6)) - worth(e, ()))
    with pytest.raises(ValueError, match="players"):
        attribution.coalitions([F.lit(1.0)] * 13, attribution.label_worth)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    usual, odd = rng.normal(0, 1, (3000, 4)), rng.normal(0, 1, (30, 4)) + rng.choice([-7, 7], (30, 4))
    rows = [(i, *x, i >= 3000) for i, x in enumerate(np.concatenate([usual, odd]).tolist())]
    rows += [(5000, None, 0.0, float("nan"), 0.0, False), (5000, None, 0.0, float("nan"), 0.0, False)]
    return spark.createDataFrame(rows, "id long, a double, `b c` double, c double, d double, odd boolean")


FEATURES = ["a", "b c", "c", "d"]


def test_isolation(cloud):
    forest = isolation.fit(cloud.repartition(7), FEATURES, "id", sample=1000)
    assert forest == isolation.fit(cloud.coalesce(1), FEATURES, "id", sample=1000)  # however rows are dealt
    scored = cloud.select("*", forest.score().alias("s"))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = scored.collect()
    assert len(rows) == 3032 and all(0 < r.s < 1 for r in rows)
    for r in rows[::50] + rows[-3:]:
        x = [f if v is None or math.isnan(v) else v for v, f in zip(r[1:5], forest.fill, strict=True)]
        total = 0.0
        for tree in forest.trees:
            node = 0
            while tree["f"][node]:
                node = tree["l"][node] - 1 + (x[tree["f"][node] - 1] >= tree["t"][node])
            total += tree["p"][node]
        assert r.s == pytest.approx(2 ** (-total / len(forest.trees) / isolation.usual_path(forest.rows)))
    assert boosting.auc(scored, "s", "odd").first().auc > 0.98
    none = isolation.fit(cloud.limit(0), FEATURES, "id")
    assert none.trees == [] and cloud.limit(2).select(none.score().alias("s")).filter("s IS NULL").count() == 2
    same = isolation.fit(cloud.select("id", F.lit(1.0).alias("a")), ["a"], "id")
    assert cloud.select(F.lit(1.0).alias("a")).select(F.round(same.score(), 9).alias("s")).distinct().count() == 1


def test_auc(spark):
    rng = random.Random(8)
    rows = [(round(rng.random(), 1), rng.random() < 0.4) for _ in range(200)] + [(None, True), (0.5, None)]
    ones, zeros = ([s for s, y in rows if y is want and s is not None] for want in (True, False))
    want = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / len(ones) / len(zeros)
    df = spark.createDataFrame(rows, "s double, y boolean")
    assert tuple(boosting.auc(df, "s", "y").first()) == (200, len(ones), pytest.approx(want, abs=1e-6))
    assert tuple(boosting.auc(df.filter("y"), "s", "y").first())[2] is None and boosting.auc(df.limit(0), "s", "y").first().n == 0


def brute_boost(x, y, edges, rounds, depth, rate):
    """Bins, gradients and trees in numpy, node by node on the rows themselves."""
    unit, ballast = boosting.UNIT, boosting.BALLAST * boosting.UNIT
    bins = np.array([[0 if v is None or math.isnan(v) else 1 + sum(e < v for e in edges[c]) for v in x[c]] for c in edges]).T
    n, ones = len(y), sum(y)
    margin = np.full(n, round(unit * math.log(ones / (n - ones))), np.int64)
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin / unit))
        g, h = np.round((p - y) * unit).astype(np.int64), np.round(p * (1 - p) * unit).astype(np.int64)
        splits, leaves, node = {}, {}, np.ones(n, int)
        for _ in range(depth):
            for at in sorted({*node.tolist()} - {k for k in node.tolist() if k.bit_length() <= max((m.bit_length() for m in node.tolist()), default=0) - 1}):
                mine, best = node == at, (1e-9, None)
                for f in range(bins.shape[1]):
                    for b in sorted({*bins[mine, f].tolist()})[:-1]:
                        left = mine & (bins[:, f] <= b)
                        gl, hl, ga, ha = (int(v.sum()) for v in (g[left], h[left], g[mine], h[mine]))
                        gain = (gl * gl / (hl + ballast) + (ga - gl) ** 2 / (ha - hl + ballast) - ga * ga / (ha + ballast)) / unit
                        if gain > best[0]:
                            best = (gain, (f + 1, b))
                if best[1]:
                    splits[at] = best[1]
                    node = np.where(mine, 2 * at + (bins[:, best[1][0] - 1] > best[1][1]), node)
        for at in {*node.tolist()}:
            leaves[at] = round(-rate * unit * int(g[node == at].sum()) / (int(h[node == at].sum()) + ballast))
        margin = margin + np.array([leaves[k] for k in node.tolist()])
        trees.append(boosting.Tree(splits, leaves))
    return trees


def test_boosting(spark):
    rng = random.Random(9)
    rows = []
    for i in range(1500):
        a, b, c = rng.random(), rng.choice([None, float("nan"), *range(5)]), rng.gauss(0, 1)
        odds = 3 * (a > 0.6) - 2 * (b is None) + (c if a < 0.3 else 0) - 1
        rows.append((i, a, None if b is None else float(b), c, 1.0, rng.random() < 1 / (1 + math.exp(-odds))))
    df = spark.createDataFrame([*rows, (5000, 0.5, 1.0, 0.0, 1.0, None)], "id long, a double, b double, c double, same double, y boolean")
    names = ["a", "b", "c", "same"]
    model = boosting.fit(df.repartition(5), names, "y", "id", rounds=3)
    assert model == boosting.fit(df.coalesce(1), names, "y", "id", rounds=3)  # the same trees however rows are dealt
    x = {c: [r[i + 1] for r in rows] for i, c in enumerate(names)}
    assert model.trees == brute_boost(x, np.array([r[-1] for r in rows], int), model.edges, 3, boosting.DEPTH, boosting.RATE)
    scored = df.select("*", model.probability().alias("p"))
    assert scored.filter("p > 0 AND p < 1").count() == 1501 and boosting.auc(scored, "p", "y").first().auc > 0.75
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    alone = boosting.fit(df.filter("y"), names, "y", "id")
    assert alone.trees == [] and boosting.fit(df.limit(0), names, "y", "id").trees == []


def test_models_of_orders(spark):
    """On the smallest tables: orders of the last fifth alone are told, and the model is better than the agents' mean."""
    from credit_engine.plans import modelled

    sf = "/root/testdata/sf0.01"
    quality = {r.model: r for r in modelled.late_model_quality(spark, sf).collect()}
    assert quality["boosted trees"].auc > quality["mean of six agents"].auc + 0.05 and quality["boosted trees"].n == quality["mean of six agents"].n > 1000
    apart = modelled.fraud_isolation(spark, sf)
    assert apart.count() == 1500 and apart.filter("apart IS NULL OR apart <= 0 OR apart >= 1").isEmpty()


@pytest.mark.parametrize("hub", [2, 100_000])
def test_rank(spark, hub):
    """Against a dense matrix; mass is kept, hubs may be split, plans do not grow."""
    from credit_engine.models import ranking

    rng = random.Random(12)
    edges = [(rng.randrange(30), rng.randrange(30), rng.choice([0.5, 1.0, 3.0])) for _ in range(90)] + [(0, i, 1.0) for i in range(30)] + [(5, 6, 0.0), (5, 7, -1.0), (None, 3, 1.0), (3, None, 1.0), (40, 41, 2.0), (40, 41, 2.0)]
    seeds = [(1, 2.0), (2, 1.0), (2, 1.0), (50, 1.0), (3, 0.0), (None, 9.0), (4, None)]
    ids = [*range(30), 40, 41, 50]
    at = {x: i for i, x in enumerate(ids)}
    w, s = np.zeros((len(ids), len(ids))), np.zeros(len(ids))
    for a, b, x in edges:
        if a is not None and b is not None and x > 0:
            w[at[a], at[b]] += x
    for a, x in seeds:
        if a is not None and x:
            s[at[a]] += x
    s /= s.sum()
    total = w.sum(axis=1)
    m = np.divide(w, total[:, None], out=np.zeros_like(w), where=total[:, None] > 0)
    for rounds in (1, 25):
        r = s
        for _ in range(rounds):
            r = 0.85 * (r @ m) + (0.15 + 0.85 * r[total == 0].sum()) * s
        e, n = spark.createDataFrame(edges, "src long, dst long, weight double").repartition(3), spark.createDataFrame(seeds, "node long, mass double")
        ranked = ranking.personalised_rank(e, n, rounds=rounds, tolerance=0.0, hub=hub)
        got = {x.node: x.rank for x in ranked.collect()}
        assert got == pytest.approx({x: r[i] for x, i in at.items()}, abs=1e-12) and sum(got.values()) == pytest.approx(1.0)
        assert len(ranked._jdf.queryExecution().optimizedPlan().toString().splitlines()) < 4
    ended = ranking.personalised_rank(e, n, rounds=500, tolerance=1e-3)
    assert sum(abs(x.rank - r[at[x.node]]) for x in ended.collect()) < 0.01
    assert ranking.personalised_rank(e, n.limit(0)).filter("rank IS NULL").count() == 32


def test_rank_leaves_the_edges_where_they_lie(spark, monkeypatch):
    """In a round the weights are read by their buckets and not shuffled."""
    from credit_engine.models import ranking

    plans, real = [], ranking._handed

    def watched(ranks, weights):
        made = real(ranks, weights)
        plans.append(made._jdf.queryExecution().executedPlan().toString())
        return made

    monkeypatch.setattr(ranking, "_handed", watched)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    edges = spark.range(2000).select((F.col("id") % 90).alias("src"), (F.col("id") % 70 + 50).alias("dst"), F.lit(1.0).alias("weight"))
    ranked = ranking.personalised_rank(edges, spark.createDataFrame([(3, 1.0)], "node long, mass double"), rounds=2, tolerance=0.0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert ranked.agg(F.sum("rank")).first()[0] == pytest.approx(1.0)
    assert len(plans) == 2 and all(p.count("Exchange") == 2 and "Bucketed: true" in p for p in plans)  # of the ranks, and of the cells' sums


def test_late_orders_read_the_lines_once(spark, monkeypatch):
    """What trees are fitted on and judged by is written once: the result does not read the lines again."""
    from credit_engine.plans import modelled

    monkeypatch.setattr(modelled.boosting, "fit", lambda rows, features, *_: boosting.Boosted({c: [] for c in features}, 0, []))
    plan = modelled.late_orders(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_custkey" not in plan


def test_factors_are_not_made_twice(spark):
    """No filter repeats the factors' expression."""
    from credit_engine.plans import lending

    plan = lending.explain_factors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "transform(" in line for line in plan.splitlines())
