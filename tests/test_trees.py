"""Boosted trees against a plain grower that looks at every value of every column."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models, trees


def data(n=2000, seed=0):
    """Columns of at most 20 values, some unknown: where y is high in "a", and where it is low in "b"."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 20, (n, 4)).astype(float)
    y = 3.0 * (x[:, 0] > 9) + 0.2 * x[:, 1] * (x[:, 2] > 4) + rng.normal(0, 1, n)
    for j, effect in ((0, 4.0), (1, -4.0)):
        gone = rng.random(n) < 0.15
        y[gone] += effect
        x[gone, j] = np.nan
    x[rng.random(n) < 0.1, 3] = np.nan
    return x, y


def frame(spark, x, y):
    rows = [(i, *(None if math.isnan(v) else float(v) for v in r), None if math.isnan(t) else float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double")


def brute_tree(x, r, leaves, least, l2):
    """Splits (feature, value, unknown left, gain, rows) of a tree grown best first, and the leaf mean of each row."""

    def best(rows):
        top = (1e-12,)
        score = lambda s: r[s].sum() ** 2 / (len(s) + l2)
        for j in range(x.shape[1]):
            v = x[rows, j]
            unknown = np.isnan(v)
            for cut in sorted(set(v[~unknown])):
                for left_unknown in (False, True):
                    left = (v <= cut) | (unknown & left_unknown)
                    if min(left.sum(), (~left).sum()) >= least:
                        gain = score(rows[left]) + score(rows[~left]) - score(rows)
                        if gain > top[0] * (1 + 1e-9):
                            if not unknown.any():
                                left_unknown = 2 * left.sum() >= len(left)  # noqa: PLW2901
                            top = (gain, j, cut, bool(left_unknown), rows[left], rows[~left])
        return top if len(top) > 1 else None

    parts, splits = [np.arange(len(x))], []
    found = [best(parts[0])]
    while len(parts) < leaves and any(found):
        i = max((i for i, f in enumerate(found) if f), key=lambda i: found[i][0])
        gain, j, cut, left_unknown, a, b = found[i]
        splits.append((j, cut, left_unknown, round(gain, 3), len(parts[i])))
        parts[i : i + 1], found[i : i + 1] = [a, b], [best(a), best(b)]
    value = np.zeros(len(x))
    for rows in parts:
        value[rows] = r[rows].sum() / (len(rows) + l2)
    return splits, value


@pytest.mark.parametrize("parts", [1, 5])
def test_trees_are_those_of_a_plain_grower(spark, parts):
    x, y = data()
    df = frame(spark, x, y).repartition(parts)
    forest = trees.grow(df, list("abcd"), "y", trees=3, leaves=31, rate=0.5, least_rows=10)
    pred = np.full(len(y), y.mean())
    for tree in forest.trees["all"]:
        splits, value = brute_tree(x, y - pred, 31, 10, 1.0)
        inner = tree.feature >= 0
        got = [
            (int(j), float(forest.edges[j][c - 1]) if c <= len(forest.edges[j]) else max(x[~np.isnan(x[:, j]), j]), bool(u), round(float(g), 3), int(n))
            for j, c, u, g, n in zip(tree.feature[inner], tree.cut[inner], tree.unknown_left[inner], tree.gain[inner], tree.rows[inner])
        ]
        near = lambda s: sorted((n, j, round(g)) for j, _, _, g, n in s)
        assert len(got) == 30 == len(splits) and near(got) == near(splits)
        assert sorted(s[:3] for s in got) == sorted(s[:3] for s in splits)
        pred += 0.5 * value
    scored = {r["id"]: r["pred"] for r in forest.predict(df).collect()}
    assert np.allclose([scored[i] for i in range(len(y))], pred, atol=1e-5)
    assert any(t.unknown_left[t.feature >= 0].any() and not t.unknown_left[t.feature >= 0].all() for t in forest.trees["all"])


def test_many_models_share_jobs_and_do_not_depend_on_partitions(spark, monkeypatch):
    x, y = data(1500, 3)
    y[::50] = np.nan
    df = frame(spark, x, y)
    masks = {f"m{k}": F.col("id") % 3 != k for k in range(3)} | {"none": F.lit(False), "null": F.lit(None).cast("boolean")}
    monkeypatch.setattr(trees, "KEEP", 2)
    settings = dict(trees=5, leaves=8, least_rows=20, column_share=0.5, seed=7)
    a, b = (trees.grow(df.repartition(n), list("abcd"), "y", masks, **settings) for n in (2, 7))
    alone = trees.grow(df.where(masks["m1"]), list("abcd"), "y", {"m0": F.lit(False), "m1": F.lit(True)}, **settings)
    for m in masks:
        for s, t in zip(a.trees[m], b.trees[m]):
            assert all(np.array_equal(getattr(s, k), getattr(t, k)) for k in ("feature", "cut", "unknown_left", "value", "rows"))
    assert len(alone.trees["m1"]) == len(a.trees["m1"]) == 5
    assert a.start["none"] == 0 and all(len(t.feature) == 1 for t in a.trees["none"] + a.trees["null"])
    rows = a.predict(df, F.when(F.col("id") % 4 < 3, F.concat(F.lit("m"), (F.col("id") % 4).cast("string"))), ["id", "y"]).collect()
    assert all((r["pred"] is None) == (r["id"] % 4 == 3) for r in rows)


def test_importance_counts_splits_and_gains(spark):
    x, y = data()
    forest = trees.grow(frame(spark, x, y).withColumn("none", F.lit(None).cast("double")), [*"abcd", "none"], "y", trees=4, leaves=6)
    got = {r["feature"]: (r["importance_split"], r["importance_gain"]) for r in forest.importance(spark).collect()}
    for j, c in enumerate([*"abcd", "none"]):
        mine = [g for t in forest.trees["all"] for f, g in zip(t.feature, t.gain) if f == j]
        assert got[c] == (len(mine), pytest.approx(sum(mine)))
    assert got["none"] == (0, 0) and sum(n for n, _ in got.values()) == 20
    assert max(got, key=lambda c: got[c][1]) == "a"


def test_saved_forests_predict_alike(spark, tmp_path):
    x, y = data(600, 5)
    df = frame(spark, x, y)
    forest = models.fit(df, list("abcd"), "y", trees=3, leaves=9)
    models.save(spark, forest, str(tmp_path / "forest"))
    back = models.load(spark, str(tmp_path / "forest"))
    pred = [sorted(map(tuple, f.predict(df, keep=["id"]).collect())) for f in (forest, back)]
    assert pred[0] == pred[1]
    linear = models.fit_linear(df, list("abcd"), "y")
    models.save(spark, linear, str(tmp_path / "linear"))
    assert models.load(spark, str(tmp_path / "linear"), linear=True) == linear


def test_growth_stops(spark):
    df = frame(spark, *data(300, 1))
    flat = trees.grow(df.withColumn("y", F.lit(2.0)), list("abcd"), "y", trees=2)
    assert flat.start["all"] == pytest.approx(2.0) and all(len(t.feature) == 1 for t in flat.trees["all"])
    shallow = trees.grow(df, list("abcd"), "y", trees=1, depth=2, least_rows=5)
    assert len(shallow.trees["all"][0].feature) == 7
    few = trees.grow(df, list("abcd"), "y", trees=1, least_rows=151)
    assert len(few.trees["all"][0].feature) == 1
    with pytest.raises(ValueError):
        trees.grow(df, [], "y")
    assert trees.grow(df.limit(0), ["a"], "y", trees=1).predict(df, keep=["id"]).where("pred <> 0").count() == 0
