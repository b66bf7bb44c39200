"""Folds as a table, trades found in spans, and sweeps of whole policies, each against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fold_tables, simulate, splits
from tidemark.plans import research

ROWS = "symbol string, fold string, minute long, score double, skip_reason string, entry_price double, exit_price double"


def plain(minutes, gap, cap):
    """The minutes that enter, one after the other."""
    out, free, trips = [], None, {}
    for m in sorted(minutes):
        if (free is None or m >= free) and (cap is None or trips.get(m // 1440, 0) < cap):
            out.append(m)
            free, trips[m // 1440] = m + gap, trips.get(m // 1440, 0) + 1
    return out


@pytest.mark.parametrize("cap", [None, 1, 3])
@pytest.mark.parametrize("hold,block,density", [(20, 7, 0.7), (600, 0, 0.05), (2000, 900, 0.02), (0, 0, 0.3)])
def test_spans_do_not_change_who_enters(spark, cap, hold, block, density):
    rng = random.Random(hold + (cap or 0))
    rows = [(s, f, m, 1.0, None, 1.0, 1.0) for s in "xy" for f, a in (("a", -3000), ("b", 5000)) for m in range(a, a + 7000) if rng.random() < density]
    df = spark.createDataFrame(rows, ROWS)
    got = {}
    for r in simulate.entered(df, hold, block, cap, days=1).collect():
        got.setdefault((r["symbol"], r["fold"]), []).append(r["minute"])
    for s in "xy":
        for f in "ab":
            want = plain([m for t, g, m, *_ in rows if (t, g) == (s, f)], 1 + hold + block, cap)
            assert sorted(got[s, f]) == want


def test_rows_that_cannot_enter(spark):
    df = spark.createDataFrame([("x", "a", None, 1.0, None, 1.0, 1.0), ("x", "a", 5, 1.0, None, 1.0, 1.0), ("x", "a", 5, 2.0, None, 1.0, 1.0), ("x", "b", 5, 1.0, "why", 1.0, 1.0), ("x", None, 7, 1.0, None, 1.0, 1.0)], ROWS)
    assert sorted((r["fold"] or "", r["minute"]) for r in simulate.entered(df, 3, 0).collect()) == [("", 7), ("a", 5)]
    assert simulate.entered(df.limit(0), 3, 0).count() == 0 and simulate.entered(df, 3, 0, daily_cap=0).count() == 0


def test_candidates_are_shuffled_once(spark):
    df = spark.createDataFrame([("x", "a", m, 1.0, None, 1.0, 1.0) for m in range(0, 9000, 7)], ROWS)
    out = simulate.entered(df, 20, 7)
    out.collect()
    assert "Reused" in out._jdf.queryExecution().executedPlan().toString()


def bars(spark, n=1500, symbols="xy"):
    rng = random.Random(3)
    rows = []
    for s in symbols:
        price = 100.0
        for m in range(n):
            close = price * (1 + rng.gauss(0, 0.001))
            if rng.random() > 0.004:
                rows.append((s, m, price, max(price, close) * 1.0005, min(price, close) * 0.9995, close, 1.0))
            price = close
    return spark.createDataFrame(rows, "symbol string, minute long, open double, high double, low double, close double, volume double")


def test_paths_of_several_holds_are_those_of_each(spark):
    b = bars(spark)
    names = ["symbol", "minute", "entry_price", "exit_price", "path_high", "path_low"]
    many = simulate.paths(b, (1, 15, 64))
    for h in (1, 15, 64):
        one = simulate.path_stats(b, h).select(names)
        assert one.exceptAll(many.where(F.col("hold_minutes") == h).select(names)).isEmpty() and many.where(F.col("hold_minutes") == h).count() == one.count()


def test_policies_together_are_those_one_by_one(spark):
    b = bars(spark).persist()
    rng = random.Random(4)
    scored = spark.createDataFrame([(s, "a" if m < 700 else "b", m, rng.gauss(0, 20)) for s in "xy" for m in range(1500)], "symbol string, fold string, minute long, score double")
    grid = research.policy_grid(spark, (-5.0, 20.0), (10, 45), (None, 30.0), (None, 2.5), (None, 1.5))
    assert grid.count() == 32 and {"t-5_h10", "t20_h45_s30_m2.5_r1.5"} <= {r["params"] for r in grid.collect()}
    got = {(r["params"], r["symbol"], r["fold"]): (r["episode_count"], round(r["net_pl_bps_sum"], 6)) for r in research.policy_sweep(scored, b, grid, 5, daily_cap=9).collect()}
    assert len(got) == 32 * 4
    for p in grid.where("params IN ('t-5_h10', 't20_h45', 't20_h10_s30', 't-5_h45_m2.5', 't20_h10_s30_m2.5_r1.5', 't-5_h10_r1.5')").collect():
        one = research.policy_grid(spark, (p["threshold"],), (p["hold_minutes"],)).select(F.lit(p["params"]).alias("params"), "threshold")
        rule = simulate.entry_rule(F.col("score"), F.lit(p["threshold"]), p["min_score"], p["min_margin"], p["min_ratio"])
        rows = scored.join(simulate.path_stats(b, p["hold_minutes"]), ["symbol", "minute"]).withColumn("skip_reason", rule)
        trades = simulate.fixed_hold_episodes(simulate.entered(rows, p["hold_minutes"], 5, 9), p["hold_minutes"])
        want = {(r["symbol"], r["fold"]): (r["n"], round(r["net"], 6)) for r in trades.groupBy("symbol", "fold").agg(F.count("*").alias("n"), F.sum("net_pl_bps").alias("net")).collect()}
        for s in "xy":
            for f in "ab":
                assert got[one.first()["params"], s, f] == want.get((s, f), (0, 0.0))
    assert got["t-5_h10_r1.5", "x", "a"] == (0, 0.0)  # no ratio to a threshold that is not above 0
    for bad in (grid.limit(0), grid.unionByName(grid), grid.withColumn("hold_minutes", F.lit(None).cast("int"))):
        with pytest.raises(ValueError):
            research.policy_sweep(scored, b, bad, 5)


# --- folds as a table -----------------------------------------------------------------------------------------------------
def test_fold_table_is_the_manifest(spark):
    rows = spark.createDataFrame([("x", m) for m in range(-5, 4000)] + [("z", 7), ("x", None), (None, 7)], "symbol string, minute long")
    m = splits.fractions(4000, embargo=50)
    folds = fold_tables.of_manifest(spark, {"x": m})
    even = fold_tables.even(spark.createDataFrame([("x", 0, 3999, 5)], "symbol string, first long, last long, folds int"), 50)
    assert sorted(map(tuple, even.collect())) == sorted(map(tuple, folds.collect()))
    assert fold_tables.checked(folds) is folds
    minute, x = F.col("minute"), rows.where("symbol = 'x'")
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(fold_tables.roles(rows, folds, 60).select("fold", "role", "minute"), splits.roles(x.select("minute"), m, 60).select("fold", "role", "minute"))
    named = fold_tables.fold_of(rows, folds)
    assert named.count() == rows.count()
    assert same(named.where("symbol = 'x' AND minute IS NOT NULL").select("minute", "fold"), x.where("minute IS NOT NULL").select("minute", splits.fold_of(minute, m).alias("fold")))
    assert named.where("(symbol IS NULL OR symbol = 'z' OR minute IS NULL) AND fold IS NOT NULL").isEmpty()
    for f in m.folds:
        walked = fold_tables.met(rows, fold_tables.walk_forward(folds, 60, 500)).where(F.col("fold") == f.name)
        for mode in ("fixed", "expanding", "rolling"):
            assert same(walked.where(F.col("role") == mode).select("minute"), x.where(splits.walk_forward_train(minute, m, f, mode, 60, 500)).select("minute"))
        past = fold_tables.met(rows, fold_tables.history(folds, 300)).where(F.col("fold") == f.name)
        assert same(past.select("minute"), x.where(splits.history(minute, f, 300)).select("minute"))


def test_folds_inside_the_training_range_and_embargo(spark):
    """A fold may lie within its training range: rows on both sides train, clear of labels and embargo."""
    folds = spark.createDataFrame([("x", "f", 1000, 1099, 0, 1999, 20)], fold_tables.SCHEMA)
    rows = spark.createDataFrame([("x", m) for m in range(2000)], "symbol string, minute long")
    got = {r["minute"] for r in fold_tables.roles(rows, folds, 30).where("role = 'train'").collect()}
    assert got == {m for m in range(2000) if not (m <= 1099 and m + 31 >= 1000) and not 1099 < m <= 1119}


def test_wrong_folds_are_named(spark):
    rows = [("x", "a", 10, 20, 0, 9, 0), ("x", "b", 20, 30, 0, 9, 0), ("x", "b", 40, 35, 0, 9, -1), ("x", "c", 25, 26, 0, 9, 0), ("y", "a", 5, 8, 0, 5, 0), ("y", "c", None, 8, 0, 5, 0), ("z", "a", 5, 8, 0, 4, 0)]
    folds = spark.createDataFrame(rows, fold_tables.SCHEMA)
    got = sorted(tuple(r) for r in fold_tables.problems(folds).collect())
    assert got == sorted([
        ("x", "b", "overlaps a fold before"), ("x", "b", "name stands twice"), ("x", "b", "name stands twice"), ("x", "b", "start after end"), ("x", "b", "negative embargo"), ("x", "c", "overlaps a fold before"),
        ("y", "a", "training not before the fold"), ("y", "c", "unknown value"),
    ])
    with pytest.raises(ValueError, match="x b: name stands twice"):
        fold_tables.checked(folds)
    with pytest.raises(ValueError, match="fold"):
        fold_tables.fold_of(spark.createDataFrame([("x", 1, "a")], "symbol string, minute long, fold string"), folds)
