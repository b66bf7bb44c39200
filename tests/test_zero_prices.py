"""Prices of 0: log ratios by IEEE arithmetic, as SQL has them, neither an error nor NULL."""

import math

from pyspark.sql import functions as F

from tidemark.operators import simulate, trees

INF = float("inf")


def same(a, b):
    return a == b or (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, abs_tol=1e-9)


def test_exit_positions_over_zero_prices(spark):
    close = [1.0 + m % 7 for m in range(60)]
    close[20] = close[26] = close[31] = close[36] = 0.0
    bars = [("x", m, close[m - 1] if m else 1.0, max(close[m], close[m - 1]), min(close[m], close[m - 1]), close[m]) for m in range(60)]
    bars = spark.createDataFrame(bars, "symbol string, minute long, open double, high double, low double, close double")
    entries = spark.createDataFrame([("x", "f", m, 9.0) for m in (18, 20, 30)], "symbol string, fold string, minute long, score double")
    rows = {(r["entry_minute"], r["age_minutes"]): r for r in simulate.exit_positions(bars, entries, entries.drop("fold"), 3, 9, 10).collect()}
    assert len(rows) == 9
    ln = lambda x: -INF if x == 0 else math.log(x)
    for (entry, age), r in rows.items():
        p, path = close[entry], range(entry + 1, entry + age + 1)
        high, low = (f(f(close[m], close[m - 1]) for m in path) for f in (max, min))
        ratio = lambda a, b: ln(a / b) * 1e4 if b else (INF if a else math.nan)
        assert same(r["unrealized_pl_bps"], ratio(close[entry + age], p)) and same(r["mfe_since_entry_bps"], ratio(high, p)) and same(r["mae_since_entry_bps"], ratio(low, p)), (entry, age)
        assert same(r["target_exit_hold_delta_bps"], ratio(close[entry + age + 10], close[entry + age])), (entry, age)


def test_episodes_over_zero_prices(spark):
    rows = [("x", "f", 0, 1.0, 2.0, 0.0, 4.0, 0.0), ("x", "f", 100, 1.0, 0.0, 3.0, 4.0, 0.0)]
    rows = spark.createDataFrame(rows, "symbol string, fold string, minute long, score double, entry_price double, exit_price double, path_high double, path_low double")
    a, b = simulate.fixed_hold_episodes(rows, 60).orderBy("entry_minute").collect()
    assert a["gross_pl_bps"] == a["net_pl_bps"] == a["mae_bps"] == -INF and a["giveback_bps"] == INF and math.isclose(a["mfe_bps"], math.log(2) * 1e4)
    assert b["gross_pl_bps"] == b["mfe_bps"] == INF and math.isnan(b["mae_bps"]) and math.isnan(b["giveback_bps"])
    short = simulate.fixed_hold_episodes(rows, 60, "short").orderBy("entry_minute").first()
    assert short["gross_pl_bps"] == INF and short["mfe_bps"] == INF and math.isnan(short["giveback_bps"])


def test_infinite_targets_train_nothing(spark):
    rows = [(float(i), float(i % 2)) for i in range(400)] + [(3.0, INF), (4.0, -INF), (5.0, math.nan)]
    df = spark.createDataFrame(rows, "x double, y double").withColumn("part", (F.col("x") % 2))
    forest = trees.grow(df, ["x", "part"], "y", trees=3, leaves=4, rate=1.0)
    pred = [r["pred"] for r in forest.predict(df).collect()]
    assert all(map(math.isfinite, pred)) and all(abs(p - r[1]) < 0.05 for p, r in zip(pred[:400], rows))
