"""Position states with the features of their minutes: as joined to a matrix, without shuffling one."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tests.test_timeframes import _widths
from tidemark.operators import exits, simulate
from tidemark.plans import matrix


def _bars(spark, n=400):
    price = 100 + np.cumsum(np.random.default_rng(1).normal(size=n)).round(2)
    pdf = pd.DataFrame({"symbol": "x", "minute": np.arange(n), "open": price, "high": price + 1, "low": price - 1, "close": price, "volume": 5.0})
    return spark.createDataFrame(pdf)


def test_market_features_go_to_states_without_a_wide_shuffle(spark):
    bars = _bars(spark)
    scored = bars.select("symbol", "minute", F.when(F.col("minute") >= 100, F.when(F.col("minute") < 250, "a").otherwise("b")).alias("fold"), (F.col("close") - 90).alias("score"))
    entries = exits.candidates(scored, 5)
    families = ("price", "return_path", "volatility")
    states = simulate.exit_positions(bars, entries, scored, 5, 20, 10, "short").persist()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as tables of any size are joined
    try:
        got = simulate.with_market(states, bars, lambda df, carried, only: matrix.build(df, families, (carried,), only))
        want = simulate.exit_positions(bars, entries, scored, 5, 20, 10, "short", matrix.build(bars, families))
        plan = [df._jdf.queryExecution().executedPlan() for df in (got, want)]
        wide = [max(_widths(p.initialPlan() if p.nodeName() == "AdaptiveSparkPlan" else p)) for p in plan]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got.columns == want.columns and got.count() == want.count() > 100
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    width = len(matrix.build(bars, families).columns)
    assert wide[0] < 20 < width <= wide[1], wide


def test_only_some_rows_of_a_matrix(spark):
    bars = _bars(spark).withColumn("tag", F.when(F.col("minute") % 7 == 0, "t"))
    for families in (("return_path", "volatility"), ("anchored_timeframe_candle_lite",)):
        whole = matrix.build(bars, families, ("tag",))
        some = matrix.build(bars, families, ("tag",), F.col("tag").isNotNull())
        assert sorted(map(str, some.collect())) == sorted(map(str, whole.where("tag IS NOT NULL").collect()))


def test_states_do_not_move_to_learn_their_trades_folds(spark):
    """A trade that two folds evaluate trains neither; a join of all states told so before."""
    rng = np.random.default_rng(3)
    rows = [(f"e{i}", f, i, i + a, a, float(rng.normal()), float(rng.normal())) for i in range(60) for f in (("a", "b") if i % 20 == 0 else ("a",) if i % 2 else ("b",)) for a in (5, 10, 15)]
    states = spark.createDataFrame(rows, f"episode_id string, fold string, entry_minute long, current_minute long, age_minutes long, x double, {exits.TARGET} double").withColumn("symbol", F.lit("x"))
    predicted, gains = exits.cross_fit(states, "v0_market_only", keep=["fold", "episode_id"], trees=1, leaves=2, least_rows=5)
    assert predicted.columns == ["fold", "episode_id", "pred"] and predicted.count() == len(rows)
    forest_rows = {f: sum(1 for r in rows if r[1] != f and not (r[2] % 20 == 0)) for f in "ab"}
    seen = {}
    grow = exits.trees.grow

    def spy(df, columns, target, masks, **params):
        seen.update({f: df.where(m).count() for f, m in masks.items()})
        seen["plan"] = df._jdf.queryExecution().executedPlan().toString()
        return grow(df, columns, target, masks, **params)

    exits.trees.grow = spy
    try:
        exits.cross_fit(states, "v0_market_only", trees=1, leaves=2, least_rows=5)
    finally:
        exits.trees.grow = grow
    assert {f: seen[f] for f in "ab"} == forest_rows
    assert "BroadcastHashJoin" in seen["plan"] and "SortMergeJoin" not in seen["plan"]
