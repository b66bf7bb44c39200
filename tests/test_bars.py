"""Reading, auditing, labels, splits, trades, research."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import labels as lab
from tidemark.operators import metrics, models, quality, simulate, splits
from tidemark.operators.series import indexed
from tidemark.plans import research
from tidemark.sources import bars as src


def bars(spark, rows):
    df = spark.createDataFrame(rows, "minute long, open double, high double, low double, close double, volume double")
    return df.select(F.lit("x").alias("symbol"), F.timestamp_seconds(F.col("minute") * 60).alias("ts"), "*")


def of(df, symbol="x"):
    return df.withColumn("symbol", F.lit(symbol))


def line(spark, n, skip=()):
    return bars(spark, [(i, 100.0 + i, 101.0 + i, 99.0 + i, 100.5 + i, float(i % 3)) for i in range(n) if i not in skip])


def test_normalize_and_read(spark, tmp_path):
    raw = spark.createDataFrame([(1700000000, "1", "2", "1", "x", "5"), (1700000060, "1", "2", "1", "1.5", "nan")], "`Open Time` long, O string, H string, L string, C string, Vol string")
    rows = src.normalize(raw).orderBy("minute").collect()
    assert rows[0]["minute"] == 1700000000 // 60 and rows[0]["close"] is None and rows[1]["volume"] is None
    again = src.normalize(raw.union(raw), drop_duplicates=True)
    assert again.count() == 2
    with pytest.raises(src.SchemaError):
        src.normalize(raw.drop("C"))
    folder = str(tmp_path / "in")
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a.csv").write_text("1700000000000,1,2,0.5,1.5,10,1700000059999,1,1,1,1,0\n")
    got = src.read_bars(spark, folder).collect()
    assert len(got) == 1 and got[0]["high"] == 2.0 and got[0]["minute"] == 28333333
    src.write_bars(src.read_bars(spark, folder), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_audit(spark):
    rows = [(0, 1.0, 2.0, 1.0, 1.0, 0.0), (1, 1.0, 2.0, 1.0, 1.0, 0.0), (1, 1.0, 0.5, 1.0, 1.0, -1.0), (4, None, 2.0, 1.0, 1.0, 0.0), (5, 0.0, 2.0, 1.0, 1.0, 3.0)]
    df = bars(spark, rows)
    got = quality.audit(df).first().asDict()
    assert got["duplicate_count"] == 2 and got["missing_minute_count"] == 2 and got["null_required_count"] == 1 and got["non_monotonic_count"] == 1 and not got["passed"]
    reasons = {r["minute"]: r["reasons"] for r in quality.invalid_rows(df).collect()}
    assert reasons[1] == "high_below_low;high_below_open;high_below_close;negative_volume" and reasons[4] == "null_required" and reasons[5].startswith("open_non_positive")
    runs = quality.zero_volume_runs(indexed(line(spark, 10))).collect()
    assert sorted((r["start_minute"], r["length"]) for r in runs) == [(0, 1), (3, 1), (6, 1), (9, 1)]


def test_labels_look_at_minutes(spark):
    df = line(spark, 80, skip=(62,))
    got = {r["minute"]: r for r in lab.entry_labels(df, (60,)).collect()}
    want = math.log(161 / 101) * 1e4 - 15
    assert got[0]["target_entry_net_bps_long_H60"] == pytest.approx(want)
    assert got[0]["target_entry_net_bps_short_H60"] == pytest.approx(-(want + 15) - 15)
    assert got[1]["target_entry_net_bps_long_H60"] is None and got[79]["target_entry_net_bps_long_H60"] is None
    ex = {r["minute"]: r for r in lab.excursions(df, (5,)).collect()}
    assert ex[0]["diag_mfe_bps_long_H5"] == pytest.approx(math.log(106 / 101) * 1e4) and ex[60]["diag_mfe_bps_long_H5"] is None
    assert lab.side_sign("Buy") == 1
    with pytest.raises(ValueError):
        lab.side_sign("up")


def test_splits():
    m = splits.fractions(1000)
    assert [f.start for f in m.folds] == [400, 500, 600, 700, 800]
    with pytest.raises(ValueError):
        splits.Manifest(m.train, m.valid, m.test, m.folds[:4])
    with pytest.raises(ValueError):
        splits.Manifest(m.train, m.valid, m.test, (m.folds[1], m.folds[0], *m.folds[2:]))


def test_purge(spark):
    m = splits.fractions(1000)
    rows = splits.roles(spark.range(1000).select(F.col("id").alias("minute")), m, 60)
    last = rows.where("role = 'train'").groupBy("fold").agg(F.max("minute")).collect()
    assert dict(map(tuple, last)) == {"fold_01": 338, "fold_02": 399, "fold_03": 399, "fold_04": 399, "fold_05": 399}


def test_fixed_hold_order_of_checks(spark):
    rows = [("f", m, 5.0, None, 1.0, 1.1 if m != 3 else None) for m in range(12)] + [("f", 12, 0.0, "below_threshold", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "fold string, minute long, score double, skip_reason string, entry_price double, exit_price double")
    got = {r["minute"]: r["decision"] for r in simulate.fixed_hold(of(df), 1, 1, daily_cap=3).collect()}
    assert got == {0: "entered", 1: "cooldown", 2: "cooldown", 3: "missing_price_path", 4: "entered", 5: "cooldown", 6: "cooldown", 7: "entered", 8: "cooldown", 9: "cooldown", 10: "daily_cap", 11: "daily_cap", 12: "below_threshold"}


def test_symbols_do_not_touch(spark):
    """Two series at once give what each gives alone: thresholds, trades, skip reasons, positions, exits, metrics."""
    rng = random.Random(4)
    sets = {}
    for symbol in ("x", "y"):
        price, rows = 100.0, []
        for i in range(900):
            price *= math.exp(rng.gauss(0, 0.001))
            if rng.random() > 0.01:
                rows.append((symbol, i, price, price * 1.001, price * 0.999, price * 1.0002, 1.0))
        b = spark.createDataFrame(rows, "symbol string, minute long, open double, high double, low double, close double, volume double")
        scored = spark.createDataFrame([(symbol, i, "f" if i < 500 else "g", rng.gauss(0, 30)) for i in range(900)], "symbol string, minute long, fold string, score double")
        sets[symbol] = (b, scored)

    def everything(b, scored):
        thresholds = simulate.rolling_quantile(scored, 60, 0.8, 20)
        rows = scored.join(simulate.path_stats(b, 10), ["symbol", "minute"], "left").withColumn("skip_reason", simulate.entry_rule(F.col("score"), F.lit(20.0)))
        trades = simulate.fixed_hold_episodes(simulate.entered(rows, 10, 5, 20), 10, "short")
        states = simulate.exit_positions(b, scored.where("score > 40"), scored, 5, 20, 10, "short")
        exits = simulate.model_exit_episodes(scored.where("score > 40").withColumn("skip_reason", F.lit(None).cast("string")), states.withColumn("pred", F.col("current_score")), 1, 50.0, 20, 5)
        return [
            thresholds, simulate.fixed_hold(rows, 10, 5, 20), simulate.skip_counts(simulate.fixed_hold(rows, 10, 5)), trades, states, exits, metrics.episode_metrics(trades, scored),
            metrics.overlap_groups(metrics.overlap(trades, trades.where("fold = 'f'"))), simulate.history_threshold(scored, 0.5, 0.0, 5), research.recent(scored, 7),
        ]

    both = everything(sets["x"][0].union(sets["y"][0]), sets["x"][1].union(sets["y"][1]))
    one, two = everything(*sets["x"]), everything(*sets["y"])
    for all_, a, b in zip(both, one, two):
        rows = lambda df: Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
        got = rows(all_)
        assert got == rows(a) + rows(b) and got


def test_entries_are_those_of_a_plain_loop(spark):
    rng = random.Random(7)
    rows = [("f", m, rng.random(), None if rng.random() < 0.3 else "below_threshold", 1.0, None if rng.random() < 0.1 else 1.0) for m in range(6000)]
    for cap in (None, 4):
        want, free, trips = [], -1, Counter()
        for _, m, _, why, _, x in rows:
            if m < free:
                want.append("cooldown")
            elif why:
                want.append(why)
            elif cap and trips[m // 1440] >= cap:
                want.append("daily_cap")
            elif x is None:
                want.append("missing_price_path")
            else:
                want.append("entered")
                free, trips[m // 1440] = m + 1 + 20 + 7, trips[m // 1440] + 1
        df = of(spark.createDataFrame(rows, "fold string, minute long, score double, skip_reason string, entry_price double, exit_price double"))
        got = {r["minute"]: r["decision"] for r in simulate.fixed_hold(df, 20, 7, cap).collect()}
        assert [got[m] for m in range(6000)] == want


def test_rolling_quantile_blocks(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"fold": "f", "minute": np.sort(rng.choice(500, 200, False)), "score": rng.normal(size=200)})
    got = simulate.rolling_quantile(of(spark.createDataFrame(pdf)), 60, 0.9, 5).toPandas().sort_values("minute")
    s = pd.Series(pdf["score"].to_numpy(), index=pd.to_datetime(pdf["minute"] * 60, unit="s")).rolling("60min", closed="left", min_periods=5)
    np.testing.assert_allclose(got["rolling_thr"].astype(float), s.quantile(0.9).to_numpy())


def test_model_exit(spark):
    entries = spark.createDataFrame([("f", 0, 9.0, None), ("f", 3, 9.0, None), ("f", 60, 9.0, None)], "fold string, minute long, score double, skip_reason string")
    states = spark.createDataFrame(
        [("f", 0, 5, 1.0, 0.0, 1.0), ("f", 0, 10, -1.0, 0.0, 2.0), ("f", 0, 15, -1.0, 0.0, 3.0), ("f", 0, 20, 1.0, 0.0, 4.0), ("f", 60, 5, 1.0, -80.0, -70.0)],
        "fold string, entry_minute long, age_minutes int, pred double, mae_since_entry_bps double, unrealized_pl_bps double",
    )
    got = {r["minute"]: r for r in simulate.model_exit_episodes(of(entries), of(states), 2, 50.0, 60, 10).collect()}
    assert got[0]["decision"] == "entered" and got[0]["exit_reason"] == "exit_signal" and got[0]["hold_minutes"] == 15
    assert got[3]["decision"] == "cooldown" and got[60]["exit_reason"] == "hard_stop"


def test_metrics_without_trades(spark):
    eps = spark.createDataFrame([], "fold string, net_pl_bps double, gross_pl_bps double, hold_minutes int, entry_minute long, roundtrip_cost_bps double, mfe_bps double, mae_bps double, giveback_bps double")
    row = metrics.episode_metrics(of(eps), of(spark.createDataFrame([("a",)], "fold string"))).first()
    assert row["episode_count"] == 0 and row["net_pl_bps_sum"] == 0 and row["win_rate"] is None


def test_decile_sizes(spark):
    df = spark.range(23).select(F.lit("f").alias("fold"), F.col("id").alias("minute"), F.lit(1.0).alias("score"), F.lit(1.0).alias("target"))
    got = [r["count"] for r in metrics.deciles(of(df), "target", "score", "minute").orderBy("decile").collect()]
    assert got == [3, 2, 2, 2, 3, 2, 2, 2, 2, 3]


def test_selector_and_ties(spark):
    df = spark.createDataFrame([("c", "a_full", 0, "f1", 10.0, 5), ("c", "a_full", 0, "f2", -2.0, 6), ("c", "a_minus_x", 1, "f1", 10.0, 5), ("c", "a_minus_x", 1, "f2", -2.0, 6), ("c", "a_minus_y", 2, "f1", 90.0, 1)], "cycle_id string, policy string, policy_index int, fold string, net_pl_bps_sum double, episode_count int")
    got = research.selector(df, ("cycle_id", "policy", "policy_index"))
    rows = {r["policy"]: r for r in got.collect()}
    assert rows["a_full"]["robust_score"] == pytest.approx(8 - 1 + 1) and rows["a_minus_y"]["selector_failed_constraints"] == "min_total_episode_count,min_active_fold_count"
    assert research.chosen(got).first()["policy"] == "a_full"
    assert research.combined_drops(research.ablation_deltas(got, "selector_raw_score")).first()["drop_families"] == ["y"]
    assert research.cycles(spark, "2024-01", "2024-03").count() == 12


def test_history_threshold_and_guards(spark):
    past = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", 1.0)], "fold string, score double")
    got = {r["fold"]: r["threshold"] for r in simulate.history_threshold(of(past), 0.5, 0.0, 5).collect()}
    assert got["a"] == 4.5 and got["b"] == math.inf
    bad = spark.createDataFrame([("x", 1, False)], "symbol string, minute long, is_oof boolean")
    with pytest.raises(ValueError):
        models.combined({"r": bad})
    assert models.feature_columns(spark.createDataFrame([(1.0, 2.0, "x")], "a double, target_b double, c string")) == ["a"]


def test_stream(spark, tmp_path):
    from tidemark.streaming.bars import closed_bars

    folder = str(tmp_path / "events")
    spark.range(200).select(F.timestamp_seconds(F.col("id") * 30).alias("ts"), F.col("id").alias("event_id"), F.col("id").cast("double").alias("value")).write.parquet(folder)
    stream = spark.readStream.schema("ts timestamp, event_id long, value double").parquet(folder)
    q = closed_bars(stream, 15).writeStream.outputMode("append").format("memory").queryName("bars_out").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("SELECT * FROM bars_out ORDER BY start").collect()
    assert len(rows) == 5 and rows[0]["open"] == 0.0 and rows[0]["close"] == 29.0
