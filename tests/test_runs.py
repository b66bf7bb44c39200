"""Reports, exit models, walk-forward and monthly research."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import exits, models, reports, simulate, splits
from tidemark.plans import monthly, research
from tidemark.plans.feature_sets import FeatureSpec


def states(spark, folds=3, trades=12, ages=4):
    rng = random.Random(5)
    rows = []
    for f in range(folds):
        for t in range(trades):
            for a in range(ages):
                x = rng.gauss(0, 1)
                rows.append(("x", f"fold_{f}", f"e{f}_{t}", t * 100, t * 100 + a, a, x, rng.gauss(0, 1), 3 * x + rng.gauss(0, 0.1), 1.0))
    return spark.createDataFrame(
        rows,
        "symbol string, fold string, episode_id string, entry_minute long, current_minute long, age_minutes int, unrealized_pl_bps double, mkt double, target_exit_hold_delta_bps double, future_price double",
    )


def test_exit_feature_sets(spark):
    df = states(spark).withColumn("entry_score", F.lit(1.0)).withColumn("label_x", F.lit(1.0)).withColumn("note", F.lit("t"))
    assert exits.feature_columns(df, "v0_market_only") == ["mkt"]
    assert exits.feature_columns(df, "v1_score_decay") == ["mkt", "age_minutes", "entry_score"]
    assert exits.feature_columns(df, "v2_score_position") == ["mkt", "age_minutes", "entry_score", "unrealized_pl_bps"]
    assert set(exits.dataset_columns(df)) == {"age_minutes", "unrealized_pl_bps", "mkt", "entry_score", "note"}
    with pytest.raises(ValueError):
        exits.feature_columns(df, "v9")
    with pytest.raises(ValueError):
        exits.feature_columns(df.drop("mkt"), "v0_market_only")
    assert dict(exits.narrowed(df, ["mkt"]).dtypes)["mkt"] == "float"


def test_exit_folds_leave_out_their_trades(spark):
    df = states(spark)
    both = df.unionByName(df.where("episode_id = 'e0_1'").withColumn("fold", F.lit("fold_1")))  # one trade in two folds
    train, own = exits.fold_rows(both, "fold_0")
    assert own.count() == 48 and train.where("episode_id = 'e0_1'").count() == 0 and train.count() == 96
    predicted, gains = exits.cross_fit(df.persist(), "v2_score_position", trees=5, depth=3)
    rows = predicted.collect()
    assert len(rows) == df.count()
    assert np.corrcoef([r["pred"] for r in rows], [r["target_exit_hold_delta_bps"] for r in rows])[0, 1] > 0.8
    assert reports.mean_importance(gains).first()["feature"] == "unrealized_pl_bps"
    for bad in (df.where("fold = 'fold_0'"), df.limit(0), df.drop("episode_id"), df.withColumn("entry_minute", F.lit(None).cast("long"))):
        with pytest.raises(ValueError):
            exits.validate(bad)


def test_entry_candidates(spark):
    rows = [("x", "f", m, float(m)) for m in range(40)] + [("x", None, 100, 9.0), ("x", "f", 200, None), ("y", "f", 5, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, fold string, minute long, score double")
    got = sorted((r["symbol"], r["minute"]) for r in exits.candidates(df, 5, 5.0, 0.5).collect())
    assert got == [("x", 25), ("x", 30), ("x", 35)]  # of 10, 15, ... 35 the upper half; 5 is not over 5
    folds = spark.createDataFrame([("g",)], "fold string")
    assert {tuple(r) for r in exits.unknown_folds(df.where("fold IS NOT NULL"), folds).collect()} == {("x", "f", 41), ("y", "f", 1)}


def test_market_features_that_are_missing(spark):
    bars = spark.createDataFrame([("x", i, 100.0 + i, 101.0 + i, 99.0 + i, 100.5 + i) for i in range(60)], "symbol string, minute long, open double, high double, low double, close double")
    scored = bars.select("symbol", "minute", F.lit("f").alias("fold"), F.lit(1.0).alias("score"))
    market = bars.where("minute <> 15").select("symbol", "minute", F.col("close").alias("mkt"))
    entries = scored.where("minute = 10")
    plain = simulate.exit_positions(bars, entries, scored, 5, 20, 10)
    assert simulate.exit_positions(bars, entries, scored, 5, 20, 10, features=market).count() == plain.count() - 1
    assert [tuple(r) for r in simulate.states_without(plain, market).collect()] == [("x", "f", 1)]


def test_linear_models(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    rows = [(*map(float, r), 1.0, float(2 * r[0] - r[1] + 5)) for r in x] + [(None, 0.0, 0.0, 1.0, 5.0), (1.0, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, one double, y double")
    model = models.fit_linear(df, ["a", "b", "c", "one"], "y", 1e-9)
    assert model.weights[0] == pytest.approx(2, abs=0.1) and model.weights[1] == pytest.approx(-1, abs=0.1) and model.weights[3] == 0
    got = models.predict(model, df, ["a", "b", "c", "one"]).collect()
    assert all(r["pred"] is not None for r in got) and abs(got[3]["pred"] - got[3]["y"]) < 0.2
    gains = {r["feature"]: r["importance_gain"] for r in models.importance(spark, model, ["a", "b", "c", "one"], "f").collect()}
    assert gains["a"] > gains["c"]


def test_walk_forward_looks_back_only(spark):
    m = splits.fractions(400, purge=10)
    df = spark.range(400).select(F.lit("x").alias("symbol"), F.col("id").alias("minute"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 7 * 2.0).alias("target"))
    predicted, past = models.walk_forward(df.persist(), ["a"], "target", m, 5, "rolling", 100, 30, 50, trees=2, depth=2)
    assert predicted.count() == 200 and past.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.max("minute").alias("last")).where("n = 30").count() == 5
    assert past.join(splits.fold_table(spark, m), "fold").where("minute >= start").count() == 0


def test_monthly_segments(spark):
    segments = monthly.segments_of(research.cycles(spark, "2024-01", "2024-03"), most_cycles=2)
    assert {s.cycle_id for s in segments} == {"test_202401", "test_202402"} and len(segments) == 8
    test = next(s for s in segments if s.cycle_id == "test_202401" and s.role == "test")
    assert test.end - test.start == 31 * 1440
    seg = monthly.Segment("c", "valid", "v", 100, 150)
    rows = spark.range(200).select(F.col("id").alias("minute"))
    count = lambda mask: sorted(r[0] for r in rows.where(mask(F.col("minute"))).collect())
    assert count(lambda c: monthly.train_mask(c, seg, 50, 9)) == list(range(50, 90))  # minute + 1 + 9 < 100
    assert count(lambda c: monthly.eval_mask(c, seg)) == list(range(100, 150))
    assert count(lambda c: monthly.history_mask(c, seg, 20, 50, 9)) == list(range(80, 100))
    assert count(lambda c: monthly.history_mask(c, seg, -1, 50, 9)) == list(range(50, 90))


def test_monthly_research_chooses_the_policy_that_knows(spark):
    rng = np.random.default_rng(3)
    n, length = 3000, 500
    signal = rng.normal(size=n)
    price = 100 * np.exp(np.cumsum(np.concatenate([[0, 0], signal[:-2]]) * 1e-3))  # the signal moves the price two minutes later
    rows = [("x", i, float(p), float(p), float(p), float(p), float(signal[i]), float(rng.normal())) for i, p in enumerate(price)]
    bars = spark.createDataFrame(rows, "symbol string, minute long, open double, high double, low double, close double, good double, noise double")
    w = simulate.Window.partitionBy("symbol").orderBy("minute")
    df = bars.withColumn("target", F.ln(F.lead("open", 2).over(w) / F.lead("open", 1).over(w)) * 1e4 - 1).persist()
    families = {"good": ["good"], "noise": ["noise"]}
    wanted = monthly.policies(families)
    assert wanted == {"all_full": ["good", "noise"], "all_minus_good": ["noise"], "all_minus_noise": ["good"]}
    segments = monthly.periods(0, length, 6)
    scored, past = monthly.predictions(df, wanted, "target", segments, train_minutes=length, label_minutes=1, fit=models.fit_linear)
    assert scored.groupBy("cycle_id", "policy", "fold").count().count() == 24
    paths = simulate.path_stats(bars, 1)
    results = monthly.evaluate(scored, past, paths, 0.9, 0.0, 50, 1, 0)
    candidates, best, tested = monthly.select(results, {p: k for k, p in enumerate(wanted)}, min_count=1, min_active=1)
    assert {r["policy"] for r in best.collect()} <= {"all_full", "all_minus_noise"} and tested.count() == 2
    assert all(r["net_pl_bps_sum"] > 0 for r in tested.collect())
    more = monthly.with_combined_drops(wanted, families, candidates)
    assert all(set(columns) < {"good", "noise"} for p in more.values() for columns in p.values())


def test_summaries(spark):
    rates = spark.createDataFrame([(f"f{i:02d}", i / 30) for i in range(30)], "feature string, null_rate double")
    counts, worst, families = reports.feature_summary(rates, [FeatureSpec(f"f{i:02d}", "a" if i < 10 else "b", 1) for i in range(30)])
    assert tuple(counts.first()) == (30, 14, 1) and worst.count() == 20 and worst.first()["feature"] == "f29"
    assert dict(map(tuple, families.collect())) == {"a": 10, "b": 20} and reports.mostly_null(rates).count() == 1
    df = spark.createDataFrame([("base", "long", 60, 1.0), ("new", "long", 60, 3.0), ("new", "short", 60, 5.0)], "variant string, side string, horizon_minutes int, m double")
    got = {(r["variant"], r["side"]): r["delta_vs_base_m"] for r in reports.baseline_deltas(df, "base", ["m"]).collect()}
    assert got == {("base", "long"): 0.0, ("new", "long"): 2.0, ("new", "short"): None}
    assert sorted(r["delta_vs_base_m"] for r in reports.baseline_deltas(df, "base", ["m"], ()).collect()) == [0.0, 2.0, 4.0]
    chosen = spark.createDataFrame([("a", "p", 1.0), ("a", "p", 3.0), ("a", None, 5.0), ("b", "q", 2.0)], "run string, policy string, net double")
    top = reports.selected_policies(chosen, ["net"]).collect()
    assert [(r["run"], r["policy"], r["cycle_count"], r["mean_net"]) for r in top][0] == ("a", "p", 2, 2.0) and len(top) == 3
    compared = {r["run"]: r for r in reports.run_comparison(chosen, "net").collect()}
    assert compared["a"]["policies"] == {"none": 1, "p": 2} and compared["a"]["min"] == 1.0
    one = spark.createDataFrame([(2.0, 4.0, 9.0, None)], "a double, b double, f double, none double")
    assert one.select(reports.robust_score(["a", "b"], {"a": 0.5, "b": 0.25, "absent": 9.0})).first()[0] == 2.0
    assert one.select(reports.episode_score(F.col("a"), F.col("b"), F.col("f")), reports.episode_score(F.col("none"), F.col("b"), F.col("none"))).first() == (5.5, 2.0)
    assert one.select(reports.fallback_score(F.col("a"), F.col("b"), F.lit(3), 10)).first()[0] == 4.0 - 1e6


def test_quality_report(spark, tmp_path):
    from tidemark.operators import quality

    rows = [("x", i, 1.0, 1.0, 1.0, 1.0, 0.0 if i in (2, 3, 7) else 1.0) for i in range(9) if i != 5] + [("x", 8, 1.0, 0.5, 1.0, 1.0, -1.0)]
    df = spark.createDataFrame(rows, "symbol string, minute long, open double, high double, low double, close double, volume double").withColumn("ts", F.timestamp_seconds(F.col("minute") * 60))
    reports.write_report(str(tmp_path / "q"), quality.report(df))
    count = {n: spark.read.parquet(str(tmp_path / "q" / n)).count() for n in ("summary", "invalid_rows", "duplicate_rows", "missing_minutes", "zero_volume_rows", "zero_volume_runs", "negative_volume_rows")}
    assert count == {"summary": 1, "invalid_rows": 1, "duplicate_rows": 2, "missing_minutes": 1, "zero_volume_rows": 3, "zero_volume_runs": 2, "negative_volume_rows": 1}


def test_runs_and_closed_bars_do_not_depend_on_chunks(spark, monkeypatch):
    from tidemark.operators import quality, series

    rng = random.Random(2)
    rows = [(s, i, 1.0, 1.0, 1.0, float(i), float(rng.random() < 0.4)) for s in "xy" for i in range(400) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "symbol string, minute long, open double, high double, low double, close double, volume double")
    closed = series.resampled(df.where("minute % 50 < 20"), 5).select("symbol", "bucket", F.col("close").alias("c"))
    got = []
    for chunk in (3, 10_000):
        monkeypatch.setattr(series, "CARRY", chunk)
        monkeypatch.setattr(quality, "RUN_CHUNK", chunk)
        runs = quality.zero_volume_runs(series.indexed(df))
        got.append((sorted(map(tuple, runs.collect())), sorted(map(tuple, series.last_closed(df.select("symbol", "minute"), closed, 5, ["c"]).collect()), key=str)))
    assert got[0] == got[1] and got[0][0] and any(c is not None for _, _, c in got[0][1])


def test_files_of_runs(spark, tmp_path):
    for k, text in (("a", "x,y\n1,2\n"), ("b/deep", "y,z\n5,6\n")):
        (tmp_path / k).mkdir(parents=True)
        (tmp_path / k / "fold_metrics.csv").write_text(text)
        (tmp_path / k / "summary.json").write_text(json.dumps({"run": k, "skipped": {"cooldown": 3} if k == "a" else {"daily_cap": 1}}))
    rows = sorted(reports.collect_runs(spark, str(tmp_path), "fold_metrics.csv").collect(), key=lambda r: r["source_file"])
    assert [(r["x"], r["y"], r["z"]) for r in rows] == [("1", "2", None), (None, "5", "6")] and rows[1]["source_run_dir"].endswith("b/deep")
    with pytest.raises(FileNotFoundError):
        reports.collect_runs(spark, str(tmp_path), "none.csv")
    got = {r["run"]: (r["skipped_cooldown"], r["skipped_daily_cap"]) for r in reports.run_summaries(spark, str(tmp_path)).collect()}
    assert got == {"a": (3, 0), "b/deep": (0, 1)}
    snap = reports.snapshot(spark, [str(tmp_path / "a" / "fold_metrics.csv")]).first()
    assert snap["sha256"] == hashlib.sha256(b"x,y\n1,2\n").hexdigest() and snap["length"] == 8
    reports.write_report(str(tmp_path / "out"), {"episodes": spark.createDataFrame([("f", 1.0)], "fold string, net_pl_bps double")}, {"episodes": "fold"})
    assert spark.read.parquet(str(tmp_path / "out" / "episodes")).count() == 1
    spark.createDataFrame([(1,)], "a int").write.parquet(str(tmp_path / "run" / "episodes.parquet"))
    assert reports.read_episodes(spark, str(tmp_path / "run")).count() == 1
    with pytest.raises(FileNotFoundError):
        reports.read_episodes(spark, str(tmp_path / "a"))
