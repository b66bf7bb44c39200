"""Files of many runs read at once, reports as tables, and what runs follow."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import models, reports
from tidemark.plans import research


def test_many_files_of_many_layouts_are_two_scans(spark, tmp_path):
    want = []
    for k in range(60):
        (tmp_path / f"r{k}").mkdir()
        names = ["fold", "net", f"x{k % 7}"] if k % 2 else [f"x{k % 7}", "net", "fold"]
        value = {"fold": f"f{k}", "net": str(k), f"x{k % 7}": "a,b" if k % 5 == 0 else "z"}
        line = ",".join(f'"{value[n]}"' if "," in value[n] else value[n] for n in names)
        (tmp_path / f"r{k}" / "m.csv").write_text(("﻿" if k == 3 else "") + ",".join(names) + "\n" + line + "\n\n" + line + "\n")
        want += [(f"r{k}", tuple(value.get(n) for n in ("fold", "net", *[f"x{i}" for i in range(7)])))] * 2
    for name, data in (("empty", b""), ("only", b"fold,net\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "m.csv").write_bytes(data)
    out = reports.collect_runs(spark, str(tmp_path), "m.csv")
    got = [(r["source_run_dir"].rsplit("/", 1)[1], tuple(r[n] for n in ("fold", "net", *[f"x{i}" for i in range(7)]))) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 2
    assert reports.unread_runs(spark, str(tmp_path), "m.csv").isEmpty()


def test_files_that_cannot_be_read_are_told(spark, tmp_path):
    for name in ("good", "bad", "none"):
        (tmp_path / name).mkdir()
    with gzip.open(tmp_path / "good" / "m.csv.gz", "wt") as f:
        f.write("x\n1\n")
    (tmp_path / "bad" / "m.csv.gz").write_bytes(b"x\n1\n")
    (tmp_path / "none" / "m.csv.gz").write_bytes(b"")
    assert [r["x"] for r in reports.collect_runs(spark, str(tmp_path), "m.csv.gz").collect()] == ["1"]
    assert [r[0].split("/")[-2] for r in reports.unread_runs(spark, str(tmp_path), "m.csv.gz").collect()] == ["bad"]
    with pytest.raises(FileNotFoundError):
        reports.collect_runs(spark, str(tmp_path / "none"), "m.csv.gz")


def test_rows_that_do_not_fit_their_header(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "m.csv").write_text("x, y ,x,source_file\n1,2,3,4,5\n6\nx, y ,x,source_file\n")
    out = reports.collect_runs(spark, str(tmp_path), "m.csv")
    assert out.columns == ["x", "y", "source_file", "source_run_dir"]
    assert sorted((r["x"], r["y"] and r["y"].strip()) for r in out.collect()) == [("1", "2"), ("6", None), ("x", "y")]  # a header said again is a row


def test_baseline_must_be_one_row(spark):
    df = spark.createDataFrame([("base", "long", 60, 1.0), ("b", "long", 60, 3.0), ("b", "short", 60, 4.0)], "variant string, side string, horizon_minutes int, m double")
    assert {(r["variant"], r["side"], r["delta_vs_base_m"]) for r in reports.baseline_deltas(df, "base", ["m"]).collect()} == {("base", "long", 0.0), ("b", "long", 2.0), ("b", "short", None)}
    assert reports.baseline_deltas(df, "base", ["m"], keys=()).where("delta_vs_base_m = 3.0").count() == 1
    assert reports.baseline_deltas(df, "none", ["m"], keys=()).where("delta_vs_none_m IS NULL").count() == 3
    for keys in ((), ("side", "horizon_minutes")):
        with pytest.raises(ValueError):
            reports.baseline_deltas(df.unionByName(df), "base", ["m"], keys=keys)


def test_reports_as_tables(spark, tmp_path):
    rows = [("x", f"f{k}", m, float((m * 7) % 11), float(m % 5)) for k in range(2) for m in range(60)]
    df = spark.createDataFrame(rows, "symbol string, fold string, minute long, target double, pred double")
    for of_exits in (False, True):
        tables = reports.prediction_report(df, "target", "pred", of_exits=of_exits)
        at = str(tmp_path / f"p{of_exits}")
        reports.write_report(at, tables, {"predictions_valid": "fold"})
        assert spark.read.parquet(f"{at}/predictions_valid").count() == 120 and spark.read.parquet(f"{at}/score_deciles").count() == 20
        folds, summary = spark.read.parquet(f"{at}/fold_metrics"), spark.read.parquet(f"{at}/summary_metrics").first()
        assert ("spread_q95" in folds.columns) == of_exits
        means = folds.agg(F.avg("top_q95_avg").alias("a"), F.min("top_q95_avg").alias("b")).first()
        assert (summary["mean_top_q95_avg"], summary["worst_top_q95_avg"]) == (means["a"], means["b"])
    names = "symbol string, fold string, episode_id string, entry_minute long, hold_minutes int, gross_pl_bps double, net_pl_bps double, mfe_bps double, mae_bps double, giveback_bps double, roundtrip_cost_bps double"
    trades = spark.createDataFrame([("x", "f0", "a", 5, 10, 20.0, 5.0, 25.0, -1.0, 5.0, 15.0)], names)
    tables = reports.episode_report(trades, df.select("symbol", "fold").distinct(), spark.createDataFrame([("x", "f1", "below_threshold", 3)], "symbol string, fold string, decision string, rows long"))
    assert set(tables) == {"episodes", "fold_metrics", "summary_metrics", "skipped"}
    assert {(r["fold"], r["episode_count"]) for r in tables["fold_metrics"].collect()} == {("f0", 1), ("f1", 0)}


def run(spark, root, name, side, horizon, minutes, target=None, oof=True):
    folder = root / name
    folder.mkdir(parents=True)
    column = target or f"target_entry_net_bps_{side}_H{horizon}"
    (folder / "run_config.json").write_text(json.dumps({"side": side, "horizon_minutes": horizon, **({"target_col": target} if target else {})}))
    rows = [("x", m, "f", float(m), 1.0, oof) for m in minutes]
    spark.createDataFrame(rows, f"symbol string, minute long, fold string, {column} double, pred_entry_net_bps double, is_oof boolean").write.parquet(str(folder / "predictions_valid.parquet"))


def test_entry_runs_below_a_folder(spark, tmp_path):
    run(spark, tmp_path / "ok", "a", "long", 60, range(5))
    run(spark, tmp_path / "ok" / "deep", "b", "short", 120, range(3), target="mine")
    spark.range(1).write.parquet(str(tmp_path / "ok" / "a" / "other.parquet"))
    out, infos = models.entry_predictions(spark, str(tmp_path / "ok"))
    assert {(r["entry_run_id"], r["side"], r["horizon_minutes"], r["minute"], r["target_entry_net_bps"]) for r in out.collect()} == {("a", "long", 60, m, float(m)) for m in range(5)} | {("b", "short", 120, m, float(m)) for m in range(3)}
    assert {(r["entry_run_id"], r["target_col"]) for r in infos.collect()} == {("a", "target_entry_net_bps_long_H60"), ("b", "mine")}
    summary = reports.oof_summary(out, "target_entry_net_bps", "pred_entry_net_bps", ("entry_run_id", "side", "horizon_minutes"))
    assert {(r["entry_run_id"], r["rows"]) for r in summary.collect()} == {("a", 5), ("b", 3)}


@pytest.mark.parametrize("kind,says", [("twice", "stands twice"), ("inside", "not out of fold"), ("side", "side 'up'"), ("target", "without"), ("none", "no predictions")])
def test_entry_runs_that_cannot_be_used(spark, tmp_path, kind, says):
    run(spark, tmp_path, "a", "long", 60, range(3))
    if kind == "twice":
        run(spark, tmp_path, "b", "long", 60, range(2, 5))
    elif kind == "inside":
        run(spark, tmp_path, "b", "short", 60, range(3), oof=False)
    elif kind == "side":
        run(spark, tmp_path, "b", "up", 60, range(3))
    else:
        run(spark, tmp_path, "b", "short", 60, [] if kind == "none" else range(3))
        if kind == "target":
            (tmp_path / "b" / "run_config.json").write_text(json.dumps({"side": "short", "horizon_minutes": 60, "target_col": "nowhere"}))
    with pytest.raises(ValueError, match=says):
        models.entry_predictions(spark, str(tmp_path))


def test_runs_that_follow(spark):
    entries = spark.createDataFrame([("core", "e1", "f1"), ("tail_q99", "e2", "f2")], "selected_key string, entry_oof_path string, features_path string")
    out = research.downstream(entries, (30, 60), ("v0_market_only", "v1_score_decay"), (20.0, 40.0), (60.0,), (0.0, -0.5), "runs").collect()
    assert len(out) == 2 * 2 * 2 * 2 + 2 * 2 * 2 and len({r["episode_run_id"] for r in out}) == 24 and len({r["exit_run_id"] for r in out}) == 8
    one = next(r for r in out if r["selected_key"] == "tail_q99" and r["hold_threshold_bps"] == -0.5 and r["exit_lookahead_minutes"] == 30 and r["exit_feature_set"].startswith("v1"))
    assert one["episode_run_dir"] == "runs/episodes/episode_selected_long_H120_tail_q99_K30_v1_score_decay_entryThr60_holdThrm0p5"
    assert one["exit_predictions_path"] == "runs/exit/exit_selected_long_H120_tail_q99_K30_v1_score_decay/predictions_valid.parquet"
