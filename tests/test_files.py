"""Folders of files with different layouts, and the order of their rows."""

import gzip

import pytest
from pyspark.sql import functions as F

from tidemark.operators import labels, models, quality, simulate
from tidemark.sources import bars as src

KLINE = "{t},1,2,0.5,1.5,10,{e},1,1,1,1,0\n"


def folder(tmp_path):
    """Headed files of two layouts, one of them zipped, headerless kline files, Parquet, and an empty file."""
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.csv").write_text("Open Time,O,H,L,C,Vol\n60,1,1,1,1,1\n120,2,2,2,2,2\n")
    with gzip.open(tmp_path / "deep" / "b.csv.gz", "wt") as f:
        f.write("close,volume,timestamp,open,high,low,note\n3,3,1970-01-01 00:03:00,3,3,3,x\n")
    (tmp_path / "deep" / "c.csv").write_text("".join(KLINE.format(t=60_000 * m + 1_700_000_000_000, e=0) for m in range(3)))
    (tmp_path / "d.txt").write_text(KLINE.format(t=1_800_000_000_000, e=1))
    (tmp_path / "e.csv").write_text("")
    return str(tmp_path)


def test_folder_of_many_layouts(spark, tmp_path):
    path = folder(tmp_path)
    spark.createDataFrame([(300, 5.0)], "time long, close double").select("time", *[F.col("close").alias(c) for c in ("open", "high", "low", "close", "volume")]).coalesce(1).write.parquet(f"{path}/f")
    assert sorted(map(len, src.layouts(spark, path).values())) == [1, 1, 2]
    rows = [(r["minute"], r["close"], r["volume"]) for r in src.read_bars(spark, path, sort=True).collect()]
    assert rows == [(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 3.0, 3.0), (5, 5.0, 5.0), *((28_333_333 + m, 1.5, 10.0) for m in range(3)), (30_000_000, 1.5, 10.0)]
    assert {"note", "trade_count"} <= set(src.read_bars(spark, path, keep_extra=True).columns)
    assert src.read_bars(spark, f"{path}/a.csv").count() == 2


def test_broken_file_raises_what_was_wrong_with_its_header(spark, tmp_path):
    path = folder(tmp_path)
    (tmp_path / "bad.csv").write_text("time,open,high\n1,2,3\n")
    with pytest.raises(src.SchemaError, match="bad.csv: missing columns: .'low', 'close', 'volume'"):
        src.read_bars(spark, path)
    with pytest.raises(src.SchemaError):
        (tmp_path / "none").mkdir()
        src.read_bars(spark, str(tmp_path / "none"))


def test_input_order_is_that_of_the_files(spark, tmp_path):
    lines = [f"{60 * m},{i},{i},{i},{i},1" for i, m in enumerate([1, 2, 3, 3, 2, 5, 6, 4])]
    head = "timestamp,open,high,low,close,volume\n"
    (tmp_path / "1.csv").write_text(head + "\n".join(lines[:5]) + "\n")
    (tmp_path / "2.csv").write_text(head + "\n".join(lines[5:]) + "\n")
    got = src.read_bars(spark, str(tmp_path), position=True).repartition(7)
    audit = quality.audit(got).first()
    assert (audit["non_monotonic_count"], audit["duplicate_count"], audit["row_count"]) == (3, 4, 8)
    kept = {r["minute"]: r["close"] for r in src.read_bars(spark, str(tmp_path), drop_duplicates=True).collect()}
    assert kept == {1: 0.0, 2: 4.0, 3: 3.0, 5: 5.0, 6: 6.0, 4: 7.0}
    again = src.normalize(got.drop("ts", "minute").join(got.select("input_pos", F.col("ts").alias("timestamp")), "input_pos").repartition(5), drop_duplicates=True, sort=True)
    assert [r["close"] for r in again.collect()] == [0.0, 4.0, 3.0, 7.0, 5.0, 6.0]
    with pytest.raises(ValueError, match="twice"):
        labels.checked_minutes(got)
    unique = got.dropDuplicates(["minute"])
    with pytest.raises(ValueError, match="order"):
        labels.checked_minutes(unique)
    assert labels.checked_minutes(unique.drop("input_pos")).count() == 6
    with pytest.raises(ValueError, match="without"):
        labels.checked_minutes(unique.withColumn("minute", F.lit(None).cast("long")))


def test_history_tags(spark):
    past = spark.createDataFrame([("x", 1, "f1"), ("x", 2, "*"), ("x", 3, "train"), ("x", 4, "other"), ("x", 5, None)], "symbol string, minute long, fold string")
    got = sorted((r["fold"], r["minute"]) for r in simulate.history_by_fold(past, ["f1", "f2"]).collect())
    assert got == [("f1", 1), ("f1", 2), ("f1", 3), ("f2", 2), ("f2", 3)]
    assert simulate.history_by_fold(past.drop("fold"), ["f1", "f2"]).count() == 10


def test_combined_runs_in_order(spark):
    rows = [("x", m, s, True) for m in (3, 1) for s in ("short", "long")]
    df = spark.createDataFrame(rows, "symbol string, minute long, side string, is_oof boolean")
    got = [(r["minute"], r["side"], r["run_id"]) for r in models.combined({"b": df, "a": df}, sort=True).collect()]
    assert got == sorted(got) and len(got) == 8
    with pytest.raises(ValueError, match="twice"):
        models.combined({"a": df.union(df)})
