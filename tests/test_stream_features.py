"""Features of a stream against those of the same rows as a batch."""

import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import series
from tidemark.streaming import features as sf

SCHEMA = "symbol string, ts timestamp, minute long, open double, high double, low double, close double, volume double"
FRAMES, WINDOWS = (5, 30), (1, 4)


def bar(rng, symbol, minute):
    a, b = rng.uniform(90, 110), None if rng.random() < 0.03 else rng.uniform(90, 110)
    return (symbol, pd.Timestamp(minute * 60, unit="s", tz="UTC").to_pydatetime(), minute, a, max(a, b or a), min(a, b or a), b, float(rng.randint(0, 5)))


def streamed(spark, tmp_path, batches, late="10 minutes"):
    """The rows that come out after each batch has come in as a file of its own."""
    folder, key = tmp_path / "in", "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, sf.ROCKS)
    try:
        name = f"out_{uuid.uuid4().hex}"
        folder.mkdir()
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
        q = sf.features(stream, FRAMES, WINDOWS, late).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "check")).start()
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
            next((tmp_path / f"w{i}").glob("part-*.parquet")).rename(folder / f"{i:03d}.parquet")
            q.processAllAvailable()
        q.stop()
        return spark.table(name)
    finally:
        spark.conf.set(key, old)


def batch(spark, rows):
    """The same columns from joins and windows over the whole series."""
    bars = spark.createDataFrame(rows, SCHEMA).drop("ts")
    w = Window.partitionBy("symbol").orderBy("minute")
    out = bars
    for n in WINDOWS:
        part = w.rowsBetween(1 - n, 0)
        for f in ("mean", "max", "min"):
            out = out.withColumn(f"close_{f}_{n}", F.when(F.count("close").over(part) == n, getattr(F, f)("close").over(part)))
    for k in FRAMES:
        named = series.resampled(bars, k).withColumnsRenamed({c: f"m{k}_{c}" for c in sf.VALUES})
        out = series.last_closed(out, named, k, [f"m{k}_{c}" for c in sf.VALUES])
    return out


def plain(df):
    return sorted(tuple(None if v is None or v != v else round(v, 8) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("size", [40, 400])
def test_stream_is_the_batch(spark, tmp_path, size):
    rng = random.Random(size)
    rows = [bar(rng, s, m) for m in range(1000, 1200) for s in "xy" if rng.random() < (0.8 if s == "x" else 0.2)]
    # a hole of three hours, and rows up to eight minutes late
    rows += [bar(rng, "x", m) for m in range(1400, 1440)]
    order = sorted(rows, key=lambda r: r[2] + rng.randint(0, 8))
    got = streamed(spark, tmp_path, [order[i : i + size] for i in range(0, len(order), size)])
    newest = max(r[2] for r in rows)
    want = batch(spark, rows).where(F.col("minute") <= newest - 10)
    assert got.columns == want.columns
    assert plain(got) == plain(want) and got.count() > 150


def test_late_and_repeated_rows(spark, tmp_path):
    rng = random.Random(1)
    rows = {m: bar(rng, "x", m) for m in (*range(100, 130), *range(150, 190))}
    again = bar(rng, "x", 125)
    batches = [
        [rows[m] for m in range(100, 130)],
        [again, again],  # said again before it is given out: the later one stays, once
        [rows[m] for m in range(150, 170)],
        [bar(rng, "x", 110), bar(rng, "x", 140), (None, *bar(rng, "x", 171)[1:])],  # too late, or of no symbol
        [rows[m] for m in range(170, 190)],
        [bar(rng, "x", 400)],
    ]
    got = streamed(spark, tmp_path, batches)
    assert plain(got) == plain(batch(spark, [*(r for m, r in rows.items() if m != 125), again]))


def test_greatest_of_a_minute_over_parts_of_a_micro_batch(spark, tmp_path):
    """Rows reach a task in parts of so many records; those of a minute lie far apart."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rng, old = random.Random(2), spark.conf.get(key)
    many = [[bar(rng, "x", m) for m in range(100, 160)] for _ in range(3)]
    best = [max(rows, key=lambda r: [-1.0 if v is None else v for v in r[3:]]) for rows in zip(*many)]
    spark.conf.set(key, "7")
    try:
        got = streamed(spark, tmp_path, [sum(many, []), [bar(rng, "x", 400)]])
    finally:
        spark.conf.set(key, old)
    assert plain(got) == plain(batch(spark, best))
