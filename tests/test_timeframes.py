"""Closed bars of all timeframes seen from minute rows at once: as one timeframe after the other, without wide shuffles."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import series, timeframes

VALUES = ("open", "high", "low", "close", "volume")


def test_all_timeframes_as_one_by_one(spark):
    """Two symbols, missing minutes, gaps longer than a span, unknown prices that leave whole spans without a bar."""
    rng = np.random.default_rng(8)
    minutes = [np.concatenate([np.arange(30), np.arange(5700, 5790), np.arange(17275, 17300), np.arange(40000, 40050)]), np.arange(-7, 6000, 11)]
    parts = []
    for name, m in zip("ab", minutes):
        pdf = pd.DataFrame({"symbol": name, "minute": m[rng.random(len(m)) < 0.8], **{c: 0.0 for c in VALUES}})
        for c in VALUES:
            pdf[c] = rng.normal(50, 5, len(pdf)).round(2)
        pdf.loc[(pdf["minute"] > 17000) & (pdf["minute"] < 18000), "close"] = None
        pdf.loc[rng.random(len(pdf)) < 0.1, "open"] = None
        parts.append(pdf)
    bars = spark.createDataFrame(pd.concat(parts)).select("symbol", "minute", *[F.nullif(c, F.lit(float("nan"))).alias(c) for c in VALUES])
    tfs, names = (1, 5, 60, 240), ("close", "volume")
    closed = series.resampled_to_all(bars, tfs)
    got = series.last_closed_of_all(bars, ("open",), closed, closed, tfs, names)
    want = bars.select("symbol", "minute", "open")
    for tf in tfs:
        one = series.resampled(bars, tf).select("symbol", "bucket", *[F.col(c).alias(f"t{tf}_{c}") for c in names])
        want = series.last_closed(want, one, tf, [f"t{tf}_{c}" for c in names])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.where("symbol = 'a' AND t240_close IS NOT NULL").count() > 50


def test_no_shuffle_carries_all_timeframes(spark):
    """Rows that carried the columns of earlier timeframes to the next one's join shuffled five times up to 92 columns."""
    bars = spark.range(50).select(F.lit("x").alias("symbol"), F.col("id").alias("minute"), *[(F.lit(k) + F.col("id") % 7).cast("double").alias(c) for k, c in ((2, "open"), (3, "high"), (1, "low"), (2, "close"), (5, "volume"))])
    for build in (timeframes.anchored_timeframe_indicators, timeframes.anchored_timeframe_candle):
        plan = build(bars)._jdf.queryExecution().executedPlan()
        widths = _widths(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)
        assert widths and max(widths) < 30, (build.__name__, widths)


def _widths(plan):
    out = [plan.output().size()] if plan.nodeName() in ("Exchange", "BroadcastExchange") else []
    for i in range(plan.children().size()):
        out += _widths(plan.children().apply(i))
    return out
