"""Exact quantiles without a task that holds a group's values."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import metrics, ranks, reports


def test_quantiles_equal_percentile(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, 40_000)
    parts = {"plain": x, "ties": np.round(x), "one": np.full(30_000, 2.5), "single": x[:1], "two": x[:2], "half": np.where(x > 1.6, 7.0, x.round(1))}
    pdf = pd.concat([pd.DataFrame({"k": k, "x": v}) for k, v in parts.items()])
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(None, 1.0), (None, 2.0), ("plain", None), ("none", None)], "k string, x double"))
    shares = (0.0, 0.01, 0.5, 0.95, 0.97, 0.99, 1.0)
    got = {r["k"]: r["__q"] for r in ranks.quantiles(df, "x", shares, ("k",)).collect()}
    want = {r["k"]: r["q"] for r in df.groupBy("k").agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("q")).collect()}
    assert got.pop("none", None) is None and want.pop("none") is None
    assert got.keys() == want.keys()
    for k in want:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-14, atol=1e-14, err_msg=str(k))


def test_thresholds_and_summaries_gather_no_group(spark):
    df = spark.range(100).selectExpr("'s' AS symbol", "'f' AS fold", "'r' AS run_id", "'long' AS side", "60 AS horizon_minutes", "cast(id AS double) AS pred", "cast(id % 3 AS double) AS target")
    for out in (metrics.with_thresholds(df, "pred", (0.9,)), reports.oof_summary(df, "target")):
        assert " percentile(" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "percentile(pred" not in plan
    assert reports.oof_summary(df, "target").first()["pred_p95_bps"] == 94.05
