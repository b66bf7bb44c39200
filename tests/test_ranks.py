"""Ranks by parts against ranks of whole groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, ranks


def frame(n=900, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"symbol": rng.choice(["x", "y"], n), "fold": rng.choice(["a", "b", "c"], n, p=[0.9, 0.08, 0.02]), "minute": rng.permutation(n) * 7, "v": rng.normal(size=n).round(1)})
    pdf.loc[rng.random(n) < 0.4, "v"] = 0.5  # a value that many rows share
    return pdf


@pytest.mark.parametrize(("parts", "few"), [(1, 0), (5, 10_000), (64, 10_000)])
def test_ranks_do_not_depend_on_the_parts(spark, monkeypatch, parts, few):
    monkeypatch.setattr(ranks, "PARTS", parts)
    monkeypatch.setattr(ranks, "FEW", few)
    pdf = frame()
    df = spark.createDataFrame(pdf).withColumn("part", F.lit("clash"))
    group = pdf.sort_values(["v", "minute"]).groupby(["symbol", "fold"])
    want = {(m): (r + 1, n) for m, r, n in zip(pdf.sort_values(["v", "minute"])["minute"], group.cumcount(), group["v"].transform("size"))}
    got = ranks.numbered(df, "v", "minute", ("symbol", "fold"))
    assert got.columns == [*df.columns, "__r", "__n"]
    assert {r["minute"]: (r["__r"], r["__n"]) for r in got.collect()} == want
    average = pdf.groupby(["symbol", "fold"])["v"].rank(method="average")
    assert {r["minute"]: r["k"] for r in ranks.averaged(df, "v", "k", ("symbol", "fold")).collect()} == dict(zip(pdf["minute"], average))


def test_no_window_holds_a_fold(spark):
    df = spark.createDataFrame(frame()).withColumn("w", F.col("v") * F.col("minute"))
    for out in (metrics.deciles(df, "w", "v", "minute"), metrics.rank_correlation(df, "w", "v")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.split("\n") if "Window [" in line and "row_number" in line or "Window [rank" in line]
        assert windows and all("__part" in line for line in windows)
    pdf = df.toPandas()
    want = {k: g["w"].rank().corr(g["v"].rank()) for k, g in pdf.groupby(["symbol", "fold"])}
    assert {(r["symbol"], r["fold"]): r["spearman"] for r in metrics.rank_correlation(df, "w", "v").collect()} == pytest.approx(want)
