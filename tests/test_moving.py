"""Moving statistics of chunks: unknown values and NaN, few passes, and rounding by columns."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.functions.moving import Moves, added
from tidemark.functions.sheet import Sheet
from tidemark.operators.families import BASE, sheet_of
from tidemark.plans.feature_sets import SETS


def test_statistics_with_unknown_values():
    rng = np.random.default_rng(5)
    x, y = (np.where(rng.random(300) < 0.02, np.nan, rng.normal(3, 1, 300).round(1)) for _ in range(2))
    m = Moves(pa.table({"x": pa.array(x, from_pandas=True), "y": pa.array(y, from_pandas=True), "idx": np.arange(1, 301)}))
    s, t = pd.Series(x), pd.Series(y)
    for n in (1, 2, 5, 13, 30):
        r = s.rolling(n)
        want = {"sum": r.sum(), "avg": r.mean(), "max": r.max(), "min": r.min(), **({"stddev_pop": r.std(ddof=0), "stddev_samp": r.std()} if n > 1 else {})}
        for f, series in want.items():
            for before in (0, 1, 7):
                got = m.of(("roll", f, "x", n, before)).to_numpy(zero_copy_only=False)
                np.testing.assert_allclose(got, series.shift(before), rtol=1e-9, atol=1e-9, err_msg=f"{f} {n} {before}")
        if n > 2:
            np.testing.assert_allclose(m.of(("pair", "corr", "y", "x", n)).to_numpy(zero_copy_only=False), r.corr(t), rtol=1e-7)
            np.testing.assert_allclose(m.of(("since", "max", "x", n)).to_numpy(zero_copy_only=False), r.apply(lambda v, n=n: n - 1 - int(np.argmax(v)), raw=True))
            np.testing.assert_allclose(m.of(("since", "min", "x", n)).to_numpy(zero_copy_only=False), r.apply(lambda v, n=n: n - 1 - int(np.argmin(v)), raw=True))
    assert m.of(("lag", "x", 400)).null_count == 300
    # NaN is the largest number, as it is in SQL
    m = Moves(pa.table({"x": [1.0, math.nan, 2.0]}))
    assert m.of(("roll", "min", "x", 3, 0))[2].as_py() == 1.0 and math.isnan(m.of(("roll", "max", "x", 3, 0))[2].as_py())


def test_chunks_over_batches():
    rows = pa.record_batch({"symbol": ["a"] * 5 + [None] * 4 + ["b"] * 3, "chunk": [0] * 3 + [1] * 9, "x": [float(i) for i in range(12)]})
    for size in (1, 2, 5, 12):
        parts = [rows.slice(i, size) for i in range(0, 12, size)]
        out = pa.Table.from_batches(added(iter(parts), {"l": ("lag", "x", 1)}, ("symbol", "chunk"), ["symbol", "x"]))
        assert out["l"].to_pylist() == [None, 0, 1, None, 3, None, 5, 6, 7, None, 9, 10] and out["x"].to_pylist() == rows["x"].to_pylist()


def test_windows_of_windows_take_few_passes(spark):
    """However long the windows are: one pass over the chunks for each window that needs another one's result."""
    s = sheet_of(*SETS["v3b"])
    assert len(s.steps()) <= 5
    df = spark.range(1).selectExpr("'x' AS symbol", "0 AS chunk", "id AS minute", "id AS idx", *[f"1e0 AS {c}" for c in BASE[3:]])
    plan = s.apply(df, ("symbol", "minute"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") <= 4
    s = Sheet(("symbol", "minute", "close"))
    s.out("m", s.roll("avg", "close", 500))
    assert [len(moves) for _, moves in s.steps()] == [1, 0]


def test_rounding_by_columns(spark):
    x = [0.0, -0.0, 1.25e-6, -2.5e-6, 0.0078125, 1 / 3, -1 / 3, 999.9999999, 1000.005, -123456.789, 1e9, 2.5e12, -7.5e15, 1e300, math.inf, -math.inf, None]
    got = queries.rounded(spark.createDataFrame([(v, "s") for v in x], "x double, s string"), nudge=1e-9)
    near = lambda v: None if v is None else v if abs(v) > 1e15 else round(v, 0) if abs(v) >= 1e9 else round(v + 1e-9, 6 if abs(v) < 1e3 else 2)
    got = [r["x"] for r in got.collect()]
    assert got == [near(v) for v in x] and math.copysign(1, got[1]) == 1
    assert math.isnan(queries.rounded(spark.range(1).select(F.lit(math.nan).alias("x")), nudge=1e-9).first()["x"])


def test_passes_but_the_last_are_narrow(spark):
    """What only the result needs is worked out in the last pass, instead of going through all of them."""
    s = sheet_of(*SETS["v3b"])
    *early, last, _ = [len(moves) for _, moves in s.steps()]
    assert sum(early) < 50 < last
    df = spark.range(1).selectExpr("'x' AS symbol", "0 AS chunk", "true AS own", "id AS minute", "id AS idx", *[f"1e0 AS {c}" for c in BASE[3:]])
    widths = [len(n) for n in _passes(s.apply(df, ("symbol", "minute"), "own"))]
    assert max(widths[:-1]) < 100, widths


def _passes(df):
    """The columns that leave each pass, first pass first."""
    out, plan = [], df._jdf.queryExecution().analyzed()
    while plan.children().size():
        if plan.nodeName() == "MapInArrow":
            out.append([plan.output().apply(i).name() for i in range(plan.output().size())])
        plan = plan.children().head()
    return out[::-1]


def test_only_own_rows_leave_the_last_pass(spark):
    df = spark.range(8).selectExpr("'x' AS symbol", "0 AS chunk", "id >= 3 AS own", "id AS minute", "cast(id AS double) AS close")
    s = Sheet(("symbol", "minute", "close"))
    s.out("m", s.roll("sum", s.let("before", s.lag("close")), 2))
    assert [tuple(r) for r in s.apply(df, ("minute",), "own").orderBy("minute").collect()] == [(k, 2.0 * k - 3) for k in range(3, 8)]
    s = Sheet(("symbol", "minute", "close"))
    s.out("twice", "2 * close")
    assert s.apply(df, ("minute",), "own").count() == 5
    rows = pa.record_batch({"symbol": ["a"] * 900, "x": np.arange(900.0)})
    wide = {f"l{k}": ("lag", "x", k) for k in range(1, 999)}
    sizes = [b.num_rows for b in added(iter([rows]), wide, ("symbol",), ["symbol", "x"])]
    assert sum(sizes) == 900 and max(sizes) * 1000 <= 400_000


def test_sums_are_exact_ones_rounded_once():
    """Means of equal value are equal, whatever their windows: added up pairwise in doubles, the last bit told."""
    x = np.random.default_rng(2).normal(100, 40, 800).round(2)
    m = Moves(pa.table({"x": x}))
    for n in (3, 15, 60, 240, 720):
        got = m.of(("roll", "sum", "x", n, 0)).to_numpy(zero_copy_only=False)[n - 1 :]
        assert got.tolist() == [math.fsum(x[i : i + n]) for i in range(len(x) - n + 1)], n
    m = Moves(pa.table({"x": [1.0, math.inf, 2.0, -math.inf, 1e308, 1e308, 3.0]}))
    assert str(m.of(("roll", "sum", "x", 2, 0)).to_pylist()) == str([None, math.inf, math.inf, -math.inf, -math.inf, math.inf, 1e308])
    assert math.isnan(m.of(("roll", "sum", "x", 4, 0))[3].as_py())


def test_means_that_are_compared_add_up_as_the_sql_does():
    """Means that tie in decimals, told apart by their last bit: as the SQL has them, wherever a chunk begins."""
    import duckdb

    x = np.random.default_rng(4).integers(9000, 9020, 9000) / 100
    db = duckdb.connect()
    db.register("t", pa.table({"i": np.arange(len(x)), "x": x}))
    for n in (15, 16, 60, 240, 720, 4500):
        want = db.execute(f"SELECT avg(x) OVER (ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m FROM t ORDER BY i").fetchnumpy()["m"]
        for start in (0, 17, 4099):
            m = Moves(pa.table({"x": x[start:], "idx": np.arange(start + 1, len(x) + 1)}))
            got = m.of(("mean", "x", n))
            assert got.null_count == min(n - 1, len(got))
            assert got.to_numpy(zero_copy_only=False)[n - 1 :].tolist() == want[start + n - 1 :].tolist(), (n, start)
    # the family that compares them does so, alone and in a matrix
    for s in (sheet_of("trend_regime"), sheet_of(*SETS["v3b"])):
        assert s.moves["avg_close_720"] == s.moves["avg_close_15"][:2] + (720,) == ("mean", "close", 720)
