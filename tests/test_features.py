"""Features against pandas, and properties: no look into the future, chunks change nothing, scale does not matter."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators.families import FAMILIES, sheet_of
from tidemark.operators.series import ewm, indexed, last_closed, resampled, with_sheet
from tidemark.operators.timeframes import indicators
from tidemark.plans import matrix
from tidemark.plans.feature_sets import SETS, FeatureSpec, audit_names, plus, without


def walk(n=400, seed=1, gaps=False):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.002, n)))
    open_ = np.concatenate([[close[0]], close[:-1]])
    if n > 50:
        close[50] = close[49]  # one return of zero
    pdf = pd.DataFrame({"symbol": "x", "minute": np.arange(n), "open": open_, "high": np.maximum(open_, close) * (1 + rng.random(n) / 500), "low": np.minimum(open_, close) * (1 - rng.random(n) / 500), "close": close, "volume": rng.integers(0, 50, n).astype(float)})
    return pdf.drop(index=[7, 8, 100]).reset_index(drop=True) if gaps else pdf


def run(spark, pdf, families, **options):
    return with_sheet(spark.createDataFrame(pdf), sheet_of(*families), **options).toPandas().sort_values("minute").reset_index(drop=True)


def test_against_pandas(spark):
    pdf = walk(gaps=True)
    got = run(spark, pdf, ("return_path", "volatility", "trend_persistence", "breakout", "market_structure_void", "volume_price_pressure", "acceleration"))
    c, h, l, v = pdf["close"], pdf["high"], pdf["low"], pdf["volume"]
    r1 = np.log(c / c.shift(1)) * 1e4
    prior = h.shift(1).rolling(30).max()
    lv = np.log1p(v)
    sign = np.sign(r1).replace(0.0, np.nan)
    want = {
        "ret_15m_bps": np.log(c / c.shift(15)) * 1e4,
        "realized_vol_30m_bps": r1.rolling(30).std(ddof=0),
        "range_60m_bps": np.log((h.rolling(60).max() + 1e-12) / (l.rolling(60).min() + 1e-12)) * 1e4,
        "trend_slope_15m_bps_per_min": np.log(c).rolling(15).apply(lambda y: np.polyfit(np.arange(15), y, 1)[0], raw=True) * 1e4,
        "trend_positive_ret_share_15m": (r1 > 0).astype(float).rolling(15).mean(),
        "breakout_high_extension_prev_range_30m": (h - prior) / (prior - l.shift(1).rolling(30).min()),
        "breakout_up_with_volume_30m": np.maximum(np.log((c + 1e-12) / (prior + 1e-12)) * 1e4, 0) * ((lv - lv.shift(1).rolling(30).mean()) / lv.shift(1).rolling(30).std(ddof=0)).clip(lower=0),
        "msv_bars_since_high_30m": h.rolling(30).apply(lambda x: 29 - int(np.argmax(x)), raw=True),
        "msv_bars_since_low_30m": l.rolling(30).apply(lambda x: 29 - int(np.argmin(x)), raw=True),
        "vpp_return_volume_corr_60m": r1.rolling(60).corr(lv),
        "ret_sign_persistence_5m": (sign * sign.shift(1)).rolling(5).mean(),
    }
    for name, series in want.items():
        np.testing.assert_allclose(got[name].astype(float).to_numpy(), series.to_numpy(), rtol=1e-7, atol=1e-6, err_msg=name)


def test_catalogue_size():
    columns = sum(len(sheet_of(f).outs) for f in FAMILIES)
    assert columns + 125 + 44 + 90 == 1073
    assert len(matrix.available_families()) == 30


def test_unknown_comparisons(spark):
    got = run(spark, walk(40), ("pivot_line", "regime_switch", "compressed_breakout"))
    assert got["pl_above_pivot_60m"].eq(0).all()
    assert got["regime_switch_fast_slow_return_disagree_60m"].eq(1).all()
    assert got["cbo_breakout_count_positive"].iloc[0] == 0
    assert got["pl_dist_to_pivot_60m_bps"].isna().all()


def test_chunks_change_nothing(spark):
    pdf = walk(300, gaps=True)
    sheet = ("volatility", "micro_range")
    one = run(spark, pdf, sheet)
    from tidemark.operators import series

    bars = spark.createDataFrame(pdf)
    s = sheet_of(*sheet)
    many = s.apply(series.chunked(indexed(bars), s.depth(), 64), ("symbol", "minute", "own")).where("own").drop("own").toPandas().sort_values("minute").reset_index(drop=True)
    pd.testing.assert_frame_equal(one, many, rtol=1e-9)


def test_no_look_ahead_and_scale(spark):
    pdf = walk(200)
    families = ("return_path", "breakout", "volume", "pullback_geometry")
    whole, half = run(spark, pdf, families), run(spark, pdf.iloc[:150], families)
    pd.testing.assert_frame_equal(whole.iloc[:150].reset_index(drop=True), half)
    scaled = pdf.assign(**{c: pdf[c] * 7 for c in ("open", "high", "low", "close")})
    pd.testing.assert_frame_equal(whole, run(spark, scaled, families), rtol=1e-6, atol=1e-6)


def test_closed_bars(spark):
    pdf = walk(120, gaps=True)
    bars = spark.createDataFrame(pdf)
    closed = resampled(bars, 15)
    seen = last_closed(bars.select("symbol", "minute"), closed, 15, ["close"]).toPandas().set_index("minute")["close"]
    assert seen.loc[:14].isna().all()
    close = pdf.set_index("minute")["close"]
    assert seen.loc[15] == close.loc[14] and seen.loc[29] == close.loc[14] and seen.loc[30] == close.loc[29]


def test_exponential_means(spark):
    pdf = pd.DataFrame({"symbol": "x", "idx": np.arange(1, 121), "v": np.random.default_rng(3).normal(50, 5, 120)})
    got = ewm(spark.createDataFrame(pdf), "v", {"a": 10, "b": 26}, chunk=17).toPandas().sort_values("idx")
    for name, span in (("a", 10), ("b", 26)):
        np.testing.assert_allclose(got[name].astype(float), pdf["v"].ewm(span=span, adjust=False, min_periods=span).mean(), rtol=1e-12)


def test_indicators(spark):
    pdf = walk(600)
    got = indicators(spark.createDataFrame(pdf), 5).toPandas().sort_values("minute").reset_index(drop=True)
    g = pdf.groupby(pdf["minute"] // 5)
    c, h, l = g["close"].last(), g["high"].max(), g["low"].min()
    macd = c.ewm(span=12, adjust=False, min_periods=12).mean() - c.ewm(span=26, adjust=False, min_periods=26).mean()
    hist = (macd - macd.ewm(span=9, adjust=False, min_periods=9).mean()) / c * 1e4
    gain, loss = c.diff().clip(lower=0).rolling(14).mean(), (-c.diff()).clip(lower=0).rolling(14).mean()
    tr = pd.concat([h - l, (h - c.shift(1)).abs(), (l - c.shift(1)).abs()], axis=1).max(axis=1)
    for name, series in {"macd_hist_bps": hist, "rsi14": 100 - 100 / (1 + gain / loss), "atr14_bps": tr.rolling(14).mean() / c * 1e4}.items():
        want = series.shift(1).reindex(pdf["minute"] // 5).to_numpy()
        np.testing.assert_allclose(got[f"ati_5m_{name}"].astype(float), want, rtol=1e-8, atol=1e-8, err_msg=name)


def test_indicators_against_sql(spark):
    """All columns, by formulas written apart from the sheet, within a tolerance: the two add up in different ways."""
    import duckdb

    from tidemark.operators.timeframes import indicators_sql

    pdf = walk(400)
    got = indicators(spark.createDataFrame(pdf), 1, 5).toPandas().sort_values("minute").reset_index(drop=True)
    bars = pdf  # noqa: F841  read by name
    want = duckdb.sql(f"WITH {indicators_sql('bars', (1, 5))}").df().sort_values("minute").reset_index(drop=True)
    assert set(got.columns) == set(want.columns) and len(got.columns) == 38
    for c in want.columns[2:]:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-7, atol=1e-7, err_msg=c)


def test_matrix_guard_and_sets(spark):
    with pytest.raises(ValueError):
        matrix.build(spark.createDataFrame(walk(5)), ("nothing",))
    assert audit_names(["a", "future_x", "open"], [FeatureSpec("a", "f", 1), FeatureSpec("future_x", "f", 1), FeatureSpec("open", "f", 1, True)])
    assert not audit_names(["a"], [FeatureSpec("a", "f", 1)])
    assert len(SETS["v3b"]) == 26 and len(SETS["v4"]) == 29 and len(SETS["v3a"]) == 19
    assert plus(("a",), "b", "a") == ("a", "b") and without(("a", "b"), "a") == ("b",)
    built = matrix.build(spark.createDataFrame(walk(40)), ("price", "timeframe_phase"))
    specs = matrix.manifest(("price", "timeframe_phase"), built.columns[2:])
    assert len(matrix.drop_families(built, specs, ("price",)).columns) == 33
