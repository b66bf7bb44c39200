"""Features of closed higher-timeframe bars, seen from minute rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.functions.sheet import Sheet
from tidemark.functions.sqltext import bps, div, flag, log1p, position
from tidemark.operators.series import last_closed_of_all, resampled_to_all, with_sheet

#: Timeframes in minutes, and numbers of closed bars whose extremes are levels.
TIMEFRAMES, LITE_TIMEFRAMES, LEVELS = (1, 5, 15, 60, 240), (5, 15, 60, 240), (4, 12)
OHLCV = ("open", "high", "low", "close", "volume")
_BASE = ("symbol", "minute", "idx", *OHLCV)


def _level_sheet(levels: tuple[int, ...]) -> Sheet:
    s = Sheet(_BASE)
    for c in OHLCV:
        s.out(f"h_{c}", c)
    for n in levels:
        s.out(f"p{n}_high", s.roll("max", "high", n, 1))
        s.out(f"p{n}_low", s.roll("min", "low", n, 1))
    s.out("p_close", s.lag("close"))
    return s


def _candle(s: Sheet, p: str, own: bool) -> dict[str, str]:
    o, h, l, c, v = (x if own else f"h_{x}" for x in OHLCV)
    return {
        "body_bps": bps(c, o),
        "range_bps": f"({div(f'{h} - {l}', c, 0)}) * 1e4",
        "body_to_range": div(f"abs({c} - {o})", f"{h} - {l}", 0),
        "upper_wick_ratio": div(f"{h} - greatest({o}, {c})", f"{h} - {l}", 0),
        "lower_wick_ratio": div(f"least({o}, {c}) - {l}", f"{h} - {l}", 0),
        "close_position": position(c, l, h),
        "is_bull": flag(f"{c} > {o}"),
        "current_close_vs_bar_high_bps": bps("close", h),
        "current_close_vs_bar_low_bps": bps("close", l),
        "current_close_vs_bar_close_bps": bps("close", c),
        "volume_log1p": log1p(v),
    }


def _candle_sheet(tf: int) -> Sheet:
    s = Sheet((*_BASE, *_level_sheet(LEVELS).outs))
    for name, sql in _candle(s, "", tf == 1).items():
        s.out(f"atc_{tf}m_{name}", sql)
    for n in LEVELS:
        ph, pl, p = f"p{n}_high", f"p{n}_low", f"atc_{tf}m_prev{n}_"
        s.out(f"{p}high_dist_bps", bps("close", ph))
        s.out(f"{p}low_dist_bps", bps("close", pl))
        s.out(f"{p}range_position", position("close", pl, ph))
        s.out(f"{p}range_bps", f"({div(f'{ph} - {pl}', 'close', 0)}) * 1e4")
        s.out(f"{p}close_dist_bps", bps("close", "p_close"))
        s.out(f"atc_{tf}m_break_prev{n}_high", flag(f"close > {ph}"))
        s.out(f"atc_{tf}m_break_prev{n}_low", flag(f"close < {pl}"))
    return s


def _lite_sheet(tf: int) -> Sheet:
    s = Sheet((*_BASE, *_level_sheet((4,)).outs))
    block = _candle(s, "", False)
    names = {
        "body_bps": "body_bps", "range_bps": "range_bps", "close_position": "close_position", "upper_wick_ratio": "upper_wick_ratio",
        "lower_wick_ratio": "lower_wick_ratio", "current_vs_high_bps": "current_close_vs_bar_high_bps",
        "current_vs_low_bps": "current_close_vs_bar_low_bps", "current_vs_close_bps": "current_close_vs_bar_close_bps",
    }
    for name, key in names.items():
        s.out(f"atcl_{tf}m_{name}", block[key])
    s.out(f"atcl_{tf}m_prev4_high_dist_bps", bps("close", "p4_high"))
    s.out(f"atcl_{tf}m_prev4_low_dist_bps", bps("close", "p4_low"))
    s.out(f"atcl_{tf}m_prev4_range_position", position("close", "p4_low", "p4_high"))
    return s


def _per_timeframe(bars: DataFrame, tfs: tuple[int, ...], levels: tuple[int, ...], sheet_of) -> DataFrame:
    """Features of all timeframes: closed bars and levels of the bars before them, then what minute rows see of them."""
    levelled, names = _level_sheet(levels), []
    closed = resampled_to_all(bars, tfs)
    out = last_closed_of_all(bars, OHLCV, closed, with_sheet(closed, levelled), tfs, tuple(levelled.outs))
    for tf in tfs:
        sheet = sheet_of(tf)
        own = {f"t{tf}_{c}": c for c in levelled.outs}
        out = sheet.apply(out.withColumnsRenamed(own), tuple(c for c in out.columns if c not in own))
        names += sheet.outs
    return out.select("symbol", "minute", *names)


def anchored_timeframe_candle(bars: DataFrame) -> DataFrame:
    return _per_timeframe(bars, TIMEFRAMES, LEVELS, _candle_sheet)


def anchored_timeframe_candle_lite(bars: DataFrame) -> DataFrame:
    return _per_timeframe(bars, LITE_TIMEFRAMES, (4,), _lite_sheet)


def candle_sql(bars: str, tfs: tuple[int, ...], levels: tuple[int, ...], sheet_of) -> str:
    """The same in SQL, over a relation `bars`: as-of joins on the close time of resampled bars."""
    ctes, selects, joins = [], [], []
    for tf in tfs:
        inner = _level_sheet(levels).sql(f"closed{tf}", ("symbol", "close_minute"), None)
        ctes.append(
            f"""closed{tf} AS (SELECT symbol, minute // {tf} AS minute, (minute // {tf} + 1) * {tf} AS close_minute, arg_min(open, minute) AS open,
            max(high) AS high, min(low) AS low, arg_max(close, minute) AS close, sum(volume) AS volume,
            row_number() OVER (PARTITION BY symbol ORDER BY minute // {tf}) AS idx FROM {bars} GROUP BY symbol, minute // {tf})"""
        )
        ctes.append(f"levels{tf} AS ({'WITH ' if inner.strip().startswith('layer') else ''}{inner})")
        sheet = sheet_of(tf)
        columns = ", ".join(f"l.{c}" for c in _level_sheet(levels).outs)
        ctes.append(f"seen{tf} AS (SELECT b.*, {columns} FROM {bars} b ASOF LEFT JOIN levels{tf} l ON b.symbol = l.symbol AND b.minute >= l.close_minute)")
        ctes.append(f"out{tf} AS (WITH {sheet.sql(f'seen{tf}', ('symbol', 'minute'))})")
        selects += [f"out{tf}.{c}" for c in sheet.outs]
        joins.append(f"out{tf}")
    first = joins[0]
    rest = " ".join(f"JOIN {j} ON {j}.symbol = {first}.symbol AND {j}.minute = {first}.minute" for j in joins[1:])
    return ", ".join(ctes) + f" SELECT {first}.symbol, {first}.minute, {', '.join(selects)} FROM {first} {rest}"


def _indicator_sheet() -> Sheet:
    s = Sheet(_BASE)
    for n in (10, 20, 50):
        s.let(f"ema{n}", f"CASE WHEN idx >= {n} THEN {s.ewm('close', n)} END")
    s.let("macd", f"CASE WHEN idx >= 26 THEN {s.ewm('close', 12)} - {s.ewm('close', 26)} END")
    s.let("macd_signal", f"CASE WHEN idx >= 34 THEN {s.ewm('macd', 9)} END")
    for n in (10, 20, 50):
        s.out(f"ema{n}_dist_bps", bps("close", f"ema{n}"))
        s.out(f"ema{n}_slope_bps", bps(f"ema{n}", s.lag(f"ema{n}")))
    s.out("ema10_vs_ema20_bps", bps("ema10", "ema20"))
    s.out("ema20_vs_ema50_bps", bps("ema20", "ema50"))
    before = s.lag("close")
    s.let("true_range", f"greatest(high - low, abs(high - {before}), abs(low - {before}))")
    atr = s.roll("avg", "true_range", 14)
    s.out("atr14_bps", f"({div(atr, 'close')}) * 1e4")
    s.out("range_over_atr14", div("high - low", atr))
    s.let("gain", f"CASE WHEN close > {before} THEN close - {before} WHEN {before} IS NOT NULL THEN 0e0 END")
    s.let("loss", f"CASE WHEN close < {before} THEN {before} - close WHEN {before} IS NOT NULL THEN 0e0 END")
    up, down = s.roll("avg", "gain", 14), s.roll("avg", "loss", 14)
    s.out("rsi14", f"CASE WHEN {up} = 0 AND {down} = 0 THEN 5e1 WHEN {down} = 0 THEN 1e2 WHEN {up} = 0 THEN 0e0 ELSE 1e2 - 1e2 / (1e0 + {up} / {down}) END")
    s.out("rsi14_centered", "(rsi14 - 5e1) / 5e1")
    mid, std = s.roll("avg", "close", 20), s.roll("stddev_pop", "close", 20)
    s.out("bb20_z", div(f"close - {mid}", std))
    s.out("bb20_width_bps", f"CASE WHEN {std} <> 0 THEN ({div(f'4e0 * {std}', 'close')}) * 1e4 END")
    s.out("bb20_position", div(f"close - ({mid} - 2e0 * {std})", f"4e0 * {std}"))
    s.out("macd_bps", f"({div('macd', 'close')}) * 1e4")
    s.out("macd_signal_bps", f"({div('macd_signal', 'close')}) * 1e4")
    s.out("macd_hist_bps", f"({div('macd - macd_signal', 'close')}) * 1e4")
    return s


def indicators(bars: DataFrame, *tfs: int) -> DataFrame:
    """Moving averages, ATR, RSI, Bollinger bands and MACD of the last closed bar of each timeframe."""
    sheet, closed = _indicator_sheet(), resampled_to_all(bars, tfs)
    out = last_closed_of_all(bars, (), closed, with_sheet(closed, sheet), tfs, tuple(sheet.outs))
    return out.withColumnsRenamed({f"t{tf}_{c}": f"ati_{tf}m_{c}" for tf in tfs for c in sheet.outs})


def indicators_sql(bars: str, tfs: tuple[int, ...]) -> str:
    """The same in SQL over a relation `bars`, written apart from the sheet: exponential means as weighted sums of the last
    1,000 closed bars, as older ones weigh less than a double tells; windows as frames; as-of joins on close times."""
    ln = lambda a, b: f"CASE WHEN {a} > 0 AND {b} > 0 THEN 1e4 * ln({a} / {b}) END"
    share = lambda a, b, k="1": f"CASE WHEN {b} <> 0 THEN {k} * ({a}) / ({b}) END"
    ctes, columns, joins = [], [], []
    for tf in tfs:
        means = ", ".join(
            f"CASE WHEN x.idx >= {n} THEN sum(y.close * CASE WHEN y.idx = 1 THEN 1e0 ELSE {2 / (n + 1)!r} END * pow({1 - 2 / (n + 1)!r}, x.idx - y.idx)) END AS e{n}" for n in (10, 12, 20, 26, 50)
        )
        over = lambda n: f"OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        full = lambda f, x, n: f"CASE WHEN count({x}) {over(n)} = {n} THEN {f}({x}) {over(n)} END"  # noqa: B023, E731
        values = {
            **{f"ema{n}_dist_bps": ln("close", f"e{n}") for n in (10, 20, 50)}, **{f"ema{n}_slope_bps": ln(f"e{n}", f"b{n}") for n in (10, 20, 50)},
            "ema10_vs_ema20_bps": ln("e10", "e20"), "ema20_vs_ema50_bps": ln("e20", "e50"), "atr14_bps": share("atr", "close", "1e4"), "range_over_atr14": share("high - low", "atr"),
            "rsi14": "rsi", "rsi14_centered": "(rsi - 50) / 50", "bb20_z": share("close - mid", "dev"), "bb20_width_bps": f"CASE WHEN dev <> 0 THEN {share('4 * dev', 'close', '1e4')} END",
            "bb20_position": share("close - mid + 2 * dev", "4 * dev"), "macd_bps": share("e12 - e26", "close", "1e4"), "macd_signal_bps": share("sig", "close", "1e4"), "macd_hist_bps": share("e12 - e26 - sig", "close", "1e4"),
        }
        ctes += [
            f"""i{tf} AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY close_minute) AS idx FROM (SELECT symbol, (minute // {tf} + 1) * {tf} AS close_minute, max(high) AS high, min(low) AS low, arg_max(close, minute) AS close FROM {bars} GROUP BY symbol, minute // {tf}))""",
            f"""m{tf} AS (SELECT x.symbol, x.idx, {means} FROM i{tf} x JOIN i{tf} y ON y.symbol = x.symbol AND y.idx > x.idx - 1000 AND y.idx <= x.idx GROUP BY x.symbol, x.idx)""",
            f"""g{tf} AS (SELECT x.symbol, x.idx, CASE WHEN x.idx >= 34 THEN sum((y.e12 - y.e26) * CASE WHEN y.idx = 26 THEN 1e0 ELSE 0.2e0 END * pow(0.8e0, x.idx - y.idx)) END AS sig FROM m{tf} x JOIN m{tf} y ON y.symbol = x.symbol AND y.idx > x.idx - 300 AND y.idx <= x.idx AND y.idx >= 26 GROUP BY x.symbol, x.idx)""",
            f"""d{tf} AS (SELECT i.*, e10, e12, e20, e26, e50, sig, lag(e10) OVER w AS b10, lag(e20) OVER w AS b20, lag(e50) OVER w AS b50, close - lag(close) OVER w AS move,
              greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM i{tf} i JOIN m{tf} USING (symbol, idx) LEFT JOIN g{tf} USING (symbol, idx) WINDOW w AS (PARTITION BY symbol ORDER BY idx))""",
            f"""r{tf} AS (SELECT *, {full("avg", "tr", 14)} AS atr, {full("avg", "close", 20)} AS mid, {full("stddev_pop", "close", 20)} AS dev, {full("avg", "up", 14)} AS gain, {full("avg", "down", 14)} AS loss
              FROM (SELECT *, CASE WHEN move IS NOT NULL THEN greatest(move, 0) END AS up, CASE WHEN move IS NOT NULL THEN greatest(-move, 0) END AS down FROM d{tf}))""",
            f"""v{tf} AS (SELECT symbol, close_minute, {', '.join(f'{v} AS ati_{tf}m_{n}' for n, v in values.items())} FROM (SELECT *, CASE WHEN gain = 0 AND loss = 0 THEN 50 WHEN loss = 0 THEN 100 WHEN gain = 0 THEN 0 ELSE 100 - 100 / (1 + gain / loss) END AS rsi FROM r{tf}))""",
        ]
        columns += [f"ati_{tf}m_{n}" for n in values]
        joins.append(f"ASOF LEFT JOIN v{tf} ON b.symbol = v{tf}.symbol AND b.minute >= v{tf}.close_minute")
    return ", ".join(ctes) + f" SELECT b.symbol, b.minute, {', '.join(columns)} FROM {bars} b {' '.join(joins)}"


def anchored_timeframe_indicators(bars: DataFrame) -> DataFrame:
    return indicators(bars, *TIMEFRAMES)
