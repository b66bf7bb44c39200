"""Feature families of minute bars: each adds past-only columns to a sheet over symbol, minute, idx and OHLCV.

Rolling statistics count rows, not minutes, and are unknown until their window is full. Names, windows and pairs are
fixed values of the feature catalogue.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from tidemark.functions.sheet import Sheet
from tidemark.functions.sqltext import bps, bps_eps, clip, div, flag, log1p, num, pos, position, row_max, row_mean, row_min, sign

BASE = ("symbol", "minute", "idx", "open", "high", "low", "close", "volume")
FAMILIES: dict[str, "Family"] = {}


@dataclass(frozen=True)
class Family:
    name: str
    build: Callable[[Sheet], None]


def family(build: Callable[[Sheet], None]) -> Callable[[Sheet], None]:
    FAMILIES[build.__name__] = Family(build.__name__, build)
    return build


def sheet_of(*names: str) -> Sheet:
    """One sheet for some families; unknown names are an error."""
    if unknown := [n for n in names if n not in FAMILIES]:
        raise ValueError(f"unknown feature families: {unknown}")
    s = Sheet(BASE)
    for n in names:
        FAMILIES[n].build(s)
    return s


def _ret(s: Sheet, n: int) -> str:
    return s.let(f"r{n}", bps("close", s.lag("close", n)))


def _common(s: Sheet) -> None:
    _ret(s, 1)
    s.let("abs_r1", "abs(r1)")
    s.let("log_volume", log1p("volume"))
    s.let("log_volume_pos", log1p(pos("volume")))
    s.let("range_bps", bps_eps("high", "low"))
    s.let("plain_range_bps", bps("high", "low"))
    s.let("top", "greatest(open, close)")
    s.let("bottom", "least(open, close)")


def _prior(s: Sheet, n: int) -> tuple[str, str]:
    return s.roll("max", "high", n, 1), s.roll("min", "low", n, 1)


def _z(s: Sheet, x: str, n: int, zero: float | None = None, before: int = 0) -> str:
    return div(f"{x} - {s.roll('avg', x, n, before)}", s.roll("stddev_pop", x, n, before), zero)


@family
def price(s: Sheet) -> None:
    s.out("price_body_1m_bps", bps_eps("close", "open"))
    s.out("price_upper_wick_1m_bps", bps_eps("high", "greatest(open, close)"))
    s.out("price_lower_wick_1m_bps", bps_eps("least(open, close)", "low"))
    s.out("price_range_1m_bps", bps_eps("high", "low"))


@family
def return_path(s: Sheet) -> None:
    for n in (1, 3, 5, 15, 30, 60, 120, 240):
        s.out(f"ret_{n}m_bps", _ret(s, n))
    s.out("ret_15m_minus_60m_avg_bps", "r15 - r60 / 4e0")
    s.out("ret_60m_minus_240m_avg_bps", "r60 - r240 / 4e0")


@family
def volatility(s: Sheet) -> None:
    _common(s)
    for n in (15, 30, 60, 120, 240):
        s.out(f"realized_vol_{n}m_bps", s.roll("stddev_pop", "r1", n))
    for n in (5, 15, 60, 120, 240):
        s.out(f"range_{n}m_bps", bps_eps(s.roll("max", "high", n), s.roll("min", "low", n)))
    s.out("range_15m_to_60m_ratio", div("range_15m_bps", "range_60m_bps"))


def _slope(s: Sheet, n: int) -> str:
    s.let("ln_close", "CASE WHEN close > 0 THEN ln(close) END")
    s.let("row_at", "cast(idx AS double)")
    return f"{s.pair('regr_slope', 'ln_close', 'row_at', n)} * 1e4"


@family
def trend_persistence(s: Sheet) -> None:
    _common(s)
    s.let("up", flag("r1 > 0"))
    for n in (15, 30, 60, 120, 240):
        s.out(f"close_vs_ma_{n}m_bps", bps("close", s.roll("avg", "close", n)))
        s.out(f"trend_slope_{n}m_bps_per_min", _slope(s, n))
        s.out(f"trend_positive_ret_share_{n}m", s.roll("avg", "up", n))
    s.out("trend_slope_60m_minus_240m_bps_per_min", "trend_slope_60m_bps_per_min - trend_slope_240m_bps_per_min")


@family
def volume(s: Sheet) -> None:
    _common(s)
    for n in (15, 30, 60, 120, 240):
        s.out(f"log_volume_z_{n}m", _z(s, "log_volume", n))
        s.out(f"volume_to_ma_{n}m", div("volume", s.roll("avg", "volume", n)))


@family
def acceleration(s: Sheet) -> None:
    _common(s)
    for a, b in ((3, 8), (5, 13), (8, 21), (13, 34), (21, 55), (34, 89), (55, 144), (89, 233)):
        x, y = _ret(s, a), _ret(s, b)
        expected = f"{y} * {num(a / b)}"
        s.out(f"accel_ret_{a}m_vs_{b}m_expected_bps", f"{x} - {expected}")
        s.out(f"accel_ret_{a}m_to_{b}m_ratio", div(x, expected))
        s.out(f"accel_abs_ret_{a}m_to_{b}m_ratio", div(f"abs({x})", f"abs({y})"))
    for a, b, c in ((3, 8, 21), (5, 13, 34), (8, 21, 55), (13, 34, 89), (21, 55, 144), (34, 89, 233)):
        x, y, z = (f"{_ret(s, n)} / {num(n)}" for n in (a, b, c))
        s.out(f"ret_curvature_{a}_{b}_{c}m_bps_per_min", f"{x} - 2e0 * ({y}) + {z}")
        s.out(f"ret_rate_short_minus_long_{a}_{c}m_bps_per_min", f"{x} - {z}")
    for n in (15, 30, 60, 120, 240):
        s.out(f"ret_1m_z_{n}m", _z(s, "r1", n))
        s.out(f"ret_1m_abs_to_mean_abs_{n}m", div("abs_r1", s.roll("avg", "abs_r1", n)))
    s.let("sign_r1", "CASE WHEN r1 > 0 THEN 1e0 WHEN r1 < 0 THEN -1e0 END")
    s.let("same_sign", f"sign_r1 * {s.lag('sign_r1')}")
    for n in (5, 15, 30, 60, 120):
        s.out(f"ret_sign_persistence_{n}m", s.roll("avg", "same_sign", n))


@family
def trend_regime(s: Sheet) -> None:
    _common(s)
    s.let("up", flag("r1 > 0"))
    ma = {n: s.mean("close", n) for n in (15, 30, 60, 120, 240, 480, 720)}
    for n in ma:
        s.out(f"trend_regime_close_vs_ma_{n}m_bps", bps("close", ma[n]))
        s.out(f"trend_regime_slope_{n}m_bps_per_min", _slope(s, n))
        s.out(f"trend_regime_efficiency_{n}m", div(f"abs({_ret(s, n)})", s.roll("sum", "abs_r1", n)))
        s.out(f"trend_regime_positive_share_{n}m", s.roll("avg", "up", n))
        s.out(f"trend_regime_signed_absret_share_{n}m", div(s.roll("sum", "r1", n), s.roll("sum", "abs_r1", n)))
    for a, b in ((15, 60), (30, 120), (60, 240), (120, 480), (240, 720)):
        s.out(f"trend_regime_ma_stack_{a}_{b}m_bps", bps(ma[a], ma[b]))
        s.out(f"trend_regime_slope_diff_{a}_{b}m_bps_per_min", f"trend_regime_slope_{a}m_bps_per_min - trend_regime_slope_{b}m_bps_per_min")
        inside = f"{ma[a]} IS NOT NULL AND {ma[b]} IS NOT NULL AND close >= least({ma[a]}, {ma[b]}) AND close <= greatest({ma[a]}, {ma[b]})"
        s.out(f"trend_regime_close_between_ma_{a}_{b}m", flag(inside))
    stack = [sign(f"{ma[a]} - {ma[b]}") for a, b in ((15, 30), (30, 60), (60, 120), (120, 240), (240, 480), (480, 720))]
    s.out("trend_regime_ma_stack_alignment_score", row_mean(s.let(f"stack_{k}", x) for k, x in enumerate(stack)))


@family
def regime_switch(s: Sheet) -> None:
    _common(s)
    stats = {}
    for n in (15, 30, 60, 120, 240, 480):
        stats[n] = {
            "vol": s.roll("stddev_pop", "r1", n),
            "absret": s.roll("avg", "abs_r1", n),
            "range": s.roll("avg", "plain_range_bps", n),
            "volume": s.roll("avg", "log_volume_pos", n),
        }
        for name, key in (("vol", "vol"), ("activity", "absret"), ("volume", "volume")):
            s.out(f"regime_switch_{name}_z_{n}m", _z(s, stats[n][key], n))
    for a, b in ((15, 60), (30, 120), (60, 240), (120, 480)):
        for key in ("vol", "absret", "range", "volume"):
            s.out(f"regime_switch_{key}_ratio_{a}_{b}m", div(stats[a][key], stats[b][key]))
    for n in (15, 30, 60, 120, 240):
        f = max(1, n // 4)
        fast, slow = _ret(s, f), _ret(s, n)
        s.out(f"regime_switch_fast_slow_return_disagree_{n}m", flag(f"({sign(fast)}) <> ({sign(slow)})", 1))
        s.out(f"regime_switch_fast_minus_slow_return_{n}m_bps", f"{fast} - {slow} * {num(f / n)}")


@family
def micro_range(s: Sheet) -> None:
    _common(s)
    s.let("body_abs", "abs(" + bps("close", "open") + ")")
    s.let("wick_up", bps("high + 1e-12", "greatest(open, close)"))
    s.let("wick_down", bps("least(open, close)", "low + 1e-12"))
    s.out("micro_bar_range_1m_bps", "range_bps")
    s.out("micro_body_to_range_1m", div("body_abs", "range_bps", 0))
    s.out("micro_upper_wick_to_range_1m", div("wick_up", "range_bps", 0))
    s.out("micro_lower_wick_to_range_1m", div("wick_down", "range_bps", 0))
    s.out("micro_close_position_1m", position("close", "low", "high"))
    s.let("wick_imbalance", div("wick_down - wick_up", "wick_up + wick_down", 0))
    for n in (5, 8, 13, 21, 34, 55, 89, 144, 240):
        s.out(f"micro_range_mean_{n}m_bps", s.roll("avg", "range_bps", n))
        s.out(f"micro_range_z_{n}m", _z(s, "range_bps", n, 0))
        s.out(f"micro_body_share_mean_{n}m", s.roll("avg", "micro_body_to_range_1m", n))
        s.out(f"micro_close_position_mean_{n}m", s.roll("avg", "micro_close_position_1m", n))
        s.out(f"micro_wick_imbalance_mean_{n}m", s.roll("avg", "wick_imbalance", n))
    for a, b in ((5, 21), (8, 34), (13, 55), (21, 89), (34, 144), (55, 240)):
        s.out(f"micro_range_compression_{a}_{b}m", div(s.roll("avg", "range_bps", a), s.roll("avg", "range_bps", b), 1))
        s.out(f"micro_range_volatility_ratio_{a}_{b}m", div(s.roll("stddev_pop", "range_bps", a), s.roll("stddev_pop", "range_bps", b), 1))


@family
def volume_spike(s: Sheet) -> None:
    _common(s)
    x = "log_volume_pos"
    s.let("weighted_abs", f"{x} * abs_r1")
    s.let("up_log_volume", f"CASE WHEN r1 > 0 THEN {x} ELSE 0e0 END")
    s.let("down_log_volume", f"CASE WHEN r1 < 0 THEN {x} ELSE 0e0 END")
    for n in (5, 15, 30, 60, 120, 240, 480):
        mean, std = s.roll("avg", x, n), s.roll("stddev_pop", x, n)
        s.out(f"volume_spike_logvol_z_{n}m", div(f"{x} - {mean}", std))
        s.out(f"volume_spike_logvol_to_mean_{n}m", div(x, mean))
        s.out(f"volume_spike_top_share_{n}m", s.roll("avg", s.let(f"spike_{n}", flag(f"{x} > {mean} + {std}")), n))
        s.out(f"volume_spike_absret_weighted_logvol_{n}m", s.roll("avg", "weighted_abs", n))
        up, down = s.roll("sum", "up_log_volume", n), s.roll("sum", "down_log_volume", n)
        s.out(f"volume_spike_up_down_logvol_imbalance_{n}m", div(f"{up} - {down}", f"{up} + {down}"))
    for a, b in ((5, 30), (15, 60), (30, 120), (60, 240), (120, 480)):
        s.out(f"volume_spike_logvol_mean_ratio_{a}_{b}m", div(s.roll("avg", x, a), s.roll("avg", x, b)))
        s.out(f"volume_spike_logvol_std_ratio_{a}_{b}m", div(s.roll("stddev_pop", x, a), s.roll("stddev_pop", x, b)))


@family
def compressed_trend(s: Sheet) -> None:
    groups = {"short": (5, 15, 30), "mid": (60, 120), "long": (240, 480)}
    r = {n: _ret(s, n) for g in groups.values() for n in g}
    for g, ns in groups.items():
        s.out(f"compressed_trend_{g}_mean_bps", row_mean(r[n] for n in ns))
        s.out(f"compressed_trend_{g}_max_bps", row_max(r[n] for n in ns))
        s.out(f"compressed_trend_{g}_min_bps", row_min(r[n] for n in ns))
    short, mid, long = (f"compressed_trend_{g}_mean_bps" for g in groups)
    s.out("compressed_trend_short_minus_mid_bps", f"{short} - {mid}")
    s.out("compressed_trend_mid_minus_long_bps", f"{mid} - {long}")
    s.out("compressed_trend_alignment_score", row_mean(s.let(f"sign_r{n}", sign(r[n])) if n != 1 else "" for n in r))
    s.out("compressed_trend_positive_window_share", f"({' + '.join(flag(f'{x} > 0') for x in r.values())}) / 7e0")
    s.out("compressed_trend_abs_short_to_long_ratio", div(f"abs({short})", f"abs({long})"))
    mean = s.let("trend_row_mean", row_mean(r.values()))
    squares = row_mean(f"({x} - {mean}) * ({x} - {mean})" for x in r.values())
    s.out("compressed_trend_window_std_bps", f"sqrt({squares})")
    s.out("compressed_trend_window_range_bps", f"{row_max(r.values())} - {row_min(r.values())}")
    s.out("compressed_trend_best_window_bps", row_max(r.values()))
    s.out("compressed_trend_worst_window_bps", row_min(r.values()))
    s.out("compressed_trend_short_mid_same_sign", flag(f"({sign(short)}) = ({sign(mid)})"))
    s.out("compressed_trend_mid_long_same_sign", flag(f"({sign(mid)}) = ({sign(long)})"))


@family
def compressed_activity(s: Sheet) -> None:
    _common(s)
    p = "compressed_activity_"
    kinds = {"absret": "abs_r1", "range": "plain_range_bps", "volume": "log_volume"}
    for k, x in kinds.items():
        s.out(f"{p}{k}_short_mean", row_mean([s.roll("avg", x, 15), s.roll("avg", x, 30)]))
        s.out(f"{p}{k}_mid_mean", row_mean([s.roll("avg", x, 60), s.roll("avg", x, 120)]))
        s.out(f"{p}{k}_long_mean", s.roll("avg", x, 240))
    for size in ("short", "mid"):
        for k in kinds:
            s.out(f"{p}{k}_{size}_to_long", div(f"{p}{k}_{size}_mean", f"{p}{k}_long_mean"))
        s.out(f"{p}joint_{size}_score", f"({' + '.join(f'{p}{k}_{size}_to_long' for k in kinds)}) / 3e0")
    s.out(f"{p}return_volume_agreement", f"({sign('r1')}) * log_volume")
    s.out(f"{p}return_volume_agreement_60m", s.roll("avg", f"{p}return_volume_agreement", 60))


@family
def compressed_volatility(s: Sheet) -> None:
    _common(s)
    p = "compressed_vol_"
    v = {n: s.roll("stddev_pop", "r1", n) for n in (15, 30, 60, 120, 240, 480)}
    for g, ns in {"short": (15, 30), "mid": (60, 120), "long": (240, 480)}.items():
        s.out(f"{p}{g}_mean_bps", row_mean(v[n] for n in ns))
    s.out(f"{p}short_to_mid", div(f"{p}short_mean_bps", f"{p}mid_mean_bps"))
    s.out(f"{p}mid_to_long", div(f"{p}mid_mean_bps", f"{p}long_mean_bps"))
    s.out(f"{p}short_to_long", div(f"{p}short_mean_bps", f"{p}long_mean_bps"))
    s.out(f"{p}expansion_score", f"({p}short_to_mid + {p}mid_to_long) / 2e0")
    s.out(f"{p}contraction_score", div("1e0", f"{p}expansion_score"))
    s.out(f"{p}window_max_bps", row_max(v.values()))
    s.out(f"{p}window_min_bps", row_min(v.values()))
    s.out(f"{p}window_spread_bps", f"{p}window_max_bps - {p}window_min_bps")
    rank = " ".join(f"WHEN {x} = {p}window_max_bps THEN {num(k)}" for k, x in enumerate(v.values()))
    s.out(f"{p}argmax_window_rank", f"CASE WHEN {' OR '.join(f'{x} IS NULL' for x in v.values())} THEN NULL {rank} END")
    s.out(f"{p}of_vol_60m", s.roll("stddev_pop", "abs_r1", 60))
    s.out(f"{p}of_vol_60_to_240", div(f"{p}of_vol_60m", s.roll("stddev_pop", "abs_r1", 240)))


@family
def enhanced_support_resistance(s: Sheet) -> None:
    for n in (60, 120, 240, 480, 720):
        ph, pl = _prior(s, n)
        s.out(f"esr_dist_to_prev_resistance_{n}m_bps", bps_eps(ph, "close"))
        s.out(f"esr_dist_to_prev_support_{n}m_bps", bps_eps("close", pl))
        s.out(f"esr_position_in_prev_range_{n}m", div(f"close - {pl}", f"{ph} - {pl}"))
        s.out(f"esr_dist_from_prev_mid_{n}m_bps", bps_eps("close", f"({ph} + {pl}) / 2e0"))
        s.out(f"esr_prev_range_pct_price_{n}m", f"CASE WHEN {ph} = {pl} THEN NULL ELSE {div(f'{ph} - {pl}', 'close')} END")
        s.out(f"esr_breakout_close_over_prev_high_{n}m_bps", pos(s.let(f"over_{n}", bps_eps("close", ph))))
        s.out(f"esr_breakdown_close_under_prev_low_{n}m_bps", pos(s.let(f"under_{n}", bps_eps(pl, "close"))))
        s.out(f"esr_failed_breakout_wick_{n}m_bps", f"({pos(s.let(f'pierce_up_{n}', bps_eps('high', ph)))}) * ({flag(f'close < {ph}')})")
        s.out(f"esr_failed_breakdown_wick_{n}m_bps", f"({pos(s.let(f'pierce_down_{n}', bps_eps(pl, 'low')))}) * ({flag(f'close > {pl}')})")
        s.out(f"esr_resistance_vs_support_room_ratio_{n}m", div(pos(f"{ph} - close"), f"({pos(f'close - {pl}')}) + 1e-12"))
    s.out("esr_position_120m_minus_720m", "esr_position_in_prev_range_120m - esr_position_in_prev_range_720m")
    s.out("esr_prev_range_240m_div_720m", div("esr_prev_range_pct_price_240m", "esr_prev_range_pct_price_720m"))


@family
def enhanced_market_structure_void(s: Sheet) -> None:
    before = s.lag("close")
    s.let("true_range", f"greatest(high - low, abs(high - {before}), abs(low - {before}))")
    for n in (60, 120, 240, 480, 720):
        ph, pl = _prior(s, n)
        atr = s.roll("avg", "true_range", max(15, min(n, 120)))
        wide = s.let(f"prior_range_{n}", f"CASE WHEN {ph} <> {pl} THEN {ph} - {pl} END")
        s.out(f"emsv_upside_room_norm_range_{n}m", div(f"{ph} - close", wide))
        s.out(f"emsv_downside_room_norm_range_{n}m", div(f"close - {pl}", wide))
        s.out(f"emsv_upside_room_norm_atr_{n}m", div(f"{ph} - close", atr))
        s.out(f"emsv_downside_room_norm_atr_{n}m", div(f"close - {pl}", atr))
        s.out(f"emsv_room_asymmetry_up_minus_down_{n}m", f"({bps_eps(ph, 'close')}) - ({bps_eps('close', pl)})")
        per_atr = div(wide, atr)
        s.out(f"emsv_upside_void_after_breakout_{n}m", f"({pos(s.let(f'over_{n}', bps_eps('close', ph)))}) * ({per_atr})")
        s.out(f"emsv_downside_void_after_breakdown_{n}m", f"({pos(s.let(f'under_{n}', bps_eps(pl, 'close')))}) * ({per_atr})")
        s.out(f"emsv_close_high_quartile_room_{n}m", f"({flag(f'emsv_downside_room_norm_range_{n}m >= 0.75e0')}) * emsv_upside_room_norm_atr_{n}m")
        s.out(f"emsv_close_low_quartile_room_{n}m", f"({flag(f'emsv_downside_room_norm_range_{n}m <= 0.25e0')}) * emsv_downside_room_norm_atr_{n}m")
    s.out("emsv_upside_room_120m_minus_480m", "emsv_upside_room_norm_range_120m - emsv_upside_room_norm_range_480m")
    s.out("emsv_room_asymmetry_120m_minus_480m", "emsv_room_asymmetry_up_minus_down_120m - emsv_room_asymmetry_up_minus_down_480m")


@family
def enhanced_pullback_geometry(s: Sheet) -> None:
    change = s.let("pct_change", div(f"close - {s.lag('close')}", s.lag("close")))
    for n in (30, 60, 120, 240, 480):
        hi, lo = s.roll("max", "high", n), s.roll("min", "low", n)
        vol = s.roll("stddev_samp", change, n)
        s.out(f"epb_drawdown_from_high_{n}m_bps", bps_eps("close", hi))
        s.out(f"epb_bounce_from_low_{n}m_bps", bps_eps("close", lo))
        depth = f"epb_pullback_depth_{n}m"
        s.out(depth, div(f"{hi} - close", f"{hi} - {lo}"))
        s.out(f"epb_recovery_ratio_{n}m", div(f"close - {lo}", f"{hi} - {lo}"))
        slope = s.let(f"eps_ret_{n}", bps_eps("close", s.lag("close", n)))
        s.out(f"epb_shallow_pullback_trend_score_{n}m", f"({pos(slope)}) / 1e2 * (1e0 - ({clip(depth, 0, 1)}))")
        s.out(f"epb_recovery_over_depth_{n}m", div(f"epb_recovery_ratio_{n}m", f"abs({depth}) + 1e-12"))
        s.out(f"epb_ma_reclaim_{n}m_bps", bps_eps("close", s.roll("avg", "close", n)))
        s.out(f"epb_drawdown_norm_vol_{n}m", div(f"epb_drawdown_from_high_{n}m_bps", f"{vol} * 1e4"))
        s.out(f"epb_bounce_norm_vol_{n}m", div(f"epb_bounce_from_low_{n}m_bps", f"{vol} * 1e4"))
    s.out("epb_pullback_depth_60m_minus_240m", "epb_pullback_depth_60m - epb_pullback_depth_240m")
    s.out("epb_shallow_trend_120m_minus_480m", "epb_shallow_pullback_trend_score_120m - epb_shallow_pullback_trend_score_480m")


@family
def fractal_structure(s: Sheet) -> None:
    for n in (15, 30, 60, 120, 240):
        k = max(3, n // 2)
        fh, fl = s.roll("max", "high", k), s.roll("min", "low", k)
        sh, sl = s.roll("max", "high", k, k), s.roll("min", "low", k, k)
        hh, hl, at = f"fs_higher_high_strength_{n}m_bps", f"fs_higher_low_strength_{n}m_bps", f"fs_close_position_recent_half_{n}m"
        s.out(hh, bps_eps(fh, sh))
        s.out(hl, bps_eps(fl, sl))
        s.out(f"fs_structure_slope_{n}m_bps", f"({hh} + {hl}) / 2e0")
        now, then = (f"CASE WHEN {a} <> {b} THEN {a} - {b} END" for a, b in ((fh, fl), (sh, sl)))
        s.out(f"fs_structure_width_change_{n}m_bps", bps_eps(now, then))
        s.out(at, div(f"close - {fl}", f"{fh} - {fl}"))
        s.out(f"fs_uptrend_structure_score_{n}m", f"(({pos(hh)}) + ({pos(hl)})) / 2e2 * ({clip(at, 0, 1)})")


@family
def pivot_line(s: Sheet) -> None:
    for n in (60, 120, 240, 480):
        ph, pl = _prior(s, n)
        p = s.let(f"pivot_{n}", f"({ph} + {pl} + {s.lag('close')}) / 3e0")
        r1 = f"2e0 * {p} - {pl}"
        levels = {"pivot": p, "r1": r1, "s1": f"2e0 * {p} - {ph}", "r2": f"{p} + ({ph} - {pl})", "s2": f"{p} - ({ph} - {pl})"}
        for name, level in levels.items():
            s.out(f"pl_dist_to_{name}_{n}m_bps", bps_eps("close", level))
        s.out(f"pl_above_pivot_{n}m", flag(f"close > {p}"))
        s.out(f"pl_between_pivot_r1_{n}m", flag(f"close > {p} AND close < {r1}"))


@family
def compressed_price_geometry(s: Sheet) -> None:
    at, room, wide = {}, {}, {}
    for n in (60, 120, 240, 480, 720):
        ph, pl = _prior(s, n)
        at[n] = s.let(f"cpg_at_{n}", div(f"close - {pl}", f"{ph} - {pl}"))
        room[n] = s.let(f"cpg_room_{n}", div(f"{ph} - close", f"{ph} - {pl}"))
        wide[n] = s.let(f"cpg_wide_{n}", f"CASE WHEN {ph} <> {pl} THEN {div(f'{ph} - {pl}', 'close')} END")
    s.out("cpg_position_mean", row_mean(at.values()))
    s.out("cpg_position_min", row_min(at.values()))
    s.out("cpg_position_max", row_max(at.values()))
    s.out("cpg_upside_room_mean", row_mean(room.values()))
    s.out("cpg_upside_room_max", row_max(room.values()))
    s.out("cpg_pullback_depth_mean", row_mean(room.values()))
    s.out("cpg_pullback_depth_min", row_min(room.values()))
    s.out("cpg_range_pct_mean", row_mean(wide.values()))
    s.out("cpg_range_pct_max", row_max(wide.values()))
    s.out("cpg_position_120m_minus_720m", f"{at[120]} - {at[720]}")
    s.out("cpg_upside_room_120m_minus_720m", f"{room[120]} - {room[720]}")
    s.out("cpg_shallow_pullback_room_score", f"(1e0 - ({clip(room[120], 0, 1)})) * ({pos(room[240])})")


@family
def compressed_breakout(s: Sheet) -> None:
    vol_z = s.let("volume_z_120", div(f"volume - {s.roll('avg', 'volume', 120)}", s.roll("stddev_samp", "volume", 120)))
    up, down, failed, wide = [], [], [], []
    for n in (30, 60, 120, 240, 480):
        ph, pl = _prior(s, n)
        up.append(s.let(f"cbo_up_{n}", pos(bps_eps("close", ph))))
        down.append(s.let(f"cbo_down_{n}", pos(bps_eps(pl, "close"))))
        failed.append(s.let(f"cbo_failed_{n}", f"({pos(bps_eps('high', ph))}) * ({flag(f'close < {ph}')})"))
        wide.append(s.let(f"cbo_wide_{n}", f"CASE WHEN high <> low THEN {div('high - low', f'{ph} - {pl}')} END"))
    s.out("cbo_breakout_mean_bps", row_mean(up))
    s.out("cbo_breakout_max_bps", row_max(up))
    s.out("cbo_breakout_count_positive", " + ".join(flag(f"{x} > 0") for x in up))
    s.out("cbo_breakdown_mean_bps", row_mean(down))
    s.out("cbo_breakdown_max_bps", row_max(down))
    s.out("cbo_failed_breakout_mean_bps", row_mean(failed))
    s.out("cbo_failed_breakout_max_bps", row_max(failed))
    s.out("cbo_range_expansion_mean", row_mean(wide))
    s.out("cbo_range_expansion_max", row_max(wide))
    s.out("cbo_breakout_volume_confirm_score", f"{row_max(up)} * ({pos(vol_z)})")
    s.out("cbo_breakout_minus_failed_breakout_bps", f"{row_max(up)} - {row_max(failed)}")


@family
def support_resistance(s: Sheet) -> None:
    for n in (15, 30, 60, 120, 240):
        hi, lo = s.roll("max", "high", n), s.roll("min", "low", n)
        ph, pl = _prior(s, n)
        s.out(f"sr_dist_to_support_{n}m_bps", bps_eps("close", lo))
        s.out(f"sr_dist_to_resistance_{n}m_bps", bps_eps(hi, "close"))
        s.out(f"sr_position_in_range_{n}m", div(f"close - {lo}", f"{hi} - {lo}"))
        s.out(f"sr_break_above_prev_resistance_{n}m_bps", bps_eps("close", ph))
        s.out(f"sr_break_below_prev_support_{n}m_bps", bps_eps(pl, "close"))


@family
def market_structure_void(s: Sheet) -> None:
    for n in (30, 60, 120, 240):
        ph, pl = _prior(s, n)
        s.out(f"msv_upside_room_to_prev_high_{n}m_bps", bps_eps(ph, "close"))
        s.out(f"msv_downside_room_to_prev_low_{n}m_bps", bps_eps("close", pl))
        s.out(f"msv_position_vs_prev_range_{n}m", div(f"close - {pl}", f"{ph} - {pl}"))
        s.out(f"msv_breakout_over_prev_high_{n}m_bps", pos(s.let(f"over_{n}", bps_eps("close", ph))))
        s.out(f"msv_breakdown_under_prev_low_{n}m_bps", pos(s.let(f"under_{n}", bps_eps(pl, "close"))))
        s.out(f"msv_bars_since_high_{n}m", s.since("max", "high", n))
        s.out(f"msv_bars_since_low_{n}m", s.since("min", "low", n))


@family
def breakout(s: Sheet) -> None:
    _common(s)
    for n in (15, 30, 60, 120, 240):
        ph, pl = _prior(s, n)
        up, down = s.let(f"over_{n}", bps_eps("close", ph)), s.let(f"under_{n}", bps_eps(pl, "close"))
        z = s.let(f"prior_volume_z_{n}", _z(s, "log_volume", n, before=1))
        s.out(f"breakout_close_above_prev_high_{n}m_bps", up)
        s.out(f"breakout_close_below_prev_low_{n}m_bps", down)
        s.out(f"breakout_up_strength_{n}m_bps", pos(up))
        s.out(f"breakout_down_strength_{n}m_bps", pos(down))
        s.out(f"breakout_high_extension_prev_range_{n}m", div(f"high - {ph}", f"{ph} - {pl}"))
        s.out(f"breakout_low_extension_prev_range_{n}m", div(f"{pl} - low", f"{ph} - {pl}"))
        s.out(f"breakout_range_expansion_{n}m", div("range_bps", s.roll("avg", "range_bps", n, 1)))
        s.out(f"breakout_volume_expansion_{n}m", div("volume", s.roll("avg", "volume", n, 1)))
        s.out(f"breakout_up_with_volume_{n}m", f"({pos(up)}) * ({pos(z)})")
        s.out(f"breakout_down_with_volume_{n}m", f"({pos(down)}) * ({pos(z)})")


@family
def volume_price_pressure(s: Sheet) -> None:
    s.let("log_volume", log1p("volume"))
    r = s.let("eps_ret_1", bps_eps("close", s.lag("close")))
    s.let("signed_volume", f"coalesce({sign(r)}, 0e0) * volume")
    s.let("up_volume", f"CASE WHEN {r} > 0 THEN volume ELSE 0e0 END")
    s.let("down_volume", f"CASE WHEN {r} < 0 THEN volume ELSE 0e0 END")
    s.let("weighted_ret", f"{r} * volume")
    s.let("weighted_up", f"({pos(r)}) * volume")
    s.let("weighted_down", f"({pos(f'-{r}')}) * volume")
    for n in (15, 30, 60, 120, 240):
        total = s.roll("sum", "volume", n)
        up, down = s.roll("sum", "up_volume", n), s.roll("sum", "down_volume", n)
        s.out(f"vpp_signed_volume_imbalance_{n}m", div(s.roll("sum", "signed_volume", n), total))
        s.out(f"vpp_up_volume_share_{n}m", div(up, total))
        s.out(f"vpp_down_volume_share_{n}m", div(down, total))
        s.out(f"vpp_volume_weighted_return_{n}m_bps", div(s.roll("sum", "weighted_ret", n), total))
        s.out(f"vpp_up_return_pressure_{n}m_bps", div(s.roll("sum", "weighted_up", n), total))
        s.out(f"vpp_down_return_pressure_{n}m_bps", div(s.roll("sum", "weighted_down", n), total))
        s.out(f"vpp_up_down_volume_ratio_{n}m", div(up, down))
        s.out(f"vpp_return_volume_corr_{n}m", s.pair("corr", r, "log_volume", n))


@family
def rejection_reversal(s: Sheet) -> None:
    s.out("rr_candle_range_bps", bps_eps("high", "low"))
    s.out("rr_body_bps", f"abs({bps_eps('close', 'open')})")
    s.out("rr_upper_wick_bps", bps_eps("high", "greatest(open, close)"))
    s.out("rr_lower_wick_bps", bps_eps("least(open, close)", "low"))
    s.out("rr_upper_wick_ratio", div("rr_upper_wick_bps", "rr_candle_range_bps"))
    s.out("rr_lower_wick_ratio", div("rr_lower_wick_bps", "rr_candle_range_bps"))
    s.out("rr_close_position_in_candle", div("close - low", "high - low"))
    s.out("rr_body_direction", sign("close - open"))
    for n in (15, 30, 60, 120, 240):
        ph, pl = _prior(s, n)
        s.out(f"rr_failed_breakout_{n}m_bps", f"CASE WHEN high > {ph} AND close < {ph} THEN {bps_eps('high', ph)} ELSE 0e0 END")
        s.out(f"rr_failed_breakdown_{n}m_bps", f"CASE WHEN low < {pl} AND close > {pl} THEN {bps_eps(pl, 'low')} ELSE 0e0 END")
        for side in ("upper", "lower"):
            s.out(f"rr_{side}_wick_z_{n}m", _z(s, f"rr_{side}_wick_bps", n, before=1))
        s.out(f"rr_upper_rejection_score_{n}m", f"({pos(f'rr_upper_wick_z_{n}m')}) * (1e0 - rr_close_position_in_candle)")
        s.out(f"rr_lower_rejection_score_{n}m", f"({pos(f'rr_lower_wick_z_{n}m')}) * rr_close_position_in_candle")


@family
def pullback_geometry(s: Sheet) -> None:
    for n in (30, 60, 120, 240):
        hi, lo = s.roll("max", "high", n), s.roll("min", "low", n)
        s.out(f"pbg_drawdown_from_high_{n}m_bps", bps_eps("close", hi))
        s.out(f"pbg_bounce_from_low_{n}m_bps", bps_eps("close", lo))
        s.out(f"pbg_pullback_depth_in_range_{n}m", div(f"{hi} - close", f"{hi} - {lo}"))
        s.out(f"pbg_recovery_from_low_in_range_{n}m", div(f"close - {lo}", f"{hi} - {lo}"))
    s.out("pbg_drawdown_30m_minus_120m_bps", "pbg_drawdown_from_high_30m_bps - pbg_drawdown_from_high_120m_bps")
    s.out("pbg_pullback_depth_60m_minus_240m", "pbg_pullback_depth_in_range_60m - pbg_pullback_depth_in_range_240m")


@family
def timeframe_phase(s: Sheet) -> None:
    for tf in (5, 15, 60, 240):
        m = s.let(f"phase_{tf}", f"cast(minute % {tf} AS double)")
        s.out(f"phase_{tf}m_minute", m)
        s.out(f"phase_{tf}m_frac", f"{m} / {num(tf)}")
        s.out(f"phase_{tf}m_sin", f"sin(2e0 * pi() * ({m} / {num(tf)}))")
        s.out(f"phase_{tf}m_cos", f"cos(2e0 * pi() * ({m} / {num(tf)}))")
        s.out(f"phase_{tf}m_minutes_to_close", f"{num(tf - 1)} - {m}")
        s.out(f"phase_{tf}m_is_first_minute", flag(f"{m} = 0"))
        s.out(f"phase_{tf}m_is_last_minute", flag(f"{m} = {tf - 1}"))
    s.let("phase_day", "cast(minute % 1440 AS double) / 1440e0")
    s.out("phase_day_frac", "phase_day")
    s.out("phase_day_sin", "sin(2e0 * pi() * phase_day)")
    s.out("phase_day_cos", "cos(2e0 * pi() * phase_day)")
