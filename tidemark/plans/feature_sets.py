"""Named sets of feature families, and the guard that keeps a look into the future out of them."""

from __future__ import annotations

from dataclasses import dataclass
from fnmatch import fnmatch

# The families of each named set, and names that a feature must not have.
_V1 = ("price", "return_path", "volatility", "trend_persistence", "volume", "support_resistance", "market_structure_void", "pullback_geometry")
_V2 = (*_V1, "breakout", "volume_price_pressure", "rejection_reversal")
_V3A = (*_V2, "acceleration", "trend_regime", "regime_switch", "micro_range", "volume_spike", "compressed_trend", "compressed_activity", "compressed_volatility")
V3B_ADDED = (
    "enhanced_support_resistance", "enhanced_market_structure_void", "enhanced_pullback_geometry", "fractal_structure", "pivot_line",
    "compressed_price_geometry", "compressed_breakout",
)
_V3B = (*_V3A, *V3B_ADDED)
SETS = {
    "v1": _V1,
    "v2": _V2,
    "v3a": _V3A,
    "v3b": _V3B,
    "v4": (*_V3B, "anchored_timeframe_candle", "anchored_timeframe_indicators", "timeframe_phase"),
    "long_H120_v0": tuple(f for f in _V3A if f != "compressed_activity"),
    "tail_v0": (*(f for f in _V3A if f != "compressed_activity"), "compressed_price_geometry"),
}
ADDITIONS = {
    "base_v0": (),
    **{f"base_plus_{f}": (f,) for f in V3B_ADDED},
    "base_plus_room_pullback": ("enhanced_market_structure_void", "enhanced_pullback_geometry"),
    "base_plus_support_room_pullback": ("enhanced_support_resistance", "enhanced_market_structure_void", "enhanced_pullback_geometry"),
    "base_plus_structure_core": ("enhanced_support_resistance", "enhanced_market_structure_void", "enhanced_pullback_geometry", "compressed_price_geometry"),
    "base_plus_all_v3b": V3B_ADDED,
}
FORBIDDEN = ("target", "future", "label", "hold_delta", "mfe", "mae", "diag_", "entry_price", "exit_price")
EXCLUDED_PATTERNS = ("target_*", "future_*", "*_label*", "*label*", "*_y", "*hold_delta*", "*mfe*", "*mae*", "diag_*")


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    family: str
    lookback_minutes: int
    uses_future: bool = False
    source: str = "ohlcv_1m"
    available_at: str = "bar_close"
    description: str = ""


def plus(base: tuple[str, ...], *more: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys((*base, *more)))


def without(base: tuple[str, ...], *drop: str) -> tuple[str, ...]:
    if unknown := [d for d in drop if d not in base]:
        raise ValueError(f"not in the set: {unknown}")
    return tuple(f for f in base if f not in drop)


def audit_names(columns: list[str], specs: list[FeatureSpec], patterns: tuple[str, ...] = EXCLUDED_PATTERNS) -> list[str]:
    """What is wrong with a feature matrix by its names and specs; empty if nothing is."""
    known = {s.name: s for s in specs}
    out = [f"duplicate column: {c}" for c in {c for c in columns if columns.count(c) > 1}]
    for c in columns:
        low = c.lower()
        out += [f"{c}: forbidden part {t}" for t in FORBIDDEN if t in low]
        out += [f"{c}: excluded pattern {p}" for p in patterns if fnmatch(c, p)]
        if c in ("open", "high", "low", "close", "volume"):
            out.append(f"{c}: raw bar column")
        if c not in known:
            out.append(f"{c}: no spec")
        elif known[c].uses_future:
            out.append(f"{c}: uses the future")
    return out + [f"{n}: in the specs only" for n in known if n not in columns]
