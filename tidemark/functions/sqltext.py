"""Null-safe scalar expressions as SQL text that Spark and other ANSI engines read alike.

Expressions are text, so that one definition of a feature gives a Spark plan and a query that another engine can check.
Numbers are written with exponents, which makes them doubles everywhere. NULL stands for "not known yet": a flag of an
unknown comparison is 0, a product with it is NULL, and no expression divides by zero or takes the log of a number
that is not positive.
"""

from __future__ import annotations

from collections.abc import Iterable


def num(x: float) -> str:
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def div(a: str, b: str, zero: float | None = None) -> str:
    """a / b; where b is 0 NULL, or `zero` if a is known."""
    fill = "NULL" if zero is None else f"CASE WHEN ({a}) IS NOT NULL THEN {num(zero)} END"
    return f"CASE WHEN ({b}) = 0 THEN {fill} ELSE ({a}) / ({b}) END"


def bps(a: str, b: str) -> str:
    """Log ratio in basis points, for positive a and b."""
    return f"CASE WHEN ({a}) > 0 AND ({b}) > 0 THEN ln(({a}) / ({b})) * 1e4 END"


def bps_eps(a: str, b: str) -> str:
    """Log ratio in basis points with a tiny number added to both."""
    return bps(f"({a}) + 1e-12", f"({b}) + 1e-12")


def pos(x: str) -> str:
    """The positive part; NULL stays."""
    return f"CASE WHEN ({x}) > 0 THEN ({x}) WHEN ({x}) IS NOT NULL THEN 0e0 END"


def clip(x: str, low: float, high: float) -> str:
    return f"CASE WHEN ({x}) < {num(low)} THEN {num(low)} WHEN ({x}) > {num(high)} THEN {num(high)} ELSE ({x}) END"


def flag(condition: str, unknown: int = 0) -> str:
    """1 or 0; `unknown` where the condition is NULL."""
    return f"CASE WHEN coalesce({condition}, {'true' if unknown else 'false'}) THEN 1e0 ELSE 0e0 END"


def sign(x: str) -> str:
    return f"CASE WHEN ({x}) > 0 THEN 1e0 WHEN ({x}) < 0 THEN -1e0 WHEN ({x}) IS NOT NULL THEN 0e0 END"


def position(value: str, low: str, high: str) -> str:
    """Where value stands in [low, high], from 0 to 1; 0.5 where there is no range."""
    return clip(div(f"({value}) - ({low})", f"({high}) - ({low})", 0.5), 0, 1)


def log1p(x: str) -> str:
    return f"ln(1e0 + ({x}))"


def row_mean(xs: Iterable[str]) -> str:
    """Mean of those that are known."""
    xs = list(xs)
    known = " + ".join(f"CASE WHEN ({x}) IS NULL THEN 0e0 ELSE 1e0 END" for x in xs)
    total = " + ".join(f"coalesce({x}, 0e0)" for x in xs)
    return f"CASE WHEN ({known}) > 0 THEN ({total}) / ({known}) END"


def row_max(xs: Iterable[str]) -> str:
    return f"greatest({', '.join(xs)})"


def row_min(xs: Iterable[str]) -> str:
    return f"least({', '.join(xs)})"
