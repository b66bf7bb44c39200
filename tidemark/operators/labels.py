"""Labels that look ahead: by minutes, never by rows, so that a gap gives NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quality import out_of_order
from tidemark.operators.series import ahead

#: Horizons of entries in minutes, look-aheads of exits, cost of a round trip in basis points.
HORIZONS, EXIT_LOOKAHEADS, COST_BPS = (60, 120, 240), {"long": (30, 60), "short": (15, 30)}, 15.0


def side_sign(side: str) -> int:
    key = str(side).strip().lower()
    if key in ("long", "buy", "1", "+1"):
        return 1
    if key in ("short", "sell", "-1"):
        return -1
    raise ValueError(f"unknown side {side!r}")


def checked_minutes(bars: DataFrame) -> DataFrame:
    """bars, if labels can be looked up in them: every row has a minute and no series has one twice, and rows came in
    order of time where their input_pos tells; else an error."""
    row = bars.agg(F.count_if(F.col("minute").isNull()).alias("unknown")).first()
    if row["unknown"]:
        raise ValueError(f"{row['unknown']} rows without a time")
    if not bars.groupBy("symbol", "minute").count().where("count > 1").isEmpty():
        raise ValueError("a minute stands twice, so that a look-up is ambiguous")
    if "input_pos" in bars.columns and out_of_order(bars).first()[0]:
        raise ValueError("rows are not in order of time")
    return bars


def at_offset(bars: DataFrame, offsets: dict[str, int], price: str = "open") -> DataFrame:
    """bars with the price at minute + offset under each name; NULL where that minute has no bar.

    Each offset sends the prices to the minutes that look for them; one union and one aggregate bring all together,
    however many offsets there are.
    """
    names = list(offsets)
    sent = bars.select(
        "symbol",
        F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.col("minute") - k).alias("minute"), F.col(price).alias("p")) for i, k in enumerate(offsets.values())])).alias("s"),
    ).select("symbol", "s.*")
    got = sent.groupBy("symbol", "minute").agg(*[F.max(F.when(F.col("i") == i, F.col("p"))).alias(n) for i, n in enumerate(names)])
    return bars.join(got, ["symbol", "minute"], "left")


def log_bps(to: Column, from_: Column) -> Column:
    """Log ratio of two prices in basis points, by IEEE arithmetic: a price of 0 gives an infinity, two of them NaN, where
    Spark's own would raise or give NULL."""
    ratio = F.when(from_ == 0, to * F.lit(float("inf"))).otherwise(to / from_)
    return F.when(ratio == 0, F.lit(float("-inf"))).otherwise(F.ln(ratio)) * 1e4


def net_return_bps(entry: Column, exit_: Column, side: str, cost: float = COST_BPS) -> Column:
    return F.when((entry > 0) & (exit_ > 0), side_sign(side) * F.ln(exit_ / entry) * 1e4 - cost)


def entry_labels(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS, cost: float = COST_BPS) -> DataFrame:
    """target_entry_net_bps_<side>_H<h>: enter at the next minute's open, leave h minutes later, less cost."""
    priced = at_offset(bars, {"__p1": 1} | {f"__x{h}": 1 + h for h in horizons})
    names = {f"target_entry_net_bps_{s}_H{h}": net_return_bps(F.col("__p1"), F.col(f"__x{h}"), s, cost) for s in ("long", "short") for h in horizons}
    return priced.select("symbol", "minute", *[c.alias(n) for n, c in names.items()])


def exit_labels(bars: DataFrame) -> DataFrame:
    """target_exit_hold_delta_bps_<side>_K<k>: what holding k minutes more brings, without cost."""
    ks = sorted({k for v in EXIT_LOOKAHEADS.values() for k in v})
    priced = at_offset(bars, {"__p1": 1} | {f"__x{k}": 1 + k for k in ks})
    names = {f"target_exit_hold_delta_bps_{s}_K{k}": net_return_bps(F.col("__p1"), F.col(f"__x{k}"), s, 0.0) for s, v in EXIT_LOOKAHEADS.items() for k in v}
    return priced.select("symbol", "minute", *[c.alias(n) for n, c in names.items()])


def excursions(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS, block: int = 1440) -> DataFrame:
    """diag_mfe_bps / diag_mae_bps _<side>_H<h>: best and worst price of the next h minutes against the next open.

    Unless each of these minutes has a bar with known prices, the label is NULL. Days are worked on apart, each with the
    minutes after it that are looked at.
    """
    day = F.floor(F.col("minute") / block)
    spread = bars.select("symbol", "minute", "open", "high", "low").withColumn("day", F.explode(F.sequence(F.floor((F.col("minute") - max(horizons)) / block), day)))
    w = Window.partitionBy("symbol", "day").orderBy("minute")
    seen = ahead(spread, w, {"high": "max", "low": "min"}, horizons)
    at = {"__p1": F.when(F.lead("minute").over(w) == F.col("minute") + 1, F.lead("open").over(w))}
    for h in horizons:
        # minutes are in order and not repeated: if the h-th row from here is h minutes on, none is missing between
        full = F.lead("minute", h).over(w) == F.col("minute") + h
        at |= {f"__up{h}": F.when(full, F.lead(f"high_{h}").over(w)), f"__down{h}": F.when(full, F.lead(f"low_{h}").over(w))}
    seen = seen.withColumns(at)
    p, out = F.col("__p1"), {}
    for h in horizons:
        up, down = (F.when((F.col(c) > 0) & (p > 0), F.ln(F.col(c) / p) * 1e4) for c in (f"__up{h}", f"__down{h}"))
        out |= {f"diag_mfe_bps_long_H{h}": up, f"diag_mae_bps_long_H{h}": down, f"diag_mfe_bps_short_H{h}": -down, f"diag_mae_bps_short_H{h}": -up}
    return seen.where(day == F.col("day")).select("symbol", "minute", *[c.alias(n) for n, c in out.items()])
