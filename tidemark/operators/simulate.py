"""Thresholds of scores over time, and greedy trade simulation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.labels import log_bps, side_sign
from tidemark.operators.series import ahead, extremes

#: What trades and scores are told apart by: no series touches another.
KEYS = ("symbol", "fold")
#: Days of the spans that trades are found in.
SPAN_DAYS = 28
_KINDS = {"double": T.DoubleType(), "long": T.LongType(), "string": T.StringType()}


def _extended(df: DataFrame, **more: str) -> T.StructType:
    """The schema of df with some more columns (a copy: adding to df.schema would change df's own)."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, _KINDS[t]) for n, t in more.items())])


def rolling_quantile(scores: DataFrame, minutes: int, q: float, at_least: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """scores (keys, minute, score, is_eval) with rolling_thr and history_count over the `minutes` before each row, the
    row itself left out; rolling_thr is NULL below `at_least` scores.

    Blocks of `minutes` are worked on apart, each with the block before it; within, scores are kept sorted as the frame
    moves.
    """
    block = F.floor(F.col("minute") / minutes)
    spread = scores.withColumn("__block", F.explode(F.array(block, block + 1))).withColumn("__own", F.col("__block") == block)
    fields = _extended(spread.drop("__block"), rolling_thr="double", history_count="long")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("minute", kind="stable").reset_index(drop=True)
        minute, score = pdf["minute"].to_numpy(), pdf["score"].to_numpy(float)
        index = pd.to_datetime(minute * 60_000_000_000)
        window = pd.Series(score, index=index).rolling(f"{minutes}min", closed="left", min_periods=1)
        count = window.count().fillna(0).to_numpy()
        pdf["rolling_thr"] = np.where(count >= at_least, window.quantile(q).to_numpy(), np.nan)
        pdf["history_count"] = count.astype(np.int64)
        return pdf[pdf["__own"]][[f.name for f in fields]]

    out = spread.groupBy(*keys, "__block").applyInPandas(work, fields)
    return out.drop("__own").withColumn("rolling_thr", F.nullif("rolling_thr", F.lit(float("nan"))))


def with_history(evaluated: DataFrame, past: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Evaluation rows and score history of the same keys in one table (is_eval); history at an evaluated minute goes."""
    fresh = past.join(evaluated.select(*keys, "minute"), [*keys, "minute"], "left_anti")
    return evaluated.withColumn("is_eval", F.lit(True)).unionByName(fresh.withColumn("is_eval", F.lit(False)), allowMissingColumns=True)


#: Tags of history rows that count for every fold.
SHARED_TAGS = ("*", "all", "global", "train")


def history_by_fold(past: DataFrame, folds: list[str]) -> DataFrame:
    """past with a row for each fold that it counts for: its own, or every one of `folds` where its tag is a shared one. Rows
    without a fold column count for all; rows of other folds go. A minute that a fold has of its own and shared stands
    twice."""
    every = F.array(*[F.lit(f) for f in folds])
    if "fold" not in past.columns:
        return past.withColumn("fold", F.explode(every))
    tag = F.col("fold").cast("string")
    counts = F.when(tag.isin(*SHARED_TAGS), every).when(tag.isin(*folds), F.array(tag))
    return past.withColumn("__for", F.explode(counts)).withColumn("fold", F.col("__for")).drop("__for")


def history_threshold(past: DataFrame, q: float, floor: float, at_least: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, n, threshold): one fixed threshold per fold from its history; too little history never trades."""
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    per = past.where(finite).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile("score", q).alias("__q"))
    return per.select(*keys, "n", F.when(F.col("n") < at_least, float("inf")).otherwise(F.greatest("__q", F.lit(floor))).alias("threshold"))


def entry_rule(score: Column, threshold: Column, min_score: float | Column | None = None, min_margin: float | Column | None = None, min_ratio: float | Column | None = None) -> Column:
    """Why a row does not enter, NULL if it does: strictly over the threshold, then the further filters. A filter that is
    a column and NULL asks for nothing."""
    out = F.when(threshold.isNull() | F.isnan(threshold), "threshold_not_ready").when(score.isNull() | ~(score > threshold), "below_threshold")
    if min_score is not None:
        out = out.when(score < min_score, "below_min_score")
    if min_margin is not None:
        out = out.when(score - threshold < min_margin, "below_min_margin")
    if min_ratio is not None:
        least = F.lit(min_ratio)
        out = out.when(least.isNotNull() & F.coalesce(F.when(threshold > 0, score / threshold) < least, F.lit(True)), "below_min_ratio")
    return out


def path_stats(bars: DataFrame, hold: int, block: int = 1440) -> DataFrame:
    """(symbol, minute, entry_price, exit_price, path_high, path_low) of a trade entered the minute after and held for
    `hold` minutes, the exit minute included; NULL unless every minute of the path has a bar with known prices."""
    return _paths(bars, (hold,), block).select("symbol", "minute", f"__p{hold}.*")


def paths(bars: DataFrame, holds: tuple[int, ...], block: int = 1440) -> DataFrame:
    """path_stats() of several holds from one sort of the bars, with the hold as a column hold_minutes."""
    each = [F.struct(F.lit(h).alias("hold_minutes"), f"__p{h}.*") for h in holds]
    return _paths(bars, holds, block).select("symbol", "minute", F.explode(F.array(*each)).alias("p")).select("symbol", "minute", "p.*")


def _paths(bars: DataFrame, holds: tuple[int, ...], block: int) -> DataFrame:
    """(symbol, minute, __p<hold>): a struct for each hold."""
    day = F.floor(F.col("minute") / block)
    spread = bars.select("symbol", "minute", "open", "high", "low").withColumn("__day", F.explode(F.sequence(F.floor((F.col("minute") - max(holds) - 1) / block), day)))
    w = Window.partitionBy("symbol", "__day").orderBy("minute")
    seen = ahead(spread.withColumn("known", F.col("open")), w, {"known": "min", "high": "max", "low": "min"}, tuple(h + 1 for h in holds))

    def path(hold: int) -> Column:
        n = hold + 1
        full = (F.lead("minute", n).over(w) == F.col("minute") + n) & F.lead(f"known_{n}").over(w).isNotNull()
        values = {"entry_price": F.lead("open").over(w), "exit_price": F.lead("open", n).over(w), "path_high": F.lead(f"high_{n}").over(w), "path_low": F.lead(f"low_{n}").over(w)}
        return F.struct(*[F.when(full, c).alias(name) for name, c in values.items()]).alias(f"__p{hold}")

    return seen.select("symbol", "minute", "__day", day.alias("__own"), *map(path, holds)).where("__day = __own").drop("__day", "__own")


def _taken(minutes: np.ndarray, gap: int, daily_cap: int | None) -> list[int]:
    """Places of the candidates that enter: each at least `gap` minutes after the last one that did."""
    out, at, trips = [], 0, {}
    while at < len(minutes):
        day = int(minutes[at]) // 1440
        if daily_cap is not None and trips.get(day, 0) >= daily_cap:
            at = int(np.searchsorted(minutes, (day + 1) * 1440))
            continue
        out.append(at)
        trips[day] = trips.get(day, 0) + 1
        at = max(at + 1, int(np.searchsorted(minutes, minutes[at] + gap)))
    return out


def _onward(minutes: np.ndarray, gap: int, daily_cap: int | None) -> np.ndarray:
    """For each candidate: the minute from which a trade may follow, once all trades of the block are done that begin with
    this one. The candidate is the first of its day to enter. Steps of powers of two, no loop over candidates."""
    n = len(minutes)
    then = np.searchsorted(minutes, minutes + gap)
    last, trips = np.arange(n), np.ones(n, dtype=np.int64)
    if daily_cap is not None:
        day = minutes // 1440
        for _ in range(daily_cap - 1):  # to the last entry of the day
            on = then[last]
            more = on < n
            more[more] = day[on[more]] == day[more]
            if not more.any():
                break
            last, trips = np.where(more, on, last), trips + more
    free = minutes[last] + gap
    if daily_cap is not None:
        free = np.where(trips >= daily_cap, np.maximum(free, (minutes // 1440 + 1) * 1440), free)
    jump = np.append(np.searchsorted(minutes, free), n)
    free = np.append(free, -1)
    while (jump[:n] < n).any():
        free, jump = np.where(jump < n, free[jump], free), jump[jump]
    return free[:n]


def entered(rows: DataFrame, hold: int | None, block: int, daily_cap: int | None = None, keys: tuple[str, ...] = KEYS, days: int = SPAN_DAYS) -> DataFrame:
    """The rows (keys, minute, skip_reason, entry_price, exit_price, ...) that enter a trade.

    Rows of a group are taken in order of time. A row enters if its rule says so, its path is complete, the last trade's
    exit lies `block` minutes back, and the day's cap is not reached; only an entry changes the state. So all rows but
    the candidates are gone before the one loop that is not relational, which jumps from entry to entry.

    No task holds a group. Spans of `days` days are worked on apart: each first tells, for every minute that it may
    become free at, when the next span becomes free; that depends on its first hold + block + 1 minutes only. Such
    short tables are put together along the group, and then each span runs from the minute it is known to be free at. With
    hold None, each group has its own, in a column hold_minutes. A row without a minute does not enter; of rows of one
    minute, one does. A cap below 1 lets nothing enter.
    """
    ready = rows.where(F.col("skip_reason").isNull() & F.col("entry_price").isNotNull() & F.col("exit_price").isNotNull() & F.col("minute").isNotNull())
    if daily_cap is not None and daily_cap < 1:
        return ready.limit(0)
    if hold is not None:
        days = max(days, (1 + hold + block) // 1440 + 1)
        span = F.lit(days * 1440)
    else:
        span = F.greatest(F.lit(days), F.floor((1 + F.col("hold_minutes") + block) / 1440) + 1) * 1440
    spans = ready.withColumn("__span", (F.floor(F.col("minute") / span) * span).cast("long"))
    by = [*keys, "__span"]

    def gap(pdf: pd.DataFrame) -> int:
        return 1 + block + (hold if hold is not None else int(pdf["hold_minutes"].iloc[0]))

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        minutes = np.unique(pdf["minute"].to_numpy(dtype=np.int64))
        start, g = int(pdf["__span"].iloc[0]), gap(pdf)
        n = min(len(minutes), int(np.searchsorted(minutes, start + g)) + 1)
        return pdf.iloc[:1][by].assign(__first=[minutes[:n].tolist()], __free=[_onward(minutes, g, daily_cap)[:n].tolist()])

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, free, out = pdf.sort_values("__span"), None, []
        for start, first, onward in zip(pdf["__span"], pdf["__first"], pdf["__free"]):
            free = start if free is None else max(free, start)
            out.append(free)
            at = int(np.searchsorted(first, free))
            free = onward[at] if at < len(first) else free
        return pdf[by].assign(__from=out)

    def work(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("minute", kind="stable")
        pdf = pdf[pdf["minute"] >= known["__from"].iloc[0]]
        return pdf.iloc[_taken(pdf["minute"].to_numpy(), gap(pdf), daily_cap)].drop(columns="__span") if len(pdf) else pdf.drop(columns="__span")

    kinds = spans.select(*by).schema
    told = spans.groupBy(*by).applyInPandas(tell, T.StructType([*kinds, T.StructField("__first", T.ArrayType(T.LongType())), T.StructField("__free", T.ArrayType(T.LongType()))]))
    starts = told.groupBy(*keys).applyInPandas(along, T.StructType([*kinds, T.StructField("__from", T.LongType())]))
    # the spans' rows are shuffled alike for both uses, so that Spark shuffles them once
    return spans.groupBy(*by).cogroup(starts.groupBy(*by)).applyInPandas(work, ready.schema)


def fixed_hold(rows: DataFrame, hold: int, block: int, daily_cap: int | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """rows (keys, minute, skip_reason, entry_price, exit_price, ...) with decision: entered, or the first thing against
    it of cooldown, the rule's reason, daily_cap and missing_price_path.

    Who enters comes from entered(). The other rows find the trade that keeps them out by the days that it reaches
    into: an equi-join, as trades of a group do not overlap.
    """
    gap = 1 + hold + block
    trades = entered(rows, hold, block, daily_cap, keys).select(*keys, F.col("minute").alias("__entry"))
    day = lambda c: F.floor(c / 1440)
    reach = F.sequence(day(F.col("__entry")), day(F.col("__entry") + gap - 1))
    spans = trades.select(*keys, "__entry", F.explode(reach).alias("__day"))
    marked = rows.withColumn("__day", day(F.col("minute")))
    names = [*keys, "__day"]
    inside = marked.select(*names, "minute").join(spans, names).where((F.col("minute") >= F.col("__entry")) & (F.col("minute") < F.col("__entry") + gap))
    state = inside.select(*keys, "minute", F.when(F.col("minute") == F.col("__entry"), "entered").otherwise("cooldown").alias("__state"))
    out = rows.join(state, [*keys, "minute"], "left")
    capped = F.lit(False)
    if daily_cap is not None:
        full = trades.groupBy(*keys, day(F.col("__entry")).alias("__day")).agg(F.sort_array(F.collect_list("__entry")).alias("__e"))
        full = full.where(F.size("__e") >= daily_cap).select(*names, F.element_at("__e", daily_cap).alias("__full"))
        out = out.withColumn("__day", day(F.col("minute"))).join(full, names, "left")
        capped = F.col("minute") > F.coalesce("__full", F.col("minute"))
    missing = F.col("entry_price").isNull() | F.col("exit_price").isNull()
    decision = F.coalesce("__state", "skip_reason", F.when(capped, "daily_cap"), F.when(missing, "missing_price_path"))
    return out.withColumn("decision", decision).select(*rows.columns, "decision")


def skip_counts(decided: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, decision, rows): how many rows entered, and why the others did not."""
    return decided.groupBy(*keys, "decision").agg(F.count(F.lit(1)).alias("rows"))


def total_skipped(counts: DataFrame) -> DataFrame:
    """(decision, rows) over all runs: the union of their reasons, added up."""
    return counts.groupBy("decision").agg(F.sum("rows").alias("rows"))


def fixed_hold_episodes(trades: DataFrame, hold: int | None, side: str = "long", cost: float = 15.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Returns and excursions, in basis points, of the rows of entered(); with hold None, each has its own in a
    column hold_minutes."""
    s = side_sign(side)
    p, x = F.col("entry_price"), F.col("exit_price")
    gross = s * log_bps(x, p)
    up, down = log_bps(F.col("path_high"), p), log_bps(F.col("path_low"), p)
    best, worst = (up, down) if s > 0 else (-down, -up)
    entry = F.col("minute")
    held = F.lit(hold) if hold is not None else F.col("hold_minutes")
    name = F.concat(F.lit(f"fixed_{side}_H"), held.cast("string"), F.lit("_"), F.date_format(F.timestamp_seconds(entry * 60), "yyyyMMdd'T'HHmmss'Z'"))
    return trades.select(
        *keys, name.alias("episode_id"), F.lit(side).alias("side"), entry.alias("entry_minute"), (entry + 1).alias("entry_exec_minute"),
        (entry + 1 + held).alias("exit_exec_minute"), F.lit("fixed_hold").alias("exit_reason"), F.col("score").alias("entry_score"), held.alias("hold_minutes"),
        F.lit(float(cost)).alias("roundtrip_cost_bps"), p.alias("entry_price"), x.alias("exit_price"), gross.alias("gross_pl_bps"), (gross - cost).alias("net_pl_bps"),
        best.alias("mfe_bps"), worst.alias("mae_bps"), (best - gross).alias("giveback_bps"),
    )


def exit_positions(
    bars: DataFrame, entries: DataFrame, scores: DataFrame, interval: int, max_hold: int, lookahead: int, side: str = "long", features: DataFrame | None = None
) -> DataFrame:
    """Position states: each entry (symbol, fold, minute, score) at each decision age, with the price path so far.

    A state asks for six rows: the bars that it is entered at, stands at, would leave at now and later, and two runs of
    2**k minutes that cover its path (series.extremes). Bars and runs are one table of facts by minute and level, so that
    one join and one aggregate answer all states, however long the paths. A state is there only if every minute of its
    path has a bar with known prices, and both exits have one. features (symbol, minute, ...) are those of the market at
    the current minute; states without them go, see states_without().
    """
    s, every = side_sign(side), list(range(interval, max_hold + 1, interval))
    entry, age, level = F.col("entry_minute"), F.col("age_minutes"), (F.length(F.bin(F.col("age_minutes"))) - 1).alias("level")
    states = entries.select(*KEYS, F.col("minute").alias("entry_minute"), F.col("score").alias("entry_score"), F.explode(F.lit(every)).alias("age_minutes"))
    plain = F.lit(-1)  # the level of bars themselves
    asks = [
        (entry + 1, plain), (entry + age, plain), (entry + age + 1, plain), (entry + age + 1 + lookahead, plain),
        (entry + 1, level), (entry + age + 1 - F.expr("shiftleft(1, length(bin(age_minutes)) - 1)"), level),
    ]
    asks = F.explode(F.array(*[F.struct(F.lit(i).alias("ask"), m.cast("long").alias("minute"), k.cast("int").alias("level")) for i, (m, k) in enumerate(asks)]))
    asked = states.select(*KEYS, "entry_minute", "entry_score", "age_minutes", asks.alias("a")).select("*", "a.*").drop("a")
    levels = tuple(sorted({n.bit_length() - 1 for n in every}))
    none = F.lit(None).cast("double")
    facts = bars.select("symbol", "minute", plain.alias("level"), "open", "close", none.alias("high"), none.alias("low"))
    facts = facts.unionByName(extremes(bars, levels).select("symbol", "minute", "level", none.alias("open"), none.alias("close"), "high", "low"))
    pick = lambda i, c: F.max(F.when(F.col("ask") == i, F.col(c)))
    seen = asked.join(facts, ["symbol", "minute", "level"]).groupBy(*KEYS, "entry_minute", "entry_score", "age_minutes").agg(
        F.count_distinct("ask").alias("__n"), pick(0, "open").alias("entry_price"), pick(1, "close").alias("current_close"), pick(2, "open").alias("exit_now"),
        pick(3, "open").alias("exit_later"), F.max("high").alias("path_high"), F.min("low").alias("path_low"),
    )
    seen = seen.where("__n = 6").withColumn("current_minute", entry + age)
    at = ["symbol", "current_minute"]
    score = scores.select("symbol", F.col("minute").alias("current_minute"), F.col("score").alias("current_score"))
    out = seen.join(score, at, "left")
    bps = lambda a, b: s * log_bps(a, b)
    p = F.col("entry_price")
    best, worst = ("path_high", "path_low") if s > 0 else ("path_low", "path_high")
    out = out.select(
        *KEYS, F.lit(side).alias("side"), F.concat_ws("_", "symbol", "fold", F.lit(side), "entry_minute").alias("episode_id"), "entry_minute", "current_minute", "age_minutes",
        "entry_score", "current_score", (F.col("entry_score") - F.col("current_score")).alias("score_decay"), (F.col("current_score") / F.nullif("entry_score", F.lit(0.0))).alias("score_ratio"),
        bps(F.col("current_close"), p).alias("unrealized_pl_bps"), bps(F.col(best), p).alias("mfe_since_entry_bps"), bps(F.col(worst), p).alias("mae_since_entry_bps"),
        (bps(F.col(best), p) - bps(F.col("current_close"), p)).alias("giveback_from_mfe_bps"), bps(F.col("exit_later"), F.col("exit_now")).alias("target_exit_hold_delta_bps"),
    )
    return out if features is None else out.join(features.withColumnRenamed("minute", "current_minute"), at)


def with_market(states: DataFrame, bars: DataFrame, matrix: Callable[[DataFrame, str, Column], DataFrame]) -> DataFrame:
    """exit_positions() with the features of their minutes, as its join has them. matrix(bars, carried, only) gives
    (symbol, minute, features..., carried) of bars. States go along with their minute's bar, so that only bars and states
    are shuffled, never features, and features of other minutes are not worked out to the end."""
    own = [c for c in states.columns if c not in ("symbol", "current_minute")]
    per = states.groupBy("symbol", F.col("current_minute").alias("minute")).agg(F.collect_list(F.struct(*own)).alias("__states"))
    out = matrix(bars.join(per, ["symbol", "minute"], "left"), "__states", F.col("__states").isNotNull())
    features = [c for c in out.columns if c not in ("symbol", "minute", "__states")]
    out = out.select("symbol", F.col("minute").alias("current_minute"), F.explode("__states").alias("__state"), *features)
    return out.select("symbol", "current_minute", "__state.*", *features)


def states_without(states: DataFrame, features: DataFrame) -> DataFrame:
    """(symbol, fold, missing_market_features): states whose current minute has no features, by fold."""
    known = features.select("symbol", F.col("minute").alias("current_minute"))
    return states.join(known, ["symbol", "current_minute"], "left_anti").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("missing_market_features"))


def model_exit_episodes(entries: DataFrame, states: DataFrame, confirm: int, hard_stop_bps: float, max_hold: int, block: int, daily_cap: int | None = None) -> DataFrame:
    """Trades that a model ends. entries: (symbol, fold, minute, score, skip_reason); states: exit_positions with pred,
    the predicted gain of holding on. All entries come back, with decision.

    Within a series and fold, entries are taken in order; a trade's states are walked until the hard stop, the longest hold, or
    `confirm` predictions in a row of no gain. The walk needs no outer state: it is a native aggregate over the ordered
    states of each entry, so that the sequential pass sees one row per entry.
    """
    walk = F.array_sort(F.collect_list(F.struct("age_minutes", "pred", "mae_since_entry_bps", "unrealized_pl_bps")))
    start = F.struct(F.lit(0).alias("bad"), F.lit(None).cast("int").alias("age"), F.lit(None).cast("string").alias("why"), F.lit(None).cast("double").alias("pl"), F.lit(0).alias("last"), F.lit(None).cast("double").alias("last_pl"))

    def step(a: Column, x: Column) -> Column:
        bad = F.when(x["pred"] > 0, F.lit(0)).otherwise(a["bad"] + 1)
        why = F.when(x["mae_since_entry_bps"] <= -abs(hard_stop_bps), "hard_stop").when(x["age_minutes"] >= max_hold, "max_hold").when(bad >= confirm, "exit_signal")
        done = a["why"].isNotNull()
        return F.when(done, a).otherwise(
            F.struct(bad.alias("bad"), F.when(why.isNotNull(), x["age_minutes"]).cast("int").alias("age"), why.alias("why"), F.when(why.isNotNull(), x["unrealized_pl_bps"]).alias("pl"), x["age_minutes"].cast("int").alias("last"), x["unrealized_pl_bps"].alias("last_pl"))
        )

    ends = states.groupBy(*KEYS, "entry_minute").agg(walk.alias("walk")).withColumn("end", F.aggregate("walk", start, step))
    ends = ends.select(*KEYS, F.col("entry_minute").alias("minute"), F.coalesce("end.age", "end.last").alias("hold_minutes"), F.coalesce("end.why", F.lit("data_boundary")).alias("exit_reason"), F.coalesce("end.pl", "end.last_pl").alias("gross_pl_bps"))
    rows = entries.join(ends, [*KEYS, "minute"], "left")
    fields = _extended(rows, decision="string")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("minute", kind="stable").reset_index(drop=True)
        out, free, trips = [], -(1 << 62), {}
        for minute, rule, hold in zip(pdf["minute"], pdf["skip_reason"], pdf["hold_minutes"]):
            day = minute // 1440
            if minute < free:
                out.append("cooldown")
            elif rule is not None and rule == rule:
                out.append(rule)
            elif daily_cap is not None and trips.get(day, 0) >= daily_cap:
                out.append("daily_cap")
            elif hold != hold or hold is None:
                out.append("missing_exit_path")
            else:
                out.append("entered")
                free, trips[day] = minute + 1 + int(hold) + block, trips.get(day, 0) + 1
        return pdf.assign(decision=out)

    return rows.groupBy(*KEYS).applyInPandas(work, fields)
