"""Registered queries about runs: grids of targets, exit models, walk-forward and monthly research, sweeps, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.sqltext import num
from tidemark.operators import exits, models, moments, reports, simulate, splits
from tidemark.operators import labels as lab
from tidemark.operators import metrics as met
from tidemark.operators.families import sheet_of
from tidemark.operators.series import with_sheet
from tidemark.plans import matrix, monthly, research
from tidemark.plans.feature_sets import SETS
from tidemark.sources.tables import Work, kept
from tidemark.queries import (
    COOLDOWN, DENSE_SQL, HOLD, TREES, _EPISODE_NAMES, _EPISODE_SQL, _FOLD, _GROUP_NAMES, _METRIC_NAMES, _METRIC_SQL, _POSITION_NAMES, _QS, _RATED, _SCORED, _TOP_NAMES, _TOPS, _at, _average_rank, _candidates, _episodes, _evaluated, _ln, _r,
    _recursive, _ruled, _scored, _sim_sql, _top_sql, _two, _wrap, dense_bars, learnable, query, rounded,
)

# --- sides and horizons -----------------------------------------------------------------------------------------------
_SIDES = {"long": 1, "short": -1}
_GRID_TOPS = (0.95, 0.97, 0.99)


def _grid(spark, sf) -> DataFrame:
    """(run_id, side, horizon_minutes, symbol, minute, fold, target, score) of all sides and horizons: the score counts
    against a short trade."""
    bars, scored, _ = _scored(spark, sf)
    names = [f"target_entry_net_bps_{s}_H{h}" for s in _SIDES for h in lab.HORIZONS]
    rows = scored.where("fold IS NOT NULL").drop("target").join(lab.entry_labels(bars), ["symbol", "minute"])
    rows = kept(rows.select("symbol", "minute", "fold", "score", *names), "grid")  # read once for each look at a quantile
    long = rows.select("symbol", "minute", "fold", "score", *names).unpivot(["symbol", "minute", "fold", "score"], names, "name", "target")
    side, horizon = (F.split_part("name", F.lit("_"), F.lit(k)) for k in (5, 6))
    horizon = F.substring(horizon, 2, 9).cast("int")
    out = long.select("symbol", "minute", "fold", "target", side.alias("side"), horizon.alias("horizon_minutes"), (F.col("score") * F.when(side == "short", -1.0).otherwise(1.0)).alias("score"))
    return out.withColumn("run_id", F.concat("side", F.lit("_h"), F.col("horizon_minutes").cast("string")))


_GRID_SQL = (
    _SCORED
    + ", grid AS ("
    + " UNION ALL ".join(
        f"SELECT '{s}_h{h}' AS run_id, '{s}' AS side, {h} AS horizon_minutes, b.minute, b.fold, b.score * {k} AS score, {_ln('x1.open', f'x{h}.open', k, 15)} AS target FROM scored b LEFT JOIN bars x1 ON x1.minute = b.minute + 1 LEFT JOIN bars x{h} ON x{h}.minute = b.minute + {1 + h}"
        for s, k in _SIDES.items()
        for h in lab.HORIZONS
    )
    + ")"
)


@query(
    "agg_oof_summary",
    _wrap(
        """SELECT run_id, side, horizon_minutes, count(*) AS rows, count(DISTINCT fold) AS fold_count, avg(score) AS pred_mean_bps, quantile_cont(score, 0.95) AS pred_p95_bps, avg(target) AS target_mean_bps,
        avg(CASE WHEN target > 0 THEN 1.0 ELSE 0.0 END) AS target_gt0_rate FROM grid GROUP BY 1, 2, 3""",
        ("run_id", "side", "horizon_minutes", "rows", "fold_count"), ["pred_mean_bps", "pred_p95_bps", "target_mean_bps", "target_gt0_rate"], _GRID_SQL,
    ),
)
def _oof_summary(spark, sf):
    return rounded(reports.oof_summary(_grid(spark, sf), "target", "score"))


_RUN = ("run_id", "side", "horizon_minutes")


def _run_metrics(spark, sf) -> DataFrame:
    """Mean and worst over folds of the top quantiles' mean targets, per run."""
    per = met.prediction_metrics(_grid(spark, sf), "target", "score", _GRID_TOPS, (*_RUN, "fold"))
    aggs = [f(f"top_q{n}_avg").alias(f"{name}_top_q{n}_avg_target_bps") for n in ("95", "97", "99") for f, name in ((F.avg, "mean"), (F.min, "worst"))]
    return per.groupBy(*_RUN).agg(*aggs)


_RUN_NAMES = [f"{k}_top_q{n}_avg_target_bps" for n in ("95", "97", "99") for k in ("mean", "worst")]
_RUN_SQL = f"""{_GRID_SQL}, known AS (SELECT * FROM grid WHERE target IS NOT NULL AND score IS NOT NULL), cut AS (SELECT *, {', '.join(f"quantile_cont(score, {q}) OVER (PARTITION BY run_id, fold) AS t{met.name_of(q)}" for q in _GRID_TOPS)} FROM known),
per AS (SELECT run_id, side, horizon_minutes, fold, {', '.join(f"avg(target) FILTER (score >= t{n}) AS a{n}" for n in ("95", "97", "99"))} FROM cut GROUP BY ALL),
run AS (SELECT run_id, side, horizon_minutes, {', '.join(f"avg(a{n}) AS mean_top_q{n}_avg_target_bps, min(a{n}) AS worst_top_q{n}_avg_target_bps" for n in ("95", "97", "99"))} FROM per GROUP BY ALL)"""


@query(
    "grid_entry_compare",
    _wrap(
        f"""SELECT run.*, {' + '.join(f'{w} * run.{c}' for c, w in reports.ROBUST_WEIGHTS.items())} AS robust_score,
        {', '.join(f'run.{c} - one.{c} AS delta_vs_long_h60_{c}' for c in _RUN_NAMES)}, {', '.join(f'run.{c} - base.{c} AS delta_vs_60_{c}' for c in _RUN_NAMES)}
        FROM run CROSS JOIN (SELECT * FROM run WHERE run_id = 'long_h60') one LEFT JOIN run base ON base.side = run.side AND base.horizon_minutes = 60""",
        _RUN, [*_RUN_NAMES, "robust_score", *(f"delta_vs_long_h60_{c}" for c in _RUN_NAMES), *(f"delta_vs_60_{c}" for c in _RUN_NAMES)], _RUN_SQL,
    ),
)
def _compare(spark, sf):
    """Runs against one run, and against the shortest horizon of their side."""
    runs = kept(_run_metrics(spark, sf), "runs")  # a row for each run, which comparisons read several times
    runs = runs.withColumn("robust_score", reports.robust_score(runs.columns)).withColumn("variant", F.col("horizon_minutes").cast("string"))
    first = reports.baseline_deltas(runs, "long_h60", _RUN_NAMES, (), "run_id").drop(*[f"baseline_{c}" for c in _RUN_NAMES])
    return rounded(reports.baseline_deltas(first, "60", _RUN_NAMES, ("side",), "variant").drop("variant", *[f"baseline_{c}" for c in _RUN_NAMES]))


@query(
    "flt_focus_runs",
    _wrap("SELECT side, horizon_minutes, count(*) AS rows, avg(target) AS mean FROM grid WHERE (side = 'long' AND horizon_minutes = 120) OR (side = 'short' AND horizon_minutes = 60) GROUP BY 1, 2", ("side", "horizon_minutes", "rows"), ["mean"], _GRID_SQL),
)
def _focus(spark, sf):
    return rounded(reports.focus(_grid(spark, sf), [("long", 120), ("short", 60)]).groupBy("side", "horizon_minutes").agg(F.count(F.lit(1)).alias("rows"), F.avg("target").alias("mean")))


# --- reports ------------------------------------------------------------------------------------------------------------
_BOTTOM = ", ".join(f"avg(target) FILTER (score <= b{n}) AS bottom_q{n}_avg, count(*) FILTER (score <= b{n}) AS bottom_q{n}_count, avg(CASE WHEN target < 0 THEN 1.0 ELSE 0.0 END) FILTER (score <= b{n}) AS bottom_q{n}_precision_lt0" for n in ("95", "99"))
_EXIT_NAMES = ["target_mean", "target_median", "pred_mean", "mae", "rmse", "corr", "r2", "precision_gt0", *_TOP_NAMES, "spearman", *(f"bottom_q{n}_{x}" for n in ("95", "99") for x in ("avg", "precision_lt0")), "spread_q95", "spread_q99"]


@query(
    "agg_exit_metrics",
    _wrap(
        f"""SELECT *, top_q95_avg - bottom_q95_avg AS spread_q95, top_q99_avg - bottom_q99_avg AS spread_q99 FROM (
        SELECT fold, count(*) AS eval_count, avg(target) AS target_mean, quantile_cont(target, 0.5) AS target_median, avg(score) AS pred_mean, avg(abs(target - score)) AS mae,
        sqrt(avg((target - score) ** 2)) AS rmse, corr(target, score) AS corr, 1 - avg((target - score) ** 2) / var_pop(target) AS r2, avg(CASE WHEN target > 0 THEN 1.0 ELSE 0.0 END) AS precision_gt0,
        {', '.join(_top_sql(q) for q in _TOPS)}, {_BOTTOM}, corr(ra, rb) AS spearman
        FROM (SELECT *, {_QS}, quantile_cont(score, 0.05) OVER (PARTITION BY fold) AS b95, quantile_cont(score, 0.01) OVER (PARTITION BY fold) AS b99, {_average_rank('target')} AS ra, {_average_rank('score')} AS rb FROM evaled) GROUP BY fold)""",
        ("fold", "eval_count", "bottom_q95_count", "bottom_q99_count", *(f"top_q{met.name_of(q)}_count" for q in _TOPS)), _EXIT_NAMES,
    ),
)
def _exit_metrics(spark, sf):
    return rounded(reports.exit_fold_metrics(_evaluated(spark, sf), "target", "score").drop("symbol"))


_RATES_SQL = f"{DENSE_SQL}, f AS (WITH {_RATED.sql('bars', ('symbol', 'minute'))}), rates AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS null_rate FROM f" for c in _RATED.outs) + ")"


def _rates(spark, sf) -> DataFrame:
    return matrix.null_rates(with_sheet(dense_bars(spark, sf), sheet_of("return_path", "volatility")))


@query("topk_null_rates", f"WITH {_RATES_SQL} SELECT feature, round(null_rate, 6) + 0 AS null_rate FROM rates ORDER BY rates.null_rate DESC, feature LIMIT 20")
def _worst_rates(spark, sf):
    return rounded(reports.feature_summary(_rates(spark, sf), [matrix.FeatureSpec("x", "y", 1)])[1])


@query("agg_feature_summary", f"WITH {_RATES_SQL} SELECT count(*) AS feature_count, count(*) FILTER (null_rate > 0.5) AS over_50_count, count(*) FILTER (null_rate > 0.95) AS over_95_count FROM rates")
def _feature_counts(spark, sf):
    return reports.feature_summary(_rates(spark, sf), [matrix.FeatureSpec("x", "y", 1)])[0]


@query("topk_worst_episodes", _recursive(_wrap(f"SELECT * FROM ({_EPISODE_SQL}) ORDER BY net_pl_bps, fold, entry_minute LIMIT 20", ("fold", "episode_id", "entry_minute", "exit_exec_minute"), _EPISODE_NAMES, _SCORED + ", " + _sim_sql(20.0, "a"))))
def _worst(spark, sf):
    return rounded(reports.worst_episodes(_episodes(spark, sf)).select("fold", "episode_id", "entry_minute", "exit_exec_minute", *_EPISODE_NAMES))


@query(
    "agg_skips_total",
    _recursive(f"""WITH {_SCORED}, {_sim_sql(20.0, 'a')} SELECT decision, CAST(count(*) AS BIGINT) AS rows FROM (SELECT CASE WHEN k.minute = s.minute THEN 'entered' WHEN k.minute IS NOT NULL THEN 'cooldown'
      WHEN s.score IS NULL OR NOT s.score > 20 THEN 'below_threshold' ELSE 'missing_price_path' END AS decision FROM scored s
      LEFT JOIN pick_a k ON k.fold = s.fold AND s.minute >= k.minute AND s.minute < k.minute + {1 + HOLD + COOLDOWN}) GROUP BY decision"""),
)
def _skips_total(spark, sf):
    return simulate.total_skipped(simulate.skip_counts(simulate.fixed_hold(_ruled(spark, sf), HOLD, COOLDOWN)))


@query("rank_episode_sets", _recursive(_wrap(
    f"""SELECT 'thr_20' AS run, avg(avg_net_pl_bps) AS mean_avg, min(avg_net_pl_bps) AS worst_avg, avg(profit_factor) AS mean_factor,
    coalesce(avg(avg_net_pl_bps), 0) + 0.5 * coalesce(min(avg_net_pl_bps), 0) + 0.5 * least(coalesce(avg(profit_factor), 0), 3) AS episode_score FROM ({_METRIC_SQL})""",
    ("run",), ["mean_avg", "worst_avg", "mean_factor", "episode_score"], _SCORED + ", " + _sim_sql(20.0, "a"))))
def _ranked(spark, sf):
    m = met.episode_metrics(_episodes(spark, sf), _evaluated(spark, sf)).groupBy(F.lit("thr_20").alias("run")).agg(F.avg("avg_net_pl_bps").alias("mean_avg"), F.min("avg_net_pl_bps").alias("worst_avg"), F.avg("profit_factor").alias("mean_factor"))
    return rounded(m.withColumn("episode_score", reports.episode_score(F.col("mean_avg"), F.col("worst_avg"), F.col("mean_factor"))))


@query("agg_fold_summary", _recursive(_wrap(
    f"SELECT 1 AS one, {', '.join(f'avg({c}) AS mean_{c}, min({c}) AS worst_{c}' for c in ('episode_count', *_METRIC_NAMES))} FROM ({_METRIC_SQL})",
    ("one",), [f"{k}_{c}" for c in ("episode_count", *_METRIC_NAMES) for k in ("mean", "worst")], _SCORED + ", " + _sim_sql(20.0, "a"))))
def _fold_summary(spark, sf):
    m = met.episode_metrics(_episodes(spark, sf), _evaluated(spark, sf)).select(F.col("episode_count").cast("double").alias("episode_count"), *_METRIC_NAMES)
    return rounded(met.summarized(m).withColumn("one", F.lit(1)))


# --- comparisons of policies ----------------------------------------------------------------------------------------------
_PICKED = "picked AS (SELECT CASE WHEN CAST(cycle_id AS INTEGER) % 2 = 0 THEN 'even' ELSE 'odd' END AS run, cycle_id, arg_max(policy, robust_score) AS policy, max(robust_score) AS robust_score FROM candidates GROUP BY cycle_id)"


def _picked(spark, sf) -> DataFrame:
    run = F.when(F.col("cycle_id").cast("int") % 2 == 0, "even").otherwise("odd")
    return research.chosen(_candidates(spark, sf)).withColumn("run", run)


@query("agg_selected_policies", _two(f", {_PICKED} SELECT run, policy, count(*) AS cycle_count, round(avg(robust_score), 5) + 0 AS mean_robust_score FROM picked GROUP BY run, policy"))
def _selected(spark, sf):
    return rounded(reports.selected_policies(_picked(spark, sf), ["robust_score"]), 5)


@query(
    "agg_run_comparison",
    _two(f", {_PICKED} SELECT run, round(sum(robust_score), 5) + 0 AS sum, round(avg(robust_score), 5) + 0 AS mean, round(min(robust_score), 5) + 0 AS min, (SELECT string_agg(policy || '=' || n, ',' ORDER BY policy) FROM (SELECT policy, count(*) AS n FROM picked q WHERE q.run = p.run GROUP BY policy)) AS policies FROM picked p GROUP BY run"),
)
def _run_comparison(spark, sf):
    out = reports.run_comparison(_picked(spark, sf), "robust_score")
    entries = F.transform(F.map_entries("policies"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return rounded(out.withColumn("policies", F.array_join(entries, ",")), 5)


_SUMMED = ("selector_total_net_pl_bps", "selector_worst_fold_net_pl_bps", "robust_score")


@query("agg_column_summary", _two(" UNION ALL ".join(f"SELECT cycle_id, '{c}' AS \"column\", round(sum({c}) + 7e-4, 2) + 0 AS sum, round(avg({c}) + 7e-4, 2) + 0 AS mean, round(min({c}) + 7e-4, 2) + 0 AS min, round(max({c}) + 7e-4, 2) + 0 AS max FROM candidates GROUP BY cycle_id" for c in _SUMMED)))
def _column_summary(spark, sf):
    return rounded(reports.column_summary(_candidates(spark, sf), list(_SUMMED), ("cycle_id",)), 5, 7e-4)


@query("join_replay_sources", _two("SELECT DISTINCT c.cycle_id, s.source, c.policy, s.source || '::' || c.policy AS replay_key FROM candidates c JOIN (SELECT DISTINCT strftime(o_orderdate, '%Y') AS cycle_id, o_orderstatus AS source FROM orders) s ON s.cycle_id = c.cycle_id"))
def _replay_sources(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return monthly.replay_sources(_candidates(spark, sf), o.select(F.date_format("o_orderdate", "yyyy").alias("cycle_id"), F.col("o_orderstatus").alias("source")).distinct())


# --- sweeps -----------------------------------------------------------------------------------------------------------------
_WINDOWS, _QUANTILES, _FLOORS = (360, 720), (0.9, 0.95), (0.0, 20.0, 40.0)


def _thresholds_sql() -> str:
    parts = []
    for w in _WINDOWS:
        frame = f"OVER (PARTITION BY fold ORDER BY minute RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        for q in _QUANTILES:
            parts.append(f"SELECT 'w{w}_q{q:g}' AS params, fold, minute, score, CASE WHEN count(score) {frame} >= {w // 2} THEN quantile_cont(score, {q}) {frame} END AS t FROM scored")
    return " UNION ALL ".join(parts)


_SWEPT = f"""{_SCORED}, floors AS (SELECT unnest([{', '.join(num(f) for f in _FLOORS)}]) AS f), thrs AS ({_thresholds_sql()}),
  tagged AS (SELECT params || '_f' || CAST(CAST(f AS INTEGER) AS VARCHAR) || '|' || fold AS fold, minute, score, greatest(t, f) AS thr FROM thrs, floors WHERE t IS NOT NULL),
  every_fold AS (SELECT DISTINCT params || '_f' || CAST(CAST(f AS INTEGER) AS VARCHAR) || '|' || fold AS fold FROM thrs, floors), {_sim_sql("s.thr", "a", "tagged")}"""


@query("sweep_rolling_windows", _recursive(_wrap("SELECT split_part(fold, '|', 1) AS params, split_part(fold, '|', 2) AS fold, * EXCLUDE (fold) FROM (" + _METRIC_SQL.replace("(SELECT DISTINCT fold FROM scored)", "every_fold") + ")", ("params", "fold", "episode_count"), _METRIC_NAMES, _SWEPT)))
def _rolling_sweep(spark, sf):
    bars, scored, _ = _scored(spark, sf)
    out = research.rolling_sweep(scored.where("fold IS NOT NULL"), simulate.path_stats(bars, HOLD), _WINDOWS, _QUANTILES, _FLOORS, research.least_history, HOLD, COOLDOWN)
    return rounded(out.select("params", "fold", "episode_count", *_METRIC_NAMES))


_POLICIES = ((0.0, 20.0, 40.0), (30, 60), (None, 30.0), (None, 10.0), (None, 1.5))


def _policies_sql() -> str:
    values = [", ".join("NULL" if v is None else num(v) for v in axis) for axis in _POLICIES]
    text = lambda tag, c: f"coalesce('_{tag}' || regexp_replace(CAST({c} AS VARCHAR), '[.]0$', ''), '')"
    name = "'t' || regexp_replace(CAST(thr AS VARCHAR), '[.]0$', '') || '_h' || CAST(hold AS VARCHAR) || " + " || ".join(text(t, c) for t, c in (("s", "ms"), ("m", "mm"), ("r", "mr")))
    axes = [f"(SELECT unnest([{v}]) AS {c})" for v, c in zip(values, ("thr", "hold", "ms", "mm", "mr"))]
    axes = [a.replace("unnest([", "CAST(unnest([").replace("])", f"]) AS {'INTEGER' if c == 'hold' else 'DOUBLE'})") for a, c in zip(axes, ("thr", "hold", "ms", "mm", "mr"))]
    parts = [f"{_SCORED}, grid AS (SELECT *, {name} AS params FROM {', '.join(axes)})"]
    for h in _POLICIES[1]:
        lets = "(ms IS NULL OR score >= ms) AND (mm IS NULL OR score - thr >= mm) AND (mr IS NULL OR (thr > 0 AND score / thr >= mr))"
        parts.append(f"tagged_{h} AS (SELECT params || '|' || fold AS fold, minute, score, thr FROM scored, grid WHERE hold = {h} AND score > thr AND {lets})")
        parts.append(f"every_{h} AS (SELECT DISTINCT params || '|' || fold AS fold FROM scored, grid WHERE hold = {h})")
        parts.append(_sim_sql("s.thr", f"h{h}", f"tagged_{h}", h))
    return ", ".join(parts)


def _policy_metrics_sql() -> str:
    of = lambda h: _METRIC_SQL.replace("(SELECT DISTINCT fold FROM scored)", f"every_{h}").replace("eps_a", f"eps_h{h}").replace(f"{HOLD}e0", f"{h}e0")
    return "SELECT split_part(fold, '|', 1) AS params, split_part(fold, '|', 2) AS fold, * EXCLUDE (fold) FROM (" + " UNION ALL ".join(map(of, _POLICIES[1])) + ")"


@query("sweep_score_filters", _recursive(_wrap(_policy_metrics_sql(), ("params", "fold", "episode_count"), _METRIC_NAMES, _policies_sql())))
def _policy_sweep(spark, sf):
    """Thresholds, holds, least scores, margins and ratios, all together."""
    bars, scored, _ = _scored(spark, sf)
    out = research.policy_sweep(scored.where("fold IS NOT NULL"), bars, research.policy_grid(spark, *_POLICIES), COOLDOWN)
    return rounded(out.select("params", "fold", "episode_count", *_METRIC_NAMES))


# --- exit models ------------------------------------------------------------------------------------------------------------
@query(
    "flt_entry_candidates",
    _wrap("SELECT fold, minute, score FROM (SELECT *, quantile_cont(score, 0.8) OVER (PARTITION BY fold) AS q FROM scored WHERE score > 20 AND minute % 5 = 0) WHERE score >= q", ("fold", "minute"), ["score"]),
)
def _entry_candidates(spark, sf):
    return rounded(exits.candidates(_evaluated(spark, sf), 5, 20.0, 0.8).select("fold", "minute", "score"))


_SHORT_SQL = """SELECT s.fold, s.minute AS entry_minute, s.minute + a.age AS current_minute, a.age AS age_minutes, s.score AS entry_score, c.score AS current_score, s.score - c.score AS score_decay,
        -ln(n.close / e.open) * 1e4 AS unrealized_pl_bps, -ln(h.down / e.open) * 1e4 AS mfe_since_entry_bps, -ln(h.up / e.open) * 1e4 AS mae_since_entry_bps,
        -ln(h.down / e.open) * 1e4 + ln(n.close / e.open) * 1e4 AS giveback_from_mfe_bps, -ln(l.open / x.open) * 1e4 AS target_exit_hold_delta_bps
        FROM scored s CROSS JOIN (SELECT unnest(range(5, 31, 5)) AS age) a JOIN bars e ON e.minute = s.minute + 1 JOIN bars n ON n.minute = s.minute + a.age JOIN bars x ON x.minute = s.minute + a.age + 1
        JOIN bars l ON l.minute = s.minute + a.age + 16 LEFT JOIN everyone c ON c.minute = s.minute + a.age
        JOIN LATERAL (SELECT max(high) AS up, min(low) AS down FROM bars b WHERE b.minute BETWEEN s.minute + 1 AND s.minute + a.age) h ON true WHERE s.score > 60 AND s.minute % 5 = 0"""


def _short_states(spark, sf) -> DataFrame:
    bars, scored, _ = _scored(spark, sf)
    return simulate.exit_positions(bars, exits.candidates(scored, 5, 60.0), scored, 5, 30, 15, "short")


@query("ds_exit_positions_short", _wrap(_SHORT_SQL, ("fold", "entry_minute", "current_minute", "age_minutes"), _POSITION_NAMES))
def _exit_short(spark, sf):
    out = _short_states(spark, sf)
    return rounded(out.select("fold", "entry_minute", "current_minute", F.col("age_minutes").cast("long").alias("age_minutes"), *_POSITION_NAMES))


@query(
    "split_exit_rows",
    f"""WITH {_SCORED}, states AS (SELECT * FROM ({_SHORT_SQL}) WHERE target_exit_hold_delta_bps IS NOT NULL), f AS (SELECT DISTINCT fold FROM states)
    SELECT f.fold, (SELECT count(*) FROM states s WHERE s.fold <> f.fold) AS train_rows, (SELECT count(DISTINCT (fold, entry_minute)) FROM states s WHERE s.fold <> f.fold) AS train_episodes,
    (SELECT count(*) FROM states s WHERE s.fold = f.fold) AS eval_rows, (SELECT count(DISTINCT entry_minute) FROM states s WHERE s.fold = f.fold) AS eval_episodes, CAST(0 AS BIGINT) AS shared_episodes FROM f""",
)
def _exit_rows(spark, sf):
    """What each fold's exit model learns from and is judged on; no trade is on both sides."""
    states, out = _short_states(spark, sf), None
    for fold in (f"fold_{k + 1:02d}" for k in range(5)):
        train, own = exits.fold_rows(states, fold)
        both = train.select("episode_id").intersect(own.select("episode_id"))
        counts = lambda df, n: df.agg(F.count(F.lit(1)).alias(f"{n}_rows"), F.count_distinct("episode_id").alias(f"{n}_episodes"))
        row = counts(train, "train").crossJoin(counts(own, "eval")).crossJoin(both.agg(F.count(F.lit(1)).alias("shared_episodes"))).withColumn("fold", F.lit(fold)).where("eval_rows > 0")
        out = row if out is None else out.unionByName(row)
    return out


@query("ml_exit_oof")
def _exit_oof(spark, sf):
    """Cross-fitted predictions of holding on, by trees over position, score and all market features of the set v1, and
    the trades that they end."""
    with Work(spark, "exit_oof") as work:
        market = lambda bars, carried, only: matrix.build(bars, SETS["v1"], (carried,), only)
        states = work.write(simulate.with_market(work.write(_short_states(spark, sf)), dense_bars(spark, sf), market), distinct=True)
        walked = ["symbol", "fold", "entry_minute", "age_minutes", "mae_since_entry_bps", "unrealized_pl_bps"]
        predicted, _ = exits.cross_fit(states, "v2_score_position", keep=walked, **TREES)
        entries = exits.candidates(_evaluated(spark, sf), 5, 60.0).select("symbol", "fold", "minute", "score", F.lit(None).cast("string").alias("skip_reason"))
        return kept(simulate.model_exit_episodes(entries, predicted, 2, 50.0, 30, COOLDOWN), "exit_oof")


# --- walk-forward and monthly research ----------------------------------------------------------------------------------------
@query("ml_walk_forward")
def _walk_forward(spark, sf):
    """Predictions of trees over all features of the set v1, learned from three folds' length of rows before each fold,
    traded under thresholds from their own score history."""
    with Work(spark, "walk_forward") as work:
        bars, df, m = learnable(spark, sf, SETS["v1"], work)
        window = 3 * (m.folds[0].end - m.folds[0].start + 1)
        predicted, past = models.walk_forward(df, models.feature_columns(df, ("minute", "target")), "target", m, 60, "rolling", window, 1440, **TREES)
        predicted, past = work.write(predicted.withColumnRenamed("pred", "score")), work.write(past)
        return kept(research.replay(predicted, past, simulate.path_stats(bars, HOLD), 0.95, 0.0, 100, HOLD, COOLDOWN), "walk_forward")


def _monthly_parts(spark, sf):
    bars = dense_bars(spark, sf)
    n = bars.agg(F.max("minute")).first()[0] + 1
    return bars, monthly.periods(0, n // 6, 6), n // 6


@query(
    "proto_monthly_rows",
    f"""WITH {DENSE_SQL}, n AS (SELECT (max(minute) + 1) // 6 AS len FROM bars), seg AS (SELECT 'test_0' || k AS cycle_id, CASE WHEN j = 0 THEN 'test' ELSE 'valid' END AS role, CASE WHEN j = 0 THEN 'test' ELSE 'valid_m0' || (4 - j) END AS name,
      (k - j) * len AS a, (k - j + 1) * len AS z, len FROM n, (SELECT unnest([4, 5]) AS k), (SELECT unnest([0, 1, 2, 3]) AS j))
    SELECT cycle_id, role, name, count(*) FILTER (minute >= a - len AND minute < a AND minute + 61 < a) AS train_rows, count(*) FILTER (minute >= a AND minute < z) AS eval_rows,
    count(*) FILTER (minute >= a - 500 AND minute < a) AS history_rows FROM seg, bars GROUP BY 1, 2, 3""",
)
def _monthly_rows(spark, sf):
    """Rows of each segment's training, evaluation and history."""
    bars, segments, length = _monthly_parts(spark, sf)
    minute = F.col("minute")
    tags = [
        F.struct(F.lit(s.cycle_id).alias("cycle_id"), F.lit(s.role).alias("role"), F.lit(s.name).alias("name"), monthly.train_mask(minute, s, length, 60).alias("t"), monthly.eval_mask(minute, s).alias("e"), monthly.history_mask(minute, s, 500, length, 60).alias("h"))
        for s in segments
    ]
    rows = bars.select(F.explode(F.array(*tags)).alias("x")).select("x.*")
    return rows.groupBy("cycle_id", "role", "name").agg(F.count_if("t").alias("train_rows"), F.count_if("e").alias("eval_rows"), F.count_if("h").alias("history_rows"))


def _month_bars(spark, sf) -> tuple[DataFrame, int]:
    """(bars, months): the dense series dealt out to calendar months from 2024-01 on, at the beginning of each; 8 months,
    or so many that a month's bars fit in it."""
    bars = dense_bars(spark, sf)
    n = bars.agg(F.max("minute")).first()[0] + 1
    months = max(8, n // 40_000 + 1)
    length = -(-n // months)
    month = F.floor(F.col("minute") / length).cast("int")
    start = F.unix_timestamp(F.add_months(F.lit("2024-01-01").cast("date"), month).cast("timestamp")) / 60
    bars = bars.withColumn("minute", (start + F.col("minute") % length).cast("long"))
    return bars.withColumn("ts", F.timestamp_seconds(F.col("minute") * 60)), months


def _month_segments(spark, months: int) -> list[monthly.Segment]:
    last = f"{2024 + (months - 1) // 12}-{(months - 1) % 12 + 1:02d}"
    return monthly.segments_of(research.cycles(spark, "2024-05", last))


_MONTH = 31 * 1440


@query("proto_monthly")
def _monthly_research(spark, sf):
    """Research over calendar months: the full set v1 and the set without each of its families, judged on the three
    months before each test month; then the set without all families that are better left out, and with each of them
    added back; the chosen ones' results in the test months. All fits come from one scan of the matrix."""
    bars, months = _month_bars(spark, sf)
    families = {f: list(sheet_of(f).outs) for f in SETS["v1"]}
    target = lab.entry_labels(bars, (60,)).select("symbol", "minute", F.col("target_entry_net_bps_long_H60").alias("target"))
    with Work(spark, "monthly") as work:
        df = work.write(matrix.build(models.labelled(bars, target, "target"), SETS["v1"], ("target",)), distinct=True)
        paths = work.write(simulate.path_stats(bars, HOLD))
        _, _, tested = monthly.linear_research(df, families, "target", _month_segments(spark, months), paths, work, _MONTH, 60, 0.9, 0.0, 50, HOLD, COOLDOWN, min_count=1, min_active=1)
        return kept(tested, "monthly")


_FIT_PARTS = {"fast": "ret_15m_bps", "slow": "ret_60m_bps"}
_FITS_SQL = f"""WITH {DENSE_SQL}, n AS (SELECT max(minute) + 1 AS n FROM bars), d AS (SELECT greatest(8, n // 40000 + 1) AS months, n FROM n),
len AS (SELECT months, CAST(ceil(n * 1e0 / months) AS BIGINT) AS len FROM d),
first AS (SELECT k, CAST(epoch(CAST(DATE '2024-01-01' + to_months(CAST(k AS INTEGER)) AS TIMESTAMP)) AS BIGINT) // 60 AS start FROM (SELECT unnest(range(0, months)) AS k FROM len)),
moved AS (SELECT f.start + b.minute % len AS minute, b.open, b.close, lag(close, 15) OVER (ORDER BY b.minute) AS c15, lag(close, 60) OVER (ORDER BY b.minute) AS c60 FROM bars b, len JOIN first f ON f.k = b.minute // len),
rows AS (SELECT b.minute, coalesce({_ln('b.c15', 'b.close')}, 0) AS a, coalesce({_ln('b.c60', 'b.close')}, 0) AS b, {_ln('x1.open', 'x61.open', 1, 15)} AS y FROM moved b LEFT JOIN moved x1 ON x1.minute = b.minute + 1 LEFT JOIN moved x61 ON x61.minute = b.minute + 61),
stat AS (SELECT k, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, sqrt(avg(a * a) - avg(a) * avg(a)) AS sa, sqrt(avg(b * b) - avg(b) * avg(b)) AS sb, avg(a * b) - avg(a) * avg(b) AS cab, avg(a * y) - avg(a) * avg(y) AS cay, avg(b * y) - avg(b) * avg(y) AS cby
  FROM first JOIN rows ON minute >= start - {_MONTH} AND minute < start AND minute + 61 < start WHERE k >= 1 AND y IS NOT NULL GROUP BY k),
z AS (SELECT *, cab / (sa * sb) AS r, cay / sa AS p, cby / sb AS q, 1.001e0 AS one FROM stat),
w AS (SELECT k, 'all_full' AS policy, (one * p - r * q) / (one * one - r * r) / sa AS w_fast, (one * q - r * p) / (one * one - r * r) / sb AS w_slow, ma, mb, my FROM z
  UNION ALL SELECT k, 'all_minus_slow', p / one / sa, 0e0, ma, mb, my FROM z UNION ALL SELECT k, 'all_minus_fast', 0e0, q / one / sb, ma, mb, my FROM z)
SELECT strftime(DATE '2024-01-01' + to_months(CAST(k AS INTEGER)), '%Y-%m') AS month, policy, {_r('intercept', 'w_fast', 'w_slow')} FROM (SELECT *, my - w_fast * ma - w_slow * mb AS intercept FROM w)"""


@query("proto_monthly_fits", _FITS_SQL)
def _monthly_fits(spark, sf):
    """The models of each month by policy, from one scan."""
    bars, months = _month_bars(spark, sf)
    target = lab.entry_labels(bars, (60,)).select("symbol", "minute", F.col("target_entry_net_bps_long_H60").alias("target"))
    df = with_sheet(bars, sheet_of("return_path")).join(target, ["symbol", "minute"])
    units = monthly.units_of(_month_segments(spark, months), _MONTH, 60, -1)
    wanted = monthly.policies({n: [c] for n, c in _FIT_PARTS.items()})
    with Work(spark, "fits") as work:
        sums = moments.gather(df, list(_FIT_PARTS.values()), "target", [u.train for u in units.values()], work)
        fits = sums.fit({u.name: (u.train, wanted) for u in units.values()})
        start = F.timestamp_seconds(F.split_part("name", F.lit("_"), F.lit(1)).cast("long") * 60)
        weights = [F.col("weights")[k].alias(f"w_{n}") for k, n in enumerate(_FIT_PARTS)]
        return kept(rounded(fits.select(F.date_format(start, "yyyy-MM").alias("month"), "policy", "intercept", *weights)), "fits")


@query(
    "join_split_rows",
    f"""WITH {DENSE_SQL}, f AS ({' UNION ALL '.join(f"SELECT 'fold_{k + 1:02d}' AS fold, {_at(4 + k)} AS start, {_at(5 + k)} - 1 AS z" for k in range(5))})
    SELECT f.fold, count(*) FILTER (b.minute < {_at(4)} AND NOT (b.minute <= z AND b.minute + 121 >= f.start)) AS train_rows, count(*) FILTER (b.minute BETWEEN f.start AND z) AS eval_rows FROM f, bars b GROUP BY f.fold""",
)
def _split_rows(spark, sf):
    bars, _, m = _scored(spark, sf)
    return reports.split_rows(splits.roles(bars.select("minute"), m, 120), splits.fold_table(spark, m).select("fold"))
