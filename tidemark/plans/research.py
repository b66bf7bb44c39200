"""Monthly rolling research: cycles, policy selection, family ablation, sweeps, replays."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.metrics import episode_metrics
from tidemark.operators.simulate import KEYS, entered, entry_rule, fixed_hold_episodes, history_threshold, paths, rolling_quantile

FAIL_PENALTY = 1_000_000.0
#: Rows of a grid or of folds that are broadcast.
FEW = 10_000


def cycles(spark: SparkSession, first: str, last: str, valid_months: int = 3, test_months: int = 1, step: int = 1) -> DataFrame:
    """(cycle_id, role, name, start_month, end_month): a test month and the validation months before it; end exclusive."""
    tests = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(f"{first}-01")), F.to_date(F.lit(f"{last}-01")), F.make_ym_interval(F.lit(0), F.lit(step)))).alias("test"))
    k = F.explode(F.sequence(F.lit(0), F.lit(valid_months)))
    rows = tests.withColumn("k", k)
    start = F.add_months("test", -F.col("k"))
    months = F.when(F.col("k") == 0, test_months).otherwise(1)
    return rows.select(
        F.concat(F.lit("test_"), F.date_format("test", "yyyyMM")).alias("cycle_id"),
        F.when(F.col("k") == 0, "test").otherwise("valid").alias("role"),
        F.when(F.col("k") == 0, "test").otherwise(F.format_string("valid_m%02d", F.lit(valid_months) - F.col("k") + 1)).alias("name"),
        start.alias("start_month"), F.add_months(start, months).alias("end_month"),
    )


def selector(fold_metrics: DataFrame, keys: tuple[str, ...] = ("cycle_id", "policy"), min_count: int = 10, min_active: int = 2, worst_loss: float | None = None, worst_weight: float = 0.5, median_weight: float = 0.25) -> DataFrame:
    """Per policy: total, worst and median fold result, the score of the three, and what it fails, at a penalty each."""
    net, n = F.coalesce("net_pl_bps_sum", F.lit(0.0)), F.coalesce("episode_count", F.lit(0))
    out = fold_metrics.groupBy(*keys).agg(
        F.sum(net).alias("selector_total_net_pl_bps"), F.min(net).alias("selector_worst_fold_net_pl_bps"), F.percentile(net, 0.5).alias("selector_median_fold_net_pl_bps"),
        F.sum(n).alias("selector_total_episode_count"), F.count_if(n > 0).alias("selector_active_fold_count"),
    )
    failed = [F.when(F.col("selector_total_episode_count") < min_count, "min_total_episode_count"), F.when(F.col("selector_active_fold_count") < min_active, "min_active_fold_count")]
    if worst_loss is not None:
        failed.append(F.when(F.col("selector_worst_fold_net_pl_bps") < worst_loss, "max_worst_fold_loss_bps"))
    names = F.array_compact(F.array(*failed))
    raw = F.col("selector_total_net_pl_bps") + worst_weight * F.col("selector_worst_fold_net_pl_bps") + median_weight * F.col("selector_median_fold_net_pl_bps")
    out = out.withColumn("selector_failed_constraints", F.array_join(names, ",")).withColumn("selector_raw_score", raw)
    return out.withColumn("robust_score", raw - FAIL_PENALTY * F.size(names))


def chosen(candidates: DataFrame, order: str = "policy_index", score: str = "robust_score") -> DataFrame:
    """Per cycle the policy of the highest score; the first in configured order wins ties."""
    best = F.max_by("policy", F.struct(F.col(score), -F.col(order)))
    return candidates.groupBy("cycle_id").agg(best.alias("policy"), F.max(score).alias(score))


def ablation_deltas(candidates: DataFrame, score: str = "robust_score") -> DataFrame:
    """Each policy that drops a family against the full one of its cycle: (cycle_id, policy, family, delta)."""
    full = candidates.where(F.col("policy").endswith("_full")).groupBy("cycle_id").agg(F.max(score).alias("full_score"))
    rest = candidates.where(~F.col("policy").endswith("_full"))
    family = F.substring_index("policy", "_minus_", -1)
    return rest.join(full, "cycle_id").select("cycle_id", "policy", family.alias("family"), F.col(score), "full_score", (F.col(score) - F.col("full_score")).alias("delta"))


def combined_drops(deltas: DataFrame, least: float = 0.0) -> DataFrame:
    """Per cycle one more candidate: all families whose drop alone did better than `least`, the best first."""
    better = deltas.where(F.col("delta") > least)
    names = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("delta")).alias("d"), "family"))), lambda x: x["family"])
    return better.groupBy("cycle_id").agg(names.alias("drop_families"), F.count(F.lit(1)).alias("drop_family_count"))


def sweep(scored: DataFrame, paths: DataFrame, grid: DataFrame, hold: int, block: int, daily_cap: int | None = None) -> DataFrame:
    """Fold metrics of every parameter of a grid (params, threshold) in one job: rows meet the grid, and each (params,
    fold) is simulated apart. Only rows over the lowest threshold are multiplied by the grid."""
    least = grid.agg(F.min("threshold").alias("least"))
    rows = scored.join(F.broadcast(least)).where(F.col("score") > F.col("least")).drop("least")
    rows = rows.join(few(grid)).join(paths, ["symbol", "minute"]).withColumn("skip_reason", entry_rule(F.col("score"), F.col("threshold")))
    keys = ("params", *KEYS)
    episodes = fixed_hold_episodes(entered(rows, hold, block, daily_cap, keys), hold, keys=keys)
    folds = grid.select("params").join(few(scored.select(*KEYS).distinct()))
    return episode_metrics(episodes, folds, keys)


def policy_sweep(scored: DataFrame, bars: DataFrame, grid: DataFrame, block: int, side: str = "long", daily_cap: int | None = None) -> DataFrame:
    """Fold metrics of every row of a grid (params, threshold, hold_minutes, min_score, min_margin, min_ratio) in one job.

    A filter that is NULL asks for nothing. Paths of all holds come from one sort of the bars, and meet only rows that
    their policy's rule lets in. Every (params, fold) is in the result, without trades too. A grid of no rows, or that
    names a params twice, is an error; so are more than FEW different holds, which the driver reads.
    """
    holds = [r[0] for r in grid.select("hold_minutes").distinct().limit(FEW + 1).collect()]
    if not holds or len(holds) > FEW or None in holds or not grid.groupBy("params").count().where("count > 1").isEmpty():
        raise ValueError("a grid needs rows, a hold for each, and names that differ")
    least = grid.agg(F.min(F.greatest("threshold", F.coalesce("min_score", "threshold"))).alias("least"))
    rows = scored.join(F.broadcast(least)).where(F.col("score") >= F.col("least")).drop("least").join(few(grid))
    rule = entry_rule(F.col("score"), F.col("threshold"), *[F.col(c) for c in ("min_score", "min_margin", "min_ratio")])
    rows = rows.withColumn("skip_reason", rule).where("skip_reason IS NULL").join(paths(bars, tuple(sorted(holds))), ["symbol", "minute", "hold_minutes"])
    keys = ("params", *KEYS)
    trades = fixed_hold_episodes(entered(rows, None, block, daily_cap, keys), None, side, keys=keys)
    return episode_metrics(trades, grid.select("params").join(few(scored.select(*KEYS).distinct())), keys)


def policy_grid(spark: SparkSession, thresholds: tuple[float, ...], holds: tuple[int, ...], min_scores: tuple[float | None, ...] = (None,), min_margins: tuple[float | None, ...] = (None,), min_ratios: tuple[float | None, ...] = (None,)) -> DataFrame:
    """All combinations as a grid for policy_sweep(), named t<threshold>_h<hold> and, where asked for, _s, _m and _r."""
    axes = {"threshold": ("double", thresholds), "hold_minutes": ("int", holds), "min_score": ("double", min_scores), "min_margin": ("double", min_margins), "min_ratio": ("double", min_ratios)}
    out = spark.range(1)
    for name, (kind, values) in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v).cast(kind) for v in values])))
    text = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    parts = [F.concat(F.lit(tag), text(c)) for tag, c in zip("thsmr", axes)]
    return out.select(F.concat_ws("_", *parts).alias("params"), *axes)


def rolling_sweep(
    scored: DataFrame, paths: DataFrame, windows: tuple[int, ...], quantiles: tuple[float, ...], floors: tuple[float, ...], at_least: Callable[[int], int], hold: int, block: int, **filters: float
) -> DataFrame:
    """Fold metrics of all windows x quantiles x floors of a moving threshold in one job, params as w<window>_q<q>_f<floor>.
    Thresholds are computed once for each window and quantile; only rows over theirs meet the floors. filters are
    those of entry_rule()."""
    parts = []
    for w in windows:
        for q in quantiles:
            thr = rolling_quantile(scored.select(*KEYS, "minute", "score"), w, q, at_least(w)).withColumn("params", F.lit(f"w{w}_q{q:g}"))
            parts.append(thr.where("score > rolling_thr"))
    each = F.explode(F.array(*[F.struct(F.lit(float(f)).alias("floor"), F.lit(f"_f{f:g}").alias("name")) for f in floors]))
    rows = reduce(DataFrame.unionByName, parts).withColumn("f", each).withColumn("threshold", F.greatest("rolling_thr", "f.floor"))
    rows = rows.withColumn("params", F.concat("params", "f.name")).drop("f")
    rows = rows.join(paths, ["symbol", "minute"]).withColumn("skip_reason", entry_rule(F.col("score"), F.col("threshold"), **filters))
    keys = ("params", *KEYS)
    trades = fixed_hold_episodes(entered(rows, hold, block, keys=keys), hold, keys=keys)
    names = F.explode(F.array(*[F.lit(f"w{w}_q{q:g}_f{f:g}") for w in windows for q in quantiles for f in floors]))
    return episode_metrics(trades, scored.select(*KEYS).distinct().withColumn("params", names), keys)


def least_history(window_minutes: int, at_most: int = 30_000) -> int:
    """Scores that a moving threshold waits for, if nothing else is said: half of its window, 30,000 at most."""
    return min(at_most, window_minutes // 2)


def few(df: DataFrame) -> DataFrame:
    """df to be broadcast, if it has no more than FEW rows; else Spark chooses the join."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def replay(scored: DataFrame, past: DataFrame, paths: DataFrame, q: float, floor: float, at_least: int, hold: int, block: int) -> DataFrame:
    """Trades under one fixed threshold per fold from its score history, without training again."""
    rows = scored.join(history_threshold(past, q, floor, at_least), list(KEYS), "left").join(paths, ["symbol", "minute"])
    rows = rows.withColumn("skip_reason", entry_rule(F.col("score"), F.col("threshold")))
    return fixed_hold_episodes(entered(rows, hold, block), hold)


def recent(rows: DataFrame, n: int, keys: tuple[str, ...] = KEYS, order: Column | str = "minute") -> DataFrame:
    """The n most recent rows of each key."""
    if not keys:
        return rows.orderBy(F.desc(order) if isinstance(order, str) else order).limit(n)
    w = Window.partitionBy(*keys).orderBy(F.desc(order) if isinstance(order, str) else order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def slug(value: Column) -> Column:
    """A number as part of a name: 20 for 20.0, 0p5 for 0.5, m1 for -1."""
    return F.translate(F.regexp_replace(value.cast("string"), r"\.0$", ""), "-.", "mp")


def downstream(entries: DataFrame, lookaheads: tuple[int, ...], feature_sets: tuple[str, ...], thresholds: tuple[float, ...], tail_thresholds: tuple[float, ...], holds: tuple[float, ...], root: str = "runs") -> DataFrame:
    """What runs follow from chosen entry sets (selected_key, entry_oof_path, features_path), one row each: every look-ahead,
    exit feature set, entry threshold (others for sets of the tail) and hold threshold, with names and folders. Exit
    models are shared by runs of one exit_run_id."""
    each = lambda values, kind: F.explode(F.array(*[F.lit(v).cast(kind) for v in values]))
    own = F.when(F.contains("selected_key", F.lit("tail")), F.array(*[F.lit(float(t)) for t in tail_thresholds])).otherwise(F.array(*[F.lit(float(t)) for t in thresholds]))
    out = entries.select("selected_key", "entry_oof_path", "features_path", each(lookaheads, "int").alias("exit_lookahead_minutes"))
    out = out.withColumn("exit_feature_set", each(feature_sets, "string")).withColumn("entry_threshold_bps", F.explode(own)).withColumn("hold_threshold_bps", each(holds, "double"))
    key = F.concat("selected_key", F.lit("_K"), F.col("exit_lookahead_minutes").cast("string"))
    run = F.concat(F.lit("selected_long_H120_"), key, F.lit("_"), "exit_feature_set")
    out = out.withColumn("exit_dataset_dir", F.concat(F.lit(f"{root}/exit_dataset/exit_long_H120_"), key)).withColumn("exit_run_id", F.concat(F.lit("exit_"), run))
    name = F.concat(F.lit("episode_"), run, F.lit("_entryThr"), slug(F.col("entry_threshold_bps")), F.lit("_holdThr"), slug(F.col("hold_threshold_bps")))
    out = out.withColumn("exit_predictions_path", F.concat(F.lit(f"{root}/exit/"), "exit_run_id", F.lit("/predictions_valid.parquet")))
    return out.withColumn("episode_run_id", name).withColumn("episode_run_dir", F.concat(F.lit(f"{root}/episodes/"), name))
