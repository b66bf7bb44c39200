"""Fold metrics of predictions and of simulated trades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import averaged, numbered
from tidemark.operators.ranks import quantiles as exact_quantiles

#: What metrics are told apart by.
KEYS = ("symbol", "fold")
INF, NAN = float("inf"), float("nan")


def name_of(q: float) -> str:
    return f"{q * 100:g}".replace(".", "_")


def with_thresholds(df: DataFrame, score: str, quantiles: tuple[float, ...], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """df with thr_<q>: the exact quantiles of score within keys, joined back. df is read three times."""
    per = exact_quantiles(df, score, quantiles, keys)
    per = per.select(*keys, *[F.col("__q")[i].alias(f"thr_{name_of(q)}") for i, q in enumerate(quantiles)])
    return df.join(per, list(keys))


def _when(condition: Column, x: Column) -> Column:
    return F.when(condition, x)


def prediction_metrics(df: DataFrame, target: str, score: str, quantiles: tuple[float, ...] = (0.9, 0.95, 0.99), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per fold: counts, errors, correlation, and the rows at or over the top quantiles of the score."""
    y, p = F.col(target), F.col(score)
    df = with_thresholds(df.where(y.isNotNull() & p.isNotNull()), score, quantiles, keys)
    e = y - p
    mean_square = F.avg(e * e)
    aggs = [
        F.count(F.lit(1)).alias("eval_count"), F.avg(y).alias("target_mean"), F.percentile(y, 0.5).alias("target_median"), F.avg(p).alias("pred_mean"),
        F.avg(F.abs(e)).alias("mae"), F.sqrt(mean_square).alias("rmse"), F.corr(y, p).alias("corr"),
        F.when(F.var_pop(y) > 0, 1 - mean_square / F.var_pop(y)).alias("r2"), F.avg((y > 0).cast("double")).alias("precision_gt0"),
    ]
    for q in quantiles:
        n = name_of(q)
        inside = p >= F.col(f"thr_{n}")
        aggs += [
            F.first(f"thr_{n}").alias(f"top_q{n}_threshold"), F.count_if(inside).alias(f"top_q{n}_count"), F.avg(_when(inside, y)).alias(f"top_q{n}_avg"),
            F.percentile(_when(inside, y), 0.5).alias(f"top_q{n}_median"), F.avg(_when(inside, (y > 0).cast("double"))).alias(f"top_q{n}_precision_gt0"),
        ]
    return df.groupBy(*keys).agg(*aggs)


def bottom_metrics(df: DataFrame, target: str, score: str, quantiles: tuple[float, ...] = (0.95, 0.99), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per fold: the rows at or under the 1 - q quantiles of the score."""
    y, p = F.col(target), F.col(score)
    low = tuple(round(1 - q, 10) for q in quantiles)
    df = with_thresholds(df.where(y.isNotNull() & p.isNotNull()), score, low, keys)
    aggs = []
    for q, l in zip(quantiles, low):
        inside, n = p <= F.col(f"thr_{name_of(l)}"), name_of(q)
        aggs += [F.count_if(inside).alias(f"bottom_q{n}_count"), F.avg(_when(inside, y)).alias(f"bottom_q{n}_avg"), F.avg(_when(inside, (y < 0).cast("double"))).alias(f"bottom_q{n}_precision_lt0")]
    return df.groupBy(*keys).agg(*aggs)


def deciles(df: DataFrame, target: str, score: str, order: str, bins: int = 10, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per fold and bin of equal counts by score (1 lowest): count, means and hit rate. Ties fall by input order."""
    ranked = numbered(df.where(F.col(target).isNotNull() & F.col(score).isNotNull()), score, order, keys)
    place = F.when(F.col("__n") > 1, F.ceil((F.col("__r") - 1) * bins / (F.col("__n") - 1))).otherwise(1)
    ranked = ranked.withColumn("decile", F.greatest(F.lit(1), place).cast("int"))
    return ranked.groupBy(*keys, "decile").agg(
        F.count(F.lit(1)).alias("count"), F.avg(target).alias("avg_target"), F.percentile(target, 0.5).alias("median_target"),
        F.avg((F.col(target) > 0).cast("double")).alias("precision_gt0"), F.avg(score).alias("avg_pred"),
    )


def rank_correlation(df: DataFrame, a: str, b: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Spearman's correlation per fold, equal values sharing their average rank."""
    df = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    for c in (a, b):
        df = averaged(df, c, f"__{c}", keys)
    return df.groupBy(*keys).agg(F.corr(f"__{a}", f"__{b}").alias("spearman"))


def profit_factor(x: Column, none: float | None = NAN) -> Column:
    """Wins over losses; infinite without losses, `none` without trades that win or lose."""
    wins, losses = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)), F.coalesce(F.sum(F.when(x < 0, -x)), F.lit(0.0))
    return F.when(losses > 0, wins / losses).when(wins > 0, F.lit(INF)).otherwise(F.lit(none))


def episode_metrics(episodes: DataFrame, folds: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Sixteen metrics of the trades of each row of keys in `folds`; a fold without trades has counts and sums of 0."""
    net = F.col("net_pl_bps")
    n = F.count(F.lit(1))
    per = episodes.groupBy(*keys).agg(
        n.alias("episode_count"), F.sum("gross_pl_bps").alias("gross_pl_bps_sum"), F.sum(net).alias("net_pl_bps_sum"), F.avg(net).alias("avg_net_pl_bps"),
        F.percentile(net, 0.5).alias("median_net_pl_bps"), F.avg((net > 0).cast("double")).alias("win_rate"), F.avg(F.when(net > 0, net)).alias("avg_win_bps"),
        F.avg(F.when(net < 0, net)).alias("avg_loss_bps"), profit_factor(net, None).alias("profit_factor"), F.avg("hold_minutes").alias("avg_hold_minutes"),
        F.percentile("hold_minutes", 0.5).alias("median_hold_minutes"),
        (n / F.greatest(F.lit(1), F.count_distinct(F.floor(F.col("entry_minute") / 1440)))).alias("round_trips_per_day"),
        F.sum("roundtrip_cost_bps").alias("fee_paid_bps"), F.avg("mfe_bps").alias("avg_mfe_bps"), F.avg("mae_bps").alias("avg_mae_bps"), F.avg("giveback_bps").alias("avg_giveback_bps"),
    )
    zeros = {c: 0 for c in ("episode_count", "gross_pl_bps_sum", "net_pl_bps_sum", "fee_paid_bps", "round_trips_per_day")}
    return folds.select(*keys).distinct().join(per, list(keys), "left").fillna(zeros)


def summarized(metrics: DataFrame) -> DataFrame:
    """mean_ and worst_ (the minimum) over folds of every numeric column."""
    numeric = [f.name for f in metrics.schema if f.dataType.typeName() in ("double", "long", "integer", "float")]
    return metrics.agg(*[F.avg(c).alias(f"mean_{c}") for c in numeric], *[F.min(c).alias(f"worst_{c}") for c in numeric])


#: What two sets of trades are compared by.
VALUES = ("gross_pl_bps", "net_pl_bps", "mfe_bps", "mae_bps", "giveback_bps")
GROUPS = ("both", "left_only", "right_only")


def prefixed(df: DataFrame, prefix: str, keys: tuple[str, ...]) -> DataFrame:
    """df with all columns but the keys renamed."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keys})


def overlap(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = (*KEYS, "side", "entry_minute"), values: tuple[str, ...] = VALUES) -> DataFrame:
    """Full outer join of two sets of trades: keys, left_ and right_ values, group (both, left_only, right_only), and the
    canonical_ values, which are the right ones only where the left has none."""
    a, b = (prefixed(df.select(*keys, *values).withColumn("is", F.lit(True)), p, keys) for df, p in ((left, "left_"), (right, "right_")))
    group = F.when(F.col("left_is") & F.col("right_is"), "both").when(F.col("left_is"), "left_only").otherwise("right_only")
    out = a.join(b, list(keys), "full_outer").withColumn("group", group)
    mine = lambda v: F.when(F.col("group") == "right_only", F.col(f"right_{v}")).otherwise(F.col(f"left_{v}"))
    return out.withColumns({f"canonical_{v}": mine(v) for v in values}).drop("left_is", "right_is")


def overlap_groups(joined: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Twelve statistics per key and group and, as all_union, per key; groups without trades are there with a count of
    0. Without keys there is one row per group."""
    net, gross = F.col("canonical_net_pl_bps"), F.col("canonical_gross_pl_bps")
    aggs = [
        F.count(net).alias("episode_count"), F.sum(gross).alias("gross_pl_bps_sum"), F.sum(net).alias("net_pl_bps_sum"), F.avg(net).alias("avg_net_pl_bps"),
        F.percentile(net, 0.5).alias("median_net_pl_bps"), F.avg((net > 0).cast("double")).alias("win_rate"), F.avg(F.when(net > 0, net)).alias("avg_win_bps"),
        F.avg(F.when(net < 0, net)).alias("avg_loss_bps"), profit_factor(net, 0.0).alias("profit_factor"),
        *[F.avg(f"canonical_{v}").alias(f"avg_{v}") for v in ("mfe_bps", "mae_bps", "giveback_bps")],
    ]
    names = [*GROUPS, "all_union"] if keys else list(GROUPS)
    each = F.explode(F.array("group", F.lit("all_union")) if keys else F.array("group"))
    per = joined.withColumn("overlap_group", each).groupBy(*keys, "overlap_group").agg(*aggs)
    rows = joined.select(*keys).distinct() if keys else joined.sparkSession.range(1).select()
    grid = rows.withColumn("overlap_group", F.explode(F.array(*[F.lit(n) for n in names])))
    zeros = {"episode_count": 0, "gross_pl_bps_sum": 0.0, "net_pl_bps_sum": 0.0, "profit_factor": 0.0}
    return grid.join(per, [*keys, "overlap_group"], "left").fillna(zeros)


def jaccard(joined: DataFrame) -> DataFrame:
    """One row: counts, shares and the Jaccard index of two sets of trades, and the net sums of each and of its parts."""
    both, l, r = (F.count_if(F.col("group") == g) for g in GROUPS)
    net = lambda side, g: F.sum(F.when(F.col("group") == g, F.col(f"{side}_net_pl_bps")))
    return joined.agg(
        both.alias("both_count"), l.alias("left_only_count"), r.alias("right_only_count"), F.try_divide(both, both + l + r).alias("jaccard"),
        F.try_divide(both, both + l).alias("left_overlap_rate"), F.try_divide(both, both + r).alias("right_overlap_rate"),
        F.sum("left_net_pl_bps").alias("left_net_sum"), F.sum("right_net_pl_bps").alias("right_net_sum"), net("left", "both").alias("both_left_net_sum"),
        net("right", "both").alias("both_right_net_sum"), net("left", "left_only").alias("left_only_net_sum"), net("right", "right_only").alias("right_only_net_sum"),
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
