"""Summaries and comparisons of runs: what is reported about predictions, features, policies and trades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.metrics import KEYS, bottom_metrics, deciles, episode_metrics, prediction_metrics, rank_correlation, summarized
from tidemark.operators.ranks import quantiles
from tidemark.plans.feature_sets import FeatureSpec
from tidemark.sources.bars import POSITION, positioned

#: Weights of the robust score of top-quantile means.
ROBUST_WEIGHTS = {
    "mean_top_q95_avg_target_bps": 0.20,
    "worst_top_q95_avg_target_bps": 0.20,
    "mean_top_q97_avg_target_bps": 0.20,
    "worst_top_q97_avg_target_bps": 0.15,
    "mean_top_q99_avg_target_bps": 0.15,
    "worst_top_q99_avg_target_bps": 0.10,
}


# --- features -------------------------------------------------------------------------------------------------------
def feature_summary(rates: DataFrame, specs: list[FeatureSpec], most: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, worst, families) from (feature, null_rate): one row with the features, and how many are NULL in more than
    half and more than 95 % of rows; the `most` features with the highest rates; and features by family."""
    counts = rates.agg(F.count(F.lit(1)).alias("feature_count"), F.count_if(F.col("null_rate") > 0.5).alias("over_50_count"), F.count_if(F.col("null_rate") > 0.95).alias("over_95_count"))
    worst = rates.orderBy(F.desc("null_rate"), "feature").limit(most)
    named = rates.sparkSession.createDataFrame([(s.name, s.family) for s in specs], "feature string, family string")
    return counts, worst, named.groupBy("family").agg(F.count(F.lit(1)).alias("feature_count"))


def mostly_null(rates: DataFrame, limit: float = 0.95) -> DataFrame:
    """Features to warn about."""
    return rates.where(F.col("null_rate") > limit)


# --- predictions ------------------------------------------------------------------------------------------------------
def oof_summary(predictions: DataFrame, target: str, pred: str = "pred", keys: tuple[str, ...] = ("run_id", "side", "horizon_minutes")) -> DataFrame:
    """Per run: rows, folds, mean and 95 % quantile of the prediction, mean of the target and how often it is positive."""
    per = predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("fold").alias("fold_count"), F.avg(pred).alias("pred_mean_bps"),
        F.avg(target).alias("target_mean_bps"), F.avg(F.coalesce((F.col(target) > 0).cast("double"), F.lit(0.0))).alias("target_gt0_rate"),
    )
    high = quantiles(predictions, pred, (0.95,), keys).select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col("__q")[0].alias("pred_p95_bps"))
    whole = per.join(high, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys]), "left")
    return whole.select(*keys, "rows", "fold_count", "pred_mean_bps", "pred_p95_bps", "target_mean_bps", "target_gt0_rate")


def exit_fold_metrics(df: DataFrame, target: str, pred: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Fold metrics with rank correlation, the bottom quantiles, and how far top and bottom lie apart."""
    whole = prediction_metrics(df, target, pred, (0.9, 0.95, 0.99), keys).join(rank_correlation(df, target, pred, keys), list(keys), "left").join(bottom_metrics(df, target, pred, (0.95, 0.99), keys), list(keys), "left")
    return whole.withColumns({f"spread_q{n}": F.col(f"top_q{n}_avg") - F.col(f"bottom_q{n}_avg") for n in ("95", "99")})


def mean_importance(importances: DataFrame) -> DataFrame:
    """(feature, mean_importance_split, mean_importance_gain) over folds, the largest gain first."""
    means = [F.avg(c).alias(f"mean_{c}") for c in ("importance_split", "importance_gain")]
    return importances.groupBy("feature").agg(*means).orderBy(F.desc("mean_importance_gain"), "feature")


def focus(df: DataFrame, pairs: list[tuple[str, int]], side: str = "side", horizon: str = "horizon_minutes") -> DataFrame:
    """Rows of some (side, horizon)."""
    wanted = [(F.col(side) == s) & (F.col(horizon) == h) for s, h in pairs]
    return df.where(reduce(lambda a, b: a | b, wanted, F.lit(False)))


# --- comparisons ------------------------------------------------------------------------------------------------------
def column_summary(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, column, sum, mean, min, max), from one aggregate."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), columns, "column", "value")
    return long.groupBy(*keys, "column").agg(F.sum("value").alias("sum"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))


def selected_policies(chosen: DataFrame, means: list[str], keys: tuple[str, ...] = ("run", "policy")) -> DataFrame:
    """How often each policy was chosen, and means of what came of it; rows without a policy are a group."""
    out = chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("cycle_count"), *[F.avg(c).alias(f"mean_{c}") for c in means])
    return out.orderBy(F.desc("cycle_count"), F.desc(f"mean_{means[0]}"), *keys)


def run_comparison(chosen: DataFrame, value: str, run: str = "run") -> DataFrame:
    """Per run: sum, mean and minimum of a value, and a map of how often each policy was chosen."""
    counts = chosen.groupBy(run, F.coalesce("policy", F.lit("none")).alias("policy")).agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy(run).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("policy", "n")))).alias("policies"))
    return chosen.groupBy(run).agg(F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.min(value).alias("min")).join(maps, run)


def robust_score(columns: list[str], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of metrics; those that the table has not are left out, an unknown one makes the sum unknown."""
    parts = [F.lit(w) * F.col(c) for c, w in (weights or ROBUST_WEIGHTS).items() if c in columns]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def episode_score(avg: Column, worst: Column, factor: Column) -> Column:
    """A ranking aid for sets of trades."""
    zero = F.lit(0.0)
    return F.coalesce(avg, zero) + 0.5 * F.coalesce(worst, zero) + 0.5 * F.least(F.coalesce(factor, zero), F.lit(3.0))


def fallback_score(mean_net: Column, worst_net: Column, episodes: Column, least: int, worst_weight: float = 0.5, penalty: float = 1_000_000.0) -> Column:
    """Selector score where only the mean and the worst of folds are known."""
    zero = F.lit(0.0)
    return F.coalesce(mean_net, zero) + worst_weight * F.coalesce(worst_net, zero) - F.when(F.coalesce(episodes, F.lit(0)) >= least, 0.0).otherwise(penalty)


def baseline_deltas(df: DataFrame, baseline: str, metrics: list[str], keys: tuple[str, ...] = ("side", "horizon_minutes"), variant: str = "variant") -> DataFrame:
    """df with each metric's difference from the baseline variant's of the same keys; without keys, from its one row. A
    baseline that has several rows is an error."""
    base = df.where(F.col(variant) == baseline)
    if not (base.groupBy(*keys).count() if keys else base.agg(F.count(F.lit(1)).alias("count"))).where("count > 1").isEmpty():
        raise ValueError(f"the baseline {baseline} stands twice")
    base = base.select(*keys, *[F.col(m).alias(f"baseline_{m}") for m in metrics])
    out = df.join(base, list(keys), "left") if keys else df.join(F.broadcast(base), how="left")
    return out.withColumns({f"delta_vs_{baseline}_{m}": F.col(m) - F.col(f"baseline_{m}") for m in metrics})


def worst_episodes(episodes: DataFrame, k: int = 20) -> DataFrame:
    return episodes.orderBy("net_pl_bps", *[c for c in (*KEYS, "entry_minute") if c in episodes.columns]).limit(k)


def split_rows(roles: DataFrame, folds: DataFrame) -> DataFrame:
    """Folds with the rows of each of their roles; 0 where there are none."""
    counts = roles.groupBy("fold").pivot("role", ["train", "eval"]).count()
    return folds.join(counts, "fold", "left").fillna(0, ["train", "eval"]).withColumnsRenamed({"train": "train_rows", "eval": "eval_rows"})


# --- files --------------------------------------------------------------------------------------------------------------
def _found(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(source_file) of all files of a name below a folder. No content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).select(F.col("_metadata.file_path").alias("source_file"))


def _lines(spark: SparkSession, root: str, name: str) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("ignoreCorruptFiles", True)
    return positioned(reader.text(root)).where(F.length(F.trim("value")) > 0).select("value", POSITION)


def collect_runs(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All CSV files of one name below a folder, columns by name, as strings, with source_file and source_run_dir.

    One scan finds the files' headers, and one reads their rows, however many files and layouts there are: a row's cells are
    taken by its own file's header. Only the different column names reach the driver. Cells that a row has not are NULL,
    those beyond the header go; of columns alike in a header the first counts. Columns of a file named as the two sources
    are left out. Unreadable files do not stop the others, see unread_runs(); empty ones count as not there. No cell holds
    a line break.
    """
    if _found(spark, root, name).isEmpty():
        raise FileNotFoundError(f"no {name} below {root}")
    lines = _lines(spark, root, name)
    file = F.col(POSITION)["file"].alias("source_file")
    headers = lines.groupBy(file).agg(F.min(POSITION).alias("__at"), F.regexp_replace(F.min_by("value", POSITION), "^\\ufeff", "").alias("__header"))
    width = headers.agg(F.max(F.size(F.split("__header", ",")))).first()[0] or 1
    kinds = ", ".join(f"c{i} string" for i in range(width))
    cells = lambda c: F.array(*[F.from_csv(c, kinds)[f"c{i}"] for i in range(width)])
    headers = headers.withColumn("__names", F.transform(cells(F.col("__header")), lambda n: F.trim(n)))
    named = headers.select("source_file", F.posexplode("__names").alias("at", "name")).where("name <> '' AND name NOT IN ('source_file', 'source_run_dir')")
    names = [r["name"] for r in named.groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").collect()]
    rows = lines.withColumn("source_file", file).join(headers, "source_file").where(F.col(POSITION) != F.col("__at")).withColumn("__cells", cells(F.col("value")))
    values = [F.get("__cells", (F.array_position("__names", n) - 1).cast("int")).alias(n) for n in names]
    return rows.select(*values, "source_file", F.regexp_extract("source_file", "^(.*)/[^/]*$", 1).alias("source_run_dir"))


def unread_runs(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(source_file) of the files, not empty, that collect_runs() finds no line in, as they cannot be read."""
    read = _lines(spark, root, name).select(F.col(POSITION)["file"].alias("source_file")).distinct()
    return _found(spark, root, name).join(read, "source_file", "left_anti")


def run_summaries(spark: SparkSession, root: str, name: str = "summary.json") -> DataFrame:
    """JSON summaries of runs as rows, a field `skipped` (reason to count) spread to skipped_ columns."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("multiLine", True).json(root).withColumn("source_file", F.col("_metadata.file_path"))
    if "skipped" not in df.columns:
        return df
    reasons = df.schema["skipped"].dataType.names
    return df.select(*[c for c in df.columns if c != "skipped"], *[F.coalesce(F.col("skipped")[r], F.lit(0)).alias(f"skipped_{r}") for r in reasons])


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """Trades from a folder with episodes.parquet or episodes.csv, or from a file."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for kind in ("parquet", "csv"):
        for at in (f"{path.rstrip('/')}/episodes.{kind}", path):
            if at.rstrip("/").endswith(f".{kind}") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)):
                return spark.read.parquet(at) if kind == "parquet" else spark.read.csv(at, header=True, inferSchema=True)
    raise FileNotFoundError(f"no episodes in {path}")


def write_report(path: str, tables: dict[str, DataFrame], by: dict[str, str] | None = None) -> None:
    """One folder of Parquet per table of a report, large ones partitioned by a column."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by[name]) if by and name in by else writer).parquet(f"{path.rstrip('/')}/{name}")


def prediction_report(predictions: DataFrame, target: str, pred: str = "pred", order: str = "minute", of_exits: bool = False, keys: tuple[str, ...] = KEYS) -> dict[str, DataFrame]:
    """The tables of a report on predictions, for write_report(): metrics and deciles of each fold, the predictions, and mean
    and worst of the metrics over folds. Exit models have rank correlation and bottom quantiles too."""
    folds = exit_fold_metrics(predictions, target, pred, keys) if of_exits else prediction_metrics(predictions, target, pred, keys=keys)
    return {"fold_metrics": folds, "score_deciles": deciles(predictions, target, pred, order, keys=keys), "predictions_valid": predictions, "summary_metrics": summarized(folds)}


def episode_report(episodes: DataFrame, folds: DataFrame, skips: DataFrame | None = None, keys: tuple[str, ...] = KEYS) -> dict[str, DataFrame]:
    """The tables of a report on trades: the trades, metrics of each row of keys in `folds`, mean and worst of them over folds,
    and why rows did not enter, where that is known."""
    metrics = episode_metrics(episodes, folds, keys)
    return {"episodes": episodes, "fold_metrics": metrics, "summary_metrics": summarized(metrics), **({"skipped": skips} if skips is not None else {})}


def snapshot(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, sha256) of files: what a run was made from."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.sha2("content", 256).alias("sha256"))
