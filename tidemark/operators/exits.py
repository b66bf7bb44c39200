"""Exit models: entry candidates, feature sets of position states, and cross-fitted predictions of holding on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import trees
from tidemark.operators.simulate import KEYS
from tidemark.sources.tables import Work

TARGET = "target_exit_hold_delta_bps"
#: What is known of a position and of its score, and what no model may learn from.
POSITION = ("age_minutes", "unrealized_pl_bps", "mfe_since_entry_bps", "mae_since_entry_bps", "giveback_from_mfe_bps")
SCORE = ("age_minutes", "entry_score", "current_score", "score_decay")
META = ("symbol", "fold", "side", "episode_id", "entry_minute", "current_minute", "minute", "entry_price", "current_close", "exit_now", "exit_later")
FEATURE_SETS = ("v0_market_only", "v1_score_decay", "v2_score_position")
_NUMBERS = ("double", "float", "long", "integer", "short", "byte")


def candidates(scored: DataFrame, grid_minutes: int, least: float | None = None, quantile: float | None = None) -> DataFrame:
    """Entries (symbol, fold, minute, score): scored rows on the decision grid, strictly over `least`, and then at or
    over the quantile of what is left of their fold."""
    rows = scored.where(F.col("score").isNotNull() & F.col("fold").isNotNull()).where(F.col("minute") % grid_minutes == 0)
    if least is not None:
        rows = rows.where(F.col("score") > least)
    if quantile is not None:
        limit = rows.groupBy(*KEYS).agg(F.percentile("score", quantile).alias("__limit"))
        rows = rows.join(limit, list(KEYS)).where(F.col("score") >= F.col("__limit")).drop("__limit")
    return rows


def unknown_folds(entries: DataFrame, folds: DataFrame) -> DataFrame:
    """(symbol, fold, rows) of entries whose fold is not in `folds`."""
    return entries.join(folds.select("fold").distinct(), "fold", "left_anti").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rows"))


def forbidden(name: str, target: str = TARGET) -> bool:
    """Whether a column looks ahead or is not for learning."""
    low = name.lower()
    return name == target or low.startswith(("target_", "diag_")) or "future" in low or "label" in low or low in META


def feature_columns(states: DataFrame, feature_set: str, target: str = TARGET) -> list[str]:
    """Numeric columns of a feature set: the market's, with the score's, with the position's too."""
    if feature_set not in FEATURE_SETS:
        raise ValueError(f"unknown feature set {feature_set!r}")
    numeric = [f.name for f in states.schema if f.dataType.typeName() in _NUMBERS and not forbidden(f.name, target)]
    market = [c for c in numeric if c not in POSITION and c not in SCORE and c != "score_ratio"]
    more = {"v0_market_only": (), "v1_score_decay": SCORE, "v2_score_position": (*SCORE, *POSITION)}[feature_set]
    out = market + [c for c in dict.fromkeys(more) if c in numeric]
    if not out:
        raise ValueError(f"no numeric columns for {feature_set}")
    return out


def dataset_columns(states: DataFrame, target: str = TARGET) -> list[str]:
    """All columns of a dataset that are neither keys nor labels."""
    return [c for c in states.columns if not forbidden(c, target)]


def narrowed(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with some columns in single precision, which halves what training keeps in memory."""
    return df.withColumns({c: F.col(c).cast("float") for c in columns})


def validate(states: DataFrame, target: str = TARGET) -> None:
    """Raise unless the dataset has its columns, rows, known times, and two folds at least."""
    if missing := sorted({*KEYS, "episode_id", "entry_minute", "current_minute", target} - set(states.columns)):
        raise ValueError(f"exit dataset lacks {', '.join(missing)}")
    row = states.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("entry_minute").isNull() | F.col("current_minute").isNull()).alias("bad"), F.count_distinct("fold").alias("folds")).first()
    if not row["n"]:
        raise ValueError("exit dataset is empty")
    if row["bad"]:
        raise ValueError(f"{row['bad']} rows without a time")
    if row["folds"] < 2:
        raise ValueError("exit dataset needs two folds")


def fold_rows(states: DataFrame, fold: str, target: str = TARGET) -> tuple[DataFrame, DataFrame]:
    """(training rows, evaluation rows): the other folds' states without any of a trade that the fold evaluates."""
    known = states.where(F.col(target).isNotNull())
    own, others = known.where(F.col("fold") == fold), known.where(F.col("fold") != fold)
    return others.join(own.select("episode_id").distinct(), "episode_id", "left_anti"), own


def cross_fit(states: DataFrame, feature_set: str, target: str = TARGET, keep: list[str] | None = None, **params) -> tuple[DataFrame, DataFrame]:
    """(predictions, importances): each fold's states (or their columns to keep) predicted by a model of the others' without
    any of its trades. An empty side is an error. All folds' models grow in the same jobs; params are those of
    trees.grow()."""
    validate(states, target)
    columns = feature_columns(states, feature_set, target)
    known = states.where(F.col(target).isNotNull())
    with Work(states.sparkSession, "cross_fit") as work:
        # few trades are in several folds: their table is small, and states need not be shuffled to meet it
        per = known.where("episode_id IS NOT NULL").groupBy("episode_id").agg(F.collect_set("fold").alias("__folds"))  # as many folds as a trade is in
        shared = work.write(per.where("size(__folds) > 1"))
        rows = known.where("episode_id IS NOT NULL").join(shared, "episode_id", "left").withColumn("__folds", F.coalesce("__folds", F.array("fold")))
        folds = sorted(r["fold"] for r in states.select("fold").distinct().collect())
        masks = {f: ~F.array_contains("__folds", f) for f in folds}
        counts = rows.agg(*[F.struct(F.count_if(masks[f]).alias("train"), F.count_if(F.col("fold") == f).alias("own")).alias(f"f{k}") for k, f in enumerate(folds)]).first()
        for f, n in zip(folds, counts):
            if not n["train"] or not n["own"]:
                raise ValueError(f"{f}: no rows to train on or to evaluate")
        forest = trees.grow(rows, columns, target, masks, **params)
    gains = forest.importance(states.sparkSession).withColumnRenamed("model", "fold")
    return forest.predict(known, F.col("fold"), keep), gains


def last_states(states: DataFrame) -> DataFrame:
    """The oldest state of each trade."""
    w = Window.partitionBy(*KEYS, "episode_id").orderBy(F.desc("age_minutes"))
    return states.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
