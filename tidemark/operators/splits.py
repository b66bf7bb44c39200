"""Time splits: fold tables, purged and walk-forward training rows, score history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fold:
    """A named range of minutes, both ends included."""

    name: str
    start: int
    end: int


@dataclass(frozen=True)
class Manifest:
    train: Fold
    valid: Fold
    test: Fold
    folds: tuple[Fold, ...]
    purge_minutes: int = 241
    embargo_minutes: int = 0

    def __post_init__(self) -> None:
        for r in (self.train, self.valid, self.test, *self.folds):
            if r.start > r.end:
                raise ValueError(f"{r.name}: start after end")
        if not self.train.end < self.valid.start <= self.valid.end < self.test.start:
            raise ValueError("train, valid and test must follow each other")
        if len(self.folds) != 5 or len({f.name for f in self.folds}) != 5:
            raise ValueError("there must be five folds of different names")
        for a, b in zip(self.folds, self.folds[1:]):
            if a.end >= b.start:
                raise ValueError("folds must not overlap, and must be in order")
        if self.folds[0].start < self.valid.start or self.folds[-1].end > self.valid.end:
            raise ValueError("folds must lie in the validation range")


def fractions(n: int, purge: int = 241, embargo: int = 0) -> Manifest:
    """The manifest of n minutes: 40 % training, five folds of 10 %, 10 % test."""
    at = [n * k // 10 for k in range(11)]
    folds = tuple(Fold(f"fold_{k + 1:02d}", at[4 + k], at[5 + k] - 1) for k in range(5))
    return Manifest(Fold("train", 0, at[4] - 1), Fold("valid", at[4], at[9] - 1), Fold("test", at[9], n - 1), folds, purge, embargo)


def fold_table(spark: SparkSession, m: Manifest) -> DataFrame:
    return spark.createDataFrame([(f.name, f.start, f.end) for f in m.folds], "fold string, start long, end long")


def fold_of(minute: Column, m: Manifest) -> Column:
    """The fold that a minute lies in, NULL outside: five comparisons, no join."""
    out = F.lit(None).cast("string")
    for f in reversed(m.folds):
        out = F.when(minute.between(f.start, f.end), f.name).otherwise(out)
    return out


def purged_train(minute: Column, m: Manifest, fold: Fold, label_minutes: int) -> Column:
    """Training rows whose label, which ends at minute + 1 + label_minutes, is clear of the fold, and which are not in
    the embargo after it."""
    touches = (minute <= fold.end) & (minute + 1 + label_minutes >= fold.start)
    embargo = (minute > fold.end) & (minute <= fold.end + m.embargo_minutes)
    return minute.between(m.train.start, m.train.end) & ~touches & ~embargo


def walk_forward_train(minute: Column, m: Manifest, fold: Fold, mode: str, label_minutes: int, window_minutes: int | None = None) -> Column:
    """fixed: the training range; expanding: all before the fold; rolling: the last window before it. Labels end before
    the fold starts."""
    safe = minute + 1 + label_minutes < fold.start
    if mode == "fixed":
        return minute.between(m.train.start, m.train.end) & safe
    if mode == "expanding":
        return (minute >= m.train.start) & safe
    if mode == "rolling":
        if not window_minutes:
            raise ValueError("rolling needs a window")
        return (minute >= fold.start - window_minutes) & (minute >= m.train.start) & safe
    raise ValueError(f"unknown mode {mode!r}")


def history(minute: Column, fold: Fold, minutes: int) -> Column:
    """The minutes just before a fold."""
    return (minute >= fold.start - minutes) & (minute < fold.start)


def inside_fold(minute: Column, fold: Fold, future_minutes: int) -> Column:
    """Rows whose future of so many minutes ends within the fold."""
    return (minute >= fold.start) & (minute + 1 + future_minutes <= fold.end)


def roles(rows: DataFrame, m: Manifest, label_minutes: int) -> DataFrame:
    """(fold, role, ...): each row as training or evaluation row of each fold it belongs to, from one pass."""
    minute = F.col("minute")
    parts = []
    for f in m.folds:
        role = F.when(minute.between(f.start, f.end), "eval").when(purged_train(minute, m, f, label_minutes), "train")
        parts.append(F.when(role.isNotNull(), F.struct(F.lit(f.name).alias("fold"), role.alias("role"))))
    return rows.withColumn("__r", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull()))).select("__r.*", *rows.columns)
