"""Folds as a table: any number of folds for each symbol, met by rows through the days that their ranges reach over.

A fold is a row (symbol, fold, start, end, train_start, train_end, embargo_minutes), minutes with both ends included. What
a row of bars is to a fold (training, evaluation, score history) is a range of minutes, so that all of it is one table of
ranges and one equi-join on (symbol, day), in which long ranges fall to many days and no key is hot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.splits import Manifest

SCHEMA = "symbol string, fold string, start long, end long, train_start long, train_end long, embargo_minutes long"
DAY = 1440


def of_manifest(spark: SparkSession, manifests: dict[str, Manifest]) -> DataFrame:
    """The folds of manifests by symbol."""
    rows = [(s, f.name, f.start, f.end, m.train.start, m.train.end, m.embargo_minutes) for s, m in manifests.items() for f in m.folds]
    return spark.createDataFrame(rows, SCHEMA)


def even(extents: DataFrame, embargo: int = 0) -> DataFrame:
    """The folds of (symbol, first, last, folds): 40 % of the minutes to train, then `folds` equal ones up to 90 %, the rest
    kept for the last test. Nothing comes to the driver."""
    n, k = F.col("last") - F.col("first") + 1, F.col("folds")
    at = lambda i: F.col("first") + F.floor(n * (4 * k + 5 * i) / (10 * k)).cast("long")
    each = extents.withColumn("__i", F.explode(F.sequence(F.lit(0), k - 1)))
    return each.select(
        "symbol", F.concat(F.lit("fold_"), F.lpad((F.col("__i") + 1).cast("string"), 2, "0")).alias("fold"), at(F.col("__i")).alias("start"), (at(F.col("__i") + 1) - 1).alias("end"),
        F.col("first").alias("train_start"), (at(F.lit(0)) - 1).alias("train_end"), F.lit(embargo).cast("long").alias("embargo_minutes"),
    )


def problems(folds: DataFrame) -> DataFrame:
    """(symbol, fold, problem): one row for each thing wrong with a fold; none if all is well."""
    earlier = Window.partitionBy("symbol").orderBy("start", "end", "fold").rowsBetween(Window.unboundedPreceding, -1)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("symbol", "fold", "start", "end", "train_start", "train_end")])
    checks = {
        "unknown value": ~known,
        "start after end": (F.col("start") > F.col("end")) | (F.col("train_start") > F.col("train_end")),
        "overlaps a fold before": F.col("__before") >= F.col("start"),
        "name stands twice": F.col("__alike") > 1,
        "training not before the fold": F.col("train_end") >= F.col("start"),
        "negative embargo": F.col("embargo_minutes") < 0,
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))
    folds = folds.withColumns({"__before": F.max(F.when(F.col("start").isNotNull(), F.col("end"))).over(earlier), "__alike": F.count(F.lit(1)).over(Window.partitionBy("symbol", "fold"))})
    return folds.select("symbol", "fold", F.explode(found).alias("problem"))


def checked(folds: DataFrame) -> DataFrame:
    """folds, or an error that names the first things wrong."""
    if wrong := problems(folds).orderBy("symbol", "fold", "problem").limit(5).collect():
        raise ValueError("; ".join(f"{r['symbol']} {r['fold']}: {r['problem']}" for r in wrong))
    return folds


def _ranges(folds: DataFrame, parts: list[tuple[str, Column, Column]]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(role).alias("role"), a.cast("long").alias("__a"), b.cast("long").alias("__b")) for role, a, b in parts]))
    return folds.select("symbol", "fold", each.alias("r")).select("symbol", "fold", "r.*").where("__a <= __b")


def evaluated(folds: DataFrame) -> DataFrame:
    """Ranges of the folds themselves."""
    return _ranges(folds, [("eval", F.col("start"), F.col("end"))])


def purged(folds: DataFrame, label_minutes: int) -> DataFrame:
    """Ranges of training rows whose label, which ends at minute + 1 + label_minutes, is clear of the fold, and which are
    not in the embargo after it."""
    after = F.col("end") + F.coalesce("embargo_minutes", F.lit(0)) + 1
    before = F.least("train_end", F.col("start") - label_minutes - 2)
    return _ranges(folds, [("train", F.col("train_start"), before), ("train", F.greatest("train_start", after), F.col("train_end"))])


def walk_forward(folds: DataFrame, label_minutes: int, window_minutes: int | None = None) -> DataFrame:
    """Ranges of training rows before the fold by mode: fixed, expanding and, with a window, rolling. Labels end before
    the fold starts."""
    safe = F.col("start") - label_minutes - 2
    parts = [("fixed", F.col("train_start"), F.least("train_end", safe)), ("expanding", F.col("train_start"), safe)]
    if window_minutes is not None:
        parts.append(("rolling", F.greatest("train_start", F.col("start") - window_minutes), safe))
    return _ranges(folds, parts)


def history(folds: DataFrame, minutes: int) -> DataFrame:
    """Ranges of the minutes just before the folds, whose scores thresholds are taken from."""
    return _ranges(folds, [("history", F.col("start") - minutes, F.col("start") - 1)])


def met(rows: DataFrame, ranges: DataFrame, how: str = "inner") -> DataFrame:
    """rows (symbol, minute, ...) with fold and role of each range that they lie in; with how="left", the others too, with
    NULL. Rows have no columns of these names yet."""
    if clash := {"fold", "role", "__day", "__a", "__b"} & set(rows.columns):
        raise ValueError(f"columns that folds give: {sorted(clash)}")
    days = ranges.withColumn("__day", F.explode(F.sequence(F.floor(F.col("__a") / DAY), F.floor(F.col("__b") / DAY))))
    r, d = rows.withColumn("__day", F.floor(F.col("minute") / DAY)).alias("r"), days.alias("d")
    same = (F.col("r.symbol") == F.col("d.symbol")) & (F.col("r.__day") == F.col("d.__day"))
    return r.join(d, same & F.col("r.minute").between(F.col("d.__a"), F.col("d.__b")), how).select(*[F.col(f"r.`{c}`") for c in rows.columns], "d.fold", "d.role")


def roles(rows: DataFrame, folds: DataFrame, label_minutes: int) -> DataFrame:
    """Each row as training or evaluation row of each fold it belongs to; purged ranges leave the fold out."""
    return met(rows, evaluated(folds).unionByName(purged(folds, label_minutes)))


def fold_of(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """rows with the fold that they lie in, NULL outside all."""
    return met(rows, evaluated(folds), "left").drop("role")
