"""Feature matrices: one plan for any set of families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import timeframes
from tidemark.operators.families import FAMILIES, sheet_of
from tidemark.operators.series import with_sheet
from tidemark.plans.feature_sets import FeatureSpec, audit_names

TIMEFRAME_FAMILIES = {
    "anchored_timeframe_candle": timeframes.anchored_timeframe_candle,
    "anchored_timeframe_candle_lite": timeframes.anchored_timeframe_candle_lite,
    "anchored_timeframe_indicators": timeframes.anchored_timeframe_indicators,
}


def available_families() -> list[str]:
    return sorted([*FAMILIES, *TIMEFRAME_FAMILIES])


def build(bars: DataFrame, families: tuple[str, ...], carry: tuple[str, ...] = (), only: Column | None = None) -> DataFrame:
    """(symbol, minute, features..., carry...) of the families: rolling ones in one sheet, those of higher timeframes joined
    on. carry are columns of bars, such as a label, that go along: joined to the matrix, they would shuffle all of it. Rows
    that `only` is not true for give their values to the windows of others and go before they are wide."""
    if unknown := [f for f in families if f not in FAMILIES and f not in TIMEFRAME_FAMILIES]:
        raise ValueError(f"unknown feature families: {unknown}")
    rolling = [f for f in families if f in FAMILIES]
    keys = ("symbol", "minute", *carry)
    out = with_sheet(bars, sheet_of(*rolling), keys, only=only) if rolling else (bars if only is None else bars.where(only)).select(*keys)
    for f in families:
        if f in TIMEFRAME_FAMILIES:
            out = out.join(TIMEFRAME_FAMILIES[f](bars), ["symbol", "minute"])
    names = [c for c in out.columns if c not in keys]
    if wrong := audit_names(names, manifest(families, names)):
        raise ValueError("; ".join(wrong[:5]))
    return out.select("symbol", "minute", *names, *carry)


def manifest(families: tuple[str, ...], columns: list[str]) -> list[FeatureSpec]:
    """A spec for each column: which family it is of, and how far back its windows reach."""
    out, left = [], list(columns)
    for f in families:
        if f in FAMILIES:
            sheet = sheet_of(f)
            out += [FeatureSpec(c, f, sheet.look[c] + 1) for c in sheet.outs if c in left]
        else:
            prefix = {"anchored_timeframe_candle": "atc_", "anchored_timeframe_candle_lite": "atcl_", "anchored_timeframe_indicators": "ati_"}[f]
            for c in left:
                if c.startswith(prefix):
                    tf = int(c.split("_")[1].rstrip("m"))
                    out.append(FeatureSpec(c, f, tf * 51))
    return list({s.name: s for s in out}.values())


def null_rates(features: DataFrame, keys: tuple[str, ...] = ("symbol", "minute")) -> DataFrame:
    """(feature, null_rate) of all columns, from one aggregate."""
    names = [c for c in features.columns if c not in keys]
    one = features.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in names])
    return one.unpivot([], names, "feature", "null_rate")


def label_summary(labels: DataFrame, keys: tuple[str, ...] = ("symbol", "minute")) -> DataFrame:
    """(label, non_null, null_count, mean, p05, p95) of each label column, exact quantiles."""
    names = [c for c in labels.columns if c not in keys]
    long = labels.select(*names).unpivot([], names, "label", "value")
    q = F.percentile("value", F.array(F.lit(0.05), F.lit(0.95)))
    out = long.groupBy("label").agg(F.count("value").alias("non_null"), F.count_if(F.col("value").isNull()).alias("null_count"), F.avg("value").alias("mean"), q.alias("q"))
    return out.select("label", "non_null", "null_count", "mean", F.col("q")[0].alias("p05"), F.col("q")[1].alias("p95"))


def drop_families(matrix: DataFrame, specs: list[FeatureSpec], drop: tuple[str, ...]) -> DataFrame:
    """The matrix without the columns of some families: a projection, nothing is copied."""
    gone = {s.name for s in specs if s.family in drop}
    return matrix.select(*[c for c in matrix.columns if c not in gone])
