"""Registered queries over the given tables, and SQL that another engine can run for the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import labels as lab
from tidemark.operators import metrics as met
from tidemark.operators import fold_tables, models, quality, simulate, splits, timeframes
from tidemark.operators.families import FAMILIES, sheet_of
from tidemark.operators.series import indexed, resampled, with_sheet
from tidemark.plans import matrix, research
from tidemark.plans.feature_sets import SETS
from tidemark.sources.bars import DENSE_SQL, GAPPY_SQL, dense_bars, gappy_bars, normalize
from tidemark.sources.tables import Work, kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOLD, COOLDOWN = 60, 30


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Doubles rounded, and -0 made 0, so that results of two engines can be held against each other."""
    if nudge:
        return df.mapInArrow(partial(_near, digits=digits, nudge=nudge), df.schema)
    near = lambda c: F.when(F.abs(c) < 1e9, F.round(c, digits)).otherwise(F.round(c, 0)) + F.lit(0.0)
    return df.select(*[near(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _near(batches: Iterator[pa.RecordBatch], digits: int, nudge: float) -> Iterator[pa.RecordBatch]:
    """Features: large ones to fewer digits, so that their last bits do not tell. Wide tables, rounded by columns: as an
    expression of a row, this is too long for the JVM to compile."""

    def near(column: pa.Array) -> pa.Array:
        x = (column.fill_null(0) if column.null_count else column).to_numpy(zero_copy_only=False)
        size = np.abs(x)
        scale = np.where(size < 1e3, 10.0**digits, np.where(size < 1e9, 1e2, 1.0))
        with np.errstate(all="ignore"):
            moved = np.where(size < 1e9, x + nudge, x)
            out = np.copysign(np.floor(np.abs(moved) * scale + 0.5) / scale, moved) + 0.0
        return pa.array(np.where(size < 2.0**52, out, x), pa.float64(), mask=~column.is_valid().to_numpy(zero_copy_only=False))

    for batch in batches:
        yield pa.RecordBatch.from_arrays([near(c) if c.type == pa.float64() else c for c in batch.columns], names=batch.schema.names)


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0 AS {n.split('.')[-1]}" for n in names)


# --- bars ---------------------------------------------------------------------------------------------------------
_BARS = ("open", "high", "low", "close", "volume")


@query("src_bars_dense", f"WITH {DENSE_SQL} SELECT symbol, minute, {_r(*_BARS)} FROM bars")
def _dense(spark, sf):
    return rounded(dense_bars(spark, sf).drop("ts"))


@query("src_bars_gappy", f"WITH {GAPPY_SQL} SELECT symbol, minute, {_r(*_BARS)} FROM gappy")
def _gappy(spark, sf):
    return rounded(gappy_bars(spark, sf).drop("ts"))


_RAW = """SELECT epoch(o_orderdate) AS s, o_totalprice AS p, o_orderkey AS k FROM orders"""


@query(
    "prj_normalize",
    f"""WITH raw AS ({_RAW}), last AS (SELECT CAST(floor(s / 60) AS BIGINT) AS minute, arg_max(p, k) AS close FROM raw GROUP BY 1)
    SELECT 'series' AS symbol, minute, round(close, 6) + 0 AS open, round(close, 6) + 0 AS close FROM last""",
)
def _normalized(spark, sf):
    """Orders as a raw table with aliased names and epoch seconds; the last order of a day stays."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    raw = o.groupBy(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("Open Time")).agg(F.max_by("o_totalprice", "o_orderkey").cast("string").alias("C"))
    raw = raw.select("Open Time", F.col("C").alias("O"), F.col("C").alias("H"), F.col("C").alias("L"), "C", F.lit("1").alias("Vol"))
    return rounded(normalize(raw).select("symbol", "minute", "open", "close"))


# dirty bars: rows of lineitem as bars whose prices need not fit together
def _dirty(spark, sf):
    l = spark.read.parquet(f"{sf}/lineitem.parquet")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return l.select(
        F.lit("series").alias("symbol"), F.timestamp_seconds(F.col("l_orderkey") * 60).alias("ts"), F.col("l_orderkey").alias("minute"), F.col("l_linenumber").cast("long").alias("line"),
        price.alias("open"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity") * 1.04).alias("high"),
        (price * (1 - F.col("l_tax"))).alias("low"), (price - F.when(F.col("l_linenumber") == 7, price)).alias("bad"), price.alias("close"), (F.col("l_quantity") - 3).alias("volume"),
    ).withColumn("close", F.when(F.col("line") == 7, 0.0).otherwise(F.col("close"))).drop("bad")


_DIRTY_SQL = """dirty AS (SELECT 'series' AS symbol, l_orderkey AS minute, CAST(l_linenumber AS BIGINT) AS line, l_extendedprice / l_quantity AS open,
  l_extendedprice * (1 - l_discount) / l_quantity * 1.04 AS high, l_extendedprice / l_quantity * (1 - l_tax) AS low,
  CASE WHEN l_linenumber = 7 THEN 0.0 ELSE l_extendedprice / l_quantity END AS close, l_quantity - 3 AS volume FROM lineitem)"""
_SQL_FLAGS = {k: v.replace("ts IS NULL OR ", "") for k, v in quality.FLAGS.items()}
_REASONS = "concat_ws(';', " + ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in _SQL_FLAGS.items()) + ")"


@query("flt_invalid_reasons", f"WITH {_DIRTY_SQL}, r AS (SELECT minute, line, {_REASONS} AS reasons FROM dirty) SELECT * FROM r WHERE reasons <> ''")
def _invalid(spark, sf):
    return quality.invalid_rows(_dirty(spark, sf)).select("minute", "line", "reasons")


_ANY = " OR ".join(f"({v})" for v in _SQL_FLAGS.values())


@query(
    "agg_quality_audit",
    f"""WITH {GAPPY_SQL}, d AS (SELECT * FROM gappy) SELECT count(*) AS row_count, min(minute) AS start_minute, max(minute) AS end_minute,
    count(*) FILTER ({_SQL_FLAGS['null_required']}) AS null_required_count, count(*) FILTER ({_ANY}) AS invalid_row_count, count(*) FILTER (volume < 0) AS negative_volume_count,
    count(*) FILTER (volume = 0) AS zero_volume_count, CAST(0 AS BIGINT) AS duplicate_count, max(minute) - min(minute) + 1 - count(*) AS missing_minute_count,
    CAST(0 AS BIGINT) AS non_monotonic_count, false AS passed FROM d""",
)
def _audit(spark, sf):
    return quality.audit(gappy_bars(spark, sf))


@query(
    "agg_zero_runs",
    f"""WITH {DENSE_SQL}, z AS (SELECT symbol, minute, idx - row_number() OVER (ORDER BY idx) AS g FROM bars WHERE volume = 0)
    SELECT symbol, min(minute) AS start_minute, max(minute) AS end_minute, count(*) AS length FROM z GROUP BY symbol, g""",
)
def _zero_runs(spark, sf):
    return quality.zero_volume_runs(indexed(dense_bars(spark, sf)))


@query(
    "set_missing_bars",
    f"""WITH {GAPPY_SQL}, s AS (SELECT unnest(range(min(minute), max(minute) + 1)) AS minute FROM gappy)
    SELECT 'series' AS symbol, minute FROM s WHERE minute NOT IN (SELECT minute FROM gappy)""",
)
def _missing(spark, sf):
    return quality.missing_minutes(gappy_bars(spark, sf))


# --- features -----------------------------------------------------------------------------------------------------
def _family(spark, sf, name):
    return rounded(with_sheet(dense_bars(spark, sf), sheet_of(name)), nudge=1e-9)


def _with(sql: str) -> str:
    """DENSE_SQL before a query that may start with more relations."""
    body = sql.strip()
    return f"WITH {DENSE_SQL}" + (", " if not body.startswith("SELECT") else " ") + body


for _name in FAMILIES:
    QUERIES[f"feat_{_name}"] = partial(_family, name=_name)
    ORACLES[f"feat_{_name}"] = _with(sheet_of(_name).sql("bars", ("symbol", "minute")))


def _timeframe(spark, sf, name):
    return rounded(matrix.TIMEFRAME_FAMILIES[name](dense_bars(spark, sf)), nudge=1e-9)


for _name in matrix.TIMEFRAME_FAMILIES:
    QUERIES[f"feat_{_name}"] = partial(_timeframe, name=_name)
ORACLES["feat_anchored_timeframe_candle"] = _with(timeframes.candle_sql("bars", timeframes.TIMEFRAMES, timeframes.LEVELS, timeframes._candle_sheet))
ORACLES["feat_anchored_timeframe_candle_lite"] = _with(timeframes.candle_sql("bars", timeframes.LITE_TIMEFRAMES, (4,), timeframes._lite_sheet))

for _tf in (5, 15, 60, 240):

    def _resample(spark, sf, tf):
        return rounded(resampled(gappy_bars(spark, sf), tf).drop("bucket"))

    QUERIES[f"agg_resample_{_tf}"] = partial(_resample, tf=_tf)
    ORACLES[f"agg_resample_{_tf}"] = f"""WITH {GAPPY_SQL} SELECT symbol, round(arg_min(open, minute), 6) + 0 AS open, round(max(high), 6) + 0 AS high, round(min(low), 6) + 0 AS low,
      round(arg_max(close, minute), 6) + 0 AS close, round(sum(volume), 6) + 0 AS volume, (minute // {_tf} + 1) * {_tf} AS close_minute FROM gappy GROUP BY symbol, minute // {_tf}"""


@query(
    "join_asof_htf",
    f"""WITH {GAPPY_SQL}, h AS (SELECT (minute // 15 + 1) * 15 AS close_minute, max(high) AS h_high, arg_max(close, minute) AS h_close FROM gappy GROUP BY 1)
    SELECT g.symbol, g.minute, {_r('h_high', 'h_close')} FROM gappy g ASOF LEFT JOIN h ON g.minute >= h.close_minute""",
)
def _asof(spark, sf):
    from tidemark.operators.series import last_closed

    bars = gappy_bars(spark, sf)
    closed = resampled(bars, 15).select("symbol", "bucket", F.col("high").alias("h_high"), F.col("close").alias("h_close"))
    return rounded(last_closed(bars.select("symbol", "minute"), closed, 15, ["h_high", "h_close"]))


@query("feat_matrix_v3b")
def _matrix(spark, sf):
    return matrix.build(dense_bars(spark, sf), SETS["v3b"])


_RATED = sheet_of("return_path", "volatility")


@query(
    "agg_null_rates",
    f"WITH {DENSE_SQL}, f AS (WITH {_RATED.sql('bars', ('symbol', 'minute'))}) "
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) + 0 AS null_rate FROM f" for c in _RATED.outs),
)
def _null_rates(spark, sf):
    return rounded(matrix.null_rates(with_sheet(dense_bars(spark, sf), sheet_of("return_path", "volatility"))))


# --- labels -------------------------------------------------------------------------------------------------------
def _ln(a: str, b: str, s: int = 1, cost: float = 0) -> str:
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN {s} * ln({b} / {a}) * 1e4 - {cost} END"


def _label_sql(source: str, names: dict[str, tuple[str, int, float]]) -> str:
    joins = " ".join(f"LEFT JOIN {source} x{k} ON x{k}.minute = b.minute + {k}" for k in sorted({1} | {v[1] for v in names.values()}))
    cols = ", ".join(f"round({_ln('x1.open', f'x{k}.open', 1 if s == 'long' else -1, c)}, 6) + 0 AS {n}" for n, (s, k, c) in names.items())
    return f"SELECT b.symbol, b.minute, {cols} FROM {source} b {joins}"


_ENTRY = {f"target_entry_net_bps_{s}_H{h}": (s, 1 + h, 15) for s in ("long", "short") for h in lab.HORIZONS}
_EXIT = {f"target_exit_hold_delta_bps_{s}_K{k}": (s, 1 + k, 0) for s, v in lab.EXIT_LOOKAHEADS.items() for k in v}


@query("lbl_entry", f"WITH {GAPPY_SQL} {_label_sql('gappy', _ENTRY)}")
def _entry_labels(spark, sf):
    return rounded(lab.entry_labels(gappy_bars(spark, sf)))


@query("lbl_exit", f"WITH {GAPPY_SQL} {_label_sql('gappy', _EXIT)}")
def _exit_labels(spark, sf):
    return rounded(lab.exit_labels(gappy_bars(spark, sf)))


def _excursion_sql(source: str) -> str:
    per = []
    for h in lab.HORIZONS:
        w = f"OVER (ORDER BY minute RANGE BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
        per += [f"CASE WHEN count(high) {w} = {h} THEN max(high) {w} END AS up{h}", f"CASE WHEN count(high) {w} = {h} THEN min(low) {w} END AS down{h}"]
    outs = []
    for h in lab.HORIZONS:
        up, down = _ln("p1", f"up{h}"), _ln("p1", f"down{h}")
        outs += [f"round({up}, 6) + 0 AS diag_mfe_bps_long_H{h}", f"round({down}, 6) + 0 AS diag_mae_bps_long_H{h}", f"round(-({down}), 6) + 0 AS diag_mfe_bps_short_H{h}", f"round(-({up}), 6) + 0 AS diag_mae_bps_short_H{h}"]
    return f"p AS (SELECT b.symbol, b.minute, {', '.join(f'{x}' for x in per)}, max(open) OVER (ORDER BY minute RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS p1 FROM {source} b) SELECT symbol, minute, {', '.join(outs)} FROM p"


@query("lbl_mfe_mae", f"WITH {DENSE_SQL}, {_excursion_sql('bars')}")
def _excursions(spark, sf):
    return rounded(lab.excursions(dense_bars(spark, sf)))


# --- predictions by fold ------------------------------------------------------------------------------------------
def _scored(spark, sf) -> tuple[DataFrame, DataFrame, splits.Manifest]:
    """(bars, scored rows, manifest): a linear score of two returns stands for a model's prediction."""
    bars = dense_bars(spark, sf)
    n = bars.agg(F.max("minute")).first()[0] + 1
    m = splits.fractions(n)
    features = with_sheet(bars, sheet_of("return_path")).select("symbol", "minute", (F.lit(0.6) * F.col("ret_15m_bps") + F.lit(0.4) * F.col("ret_60m_bps")).alias("score"))
    target = lab.entry_labels(bars, (60,)).select("symbol", "minute", F.col("target_entry_net_bps_long_H60").alias("target"))
    out = features.join(target, ["symbol", "minute"]).withColumn("fold", splits.fold_of(F.col("minute"), m))
    return bars, out, m


def _at(k: int) -> str:
    return f"((SELECT max(minute) + 1 FROM bars) * {k} // 10)"


_FOLD = "CASE " + " ".join(f"WHEN b.minute >= {_at(4 + k)} AND b.minute < {_at(5 + k)} THEN 'fold_{k + 1:02d}'" for k in range(5)) + " END"
_SCORED = f"""{DENSE_SQL}, lags AS (SELECT *, lag(close, 15) OVER (ORDER BY minute) AS c15, lag(close, 60) OVER (ORDER BY minute) AS c60 FROM bars),
everyone AS (SELECT b.symbol, b.minute, 0.6e0 * ({_ln('b.c15', 'b.close')}) + 0.4e0 * ({_ln('b.c60', 'b.close')}) AS score,
  {_ln('x1.open', 'x61.open', 1, 15)} AS target, {_FOLD} AS fold FROM lags b LEFT JOIN bars x1 ON x1.minute = b.minute + 1 LEFT JOIN bars x61 ON x61.minute = b.minute + 61),
scored AS (SELECT * FROM everyone WHERE fold IS NOT NULL), evaled AS (SELECT * FROM scored WHERE target IS NOT NULL AND score IS NOT NULL)"""


def _evaluated(spark, sf) -> DataFrame:
    return _scored(spark, sf)[1].where("fold IS NOT NULL")


def _top_sql(q: float) -> str:
    n = met.name_of(q)
    return f"""any_value(t{n}) AS top_q{n}_threshold, count(*) FILTER (score >= t{n}) AS top_q{n}_count, avg(target) FILTER (score >= t{n}) AS top_q{n}_avg,
    quantile_cont(target, 0.5) FILTER (score >= t{n}) AS top_q{n}_median, avg(CASE WHEN target > 0 THEN 1.0 ELSE 0.0 END) FILTER (score >= t{n}) AS top_q{n}_precision_gt0"""


def _wrap(sql: str, keys: tuple[str, ...], names: list[str], ctes: str = _SCORED) -> str:
    return f"WITH {ctes}, result AS ({sql}) SELECT {', '.join(keys)}, {_r(*names)} FROM result"


_TOPS = (0.9, 0.95, 0.99)
_TOP_NAMES = [f"top_q{met.name_of(q)}_{x}" for q in _TOPS for x in ("threshold", "avg", "median", "precision_gt0")]
_QS = ", ".join(f"quantile_cont(score, {q}) OVER (PARTITION BY fold) AS t{met.name_of(q)}" for q in _TOPS)


@query(
    "agg_fold_metrics",
    _wrap(
        f"""SELECT fold, count(*) AS eval_count, avg(target) AS target_mean, quantile_cont(target, 0.5) AS target_median, avg(score) AS pred_mean,
        avg(abs(target - score)) AS mae, sqrt(avg((target - score) ** 2)) AS rmse, corr(target, score) AS corr, 1 - avg((target - score) ** 2) / var_pop(target) AS r2,
        avg(CASE WHEN target > 0 THEN 1.0 ELSE 0.0 END) AS precision_gt0, {', '.join(_top_sql(q) for q in _TOPS)} FROM (SELECT *, {_QS} FROM evaled) GROUP BY fold""",
        ("fold", "eval_count", *(f"top_q{met.name_of(q)}_count" for q in _TOPS)),
        ["target_mean", "target_median", "pred_mean", "mae", "rmse", "corr", "r2", "precision_gt0", *_TOP_NAMES],
    ),
)
def _fold_metrics(spark, sf):
    return rounded(met.prediction_metrics(_evaluated(spark, sf), "target", "score", _TOPS).drop("symbol"))


@query(
    "agg_bottomq",
    _wrap(
        """SELECT fold, count(*) FILTER (score <= a) AS bottom_q95_count, avg(target) FILTER (score <= a) AS bottom_q95_avg,
        avg(CASE WHEN target < 0 THEN 1.0 ELSE 0.0 END) FILTER (score <= a) AS bottom_q95_precision_lt0, count(*) FILTER (score <= b) AS bottom_q99_count,
        avg(target) FILTER (score <= b) AS bottom_q99_avg, avg(CASE WHEN target < 0 THEN 1.0 ELSE 0.0 END) FILTER (score <= b) AS bottom_q99_precision_lt0
        FROM (SELECT *, quantile_cont(score, 0.05) OVER (PARTITION BY fold) AS a, quantile_cont(score, 0.01) OVER (PARTITION BY fold) AS b FROM evaled) GROUP BY fold""",
        ("fold", "bottom_q95_count", "bottom_q99_count"),
        ["bottom_q95_avg", "bottom_q95_precision_lt0", "bottom_q99_avg", "bottom_q99_precision_lt0"],
    ),
)
def _bottom(spark, sf):
    return rounded(met.bottom_metrics(_evaluated(spark, sf), "target", "score").drop("symbol"))


@query(
    "agg_deciles",
    _wrap(
        """SELECT fold, decile, count(*) AS count, avg(target) AS avg_target, quantile_cont(target, 0.5) AS median_target, avg(CASE WHEN target > 0 THEN 1.0 ELSE 0.0 END) AS precision_gt0, avg(score) AS avg_pred
        FROM (SELECT *, CAST(greatest(1, ceil((row_number() OVER (PARTITION BY fold ORDER BY score, minute) - 1) * 10 / (count(*) OVER (PARTITION BY fold) - 1))) AS INTEGER) AS decile FROM evaled) GROUP BY fold, decile""",
        ("fold", "decile", "count"), ["avg_target", "median_target", "precision_gt0", "avg_pred"],
    ),
)
def _deciles(spark, sf):
    return rounded(met.deciles(_evaluated(spark, sf), "target", "score", "minute").drop("symbol"))


def _average_rank(c: str) -> str:
    return f"rank() OVER (PARTITION BY fold ORDER BY {c}) + (count(*) OVER (PARTITION BY fold, {c}) - 1) / 2.0"


@query("agg_spearman", _wrap(f"SELECT fold, corr(a, b) AS spearman FROM (SELECT fold, {_average_rank('target')} AS a, {_average_rank('score')} AS b FROM evaled) GROUP BY fold", ("fold",), ["spearman"]))
def _spearman(spark, sf):
    return rounded(met.rank_correlation(_evaluated(spark, sf), "target", "score").drop("symbol"))


# --- splits -------------------------------------------------------------------------------------------------------
def _roles_sql() -> str:
    parts = []
    for k in range(5):
        start, end = _at(4 + k), f"{_at(5 + k)} - 1"
        parts.append(f"SELECT 'fold_{k + 1:02d}' AS fold, 'eval' AS role, minute FROM bars WHERE minute BETWEEN {start} AND {end}")
        parts.append(f"SELECT 'fold_{k + 1:02d}' AS fold, 'train' AS role, minute FROM bars WHERE minute < {_at(4)} AND NOT (minute <= {end} AND minute + 121 >= {start})")
    return " UNION ALL ".join(parts)


@query("split_purged_masks", f"WITH {DENSE_SQL} SELECT fold, role, count(*) AS rows, min(minute) AS first_minute, max(minute) AS last_minute FROM ({_roles_sql()}) GROUP BY fold, role")
def _purged(spark, sf):
    bars, _, m = _scored(spark, sf)
    return splits.roles(bars.select("minute"), m, 120).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("rows"), F.min("minute").alias("first_minute"), F.max("minute").alias("last_minute"))


def _walk_sql() -> str:
    parts = []
    for k in range(5):
        start, name = _at(4 + k), f"fold_{k + 1:02d}"
        for mode, where in (("fixed", f"minute < {_at(4)}"), ("expanding", "true"), ("rolling", f"minute >= {start} - 2000")):
            parts.append(f"SELECT '{name}' AS fold, '{mode}' AS mode, count(*) AS rows, min(minute) AS first_minute, max(minute) AS last_minute FROM bars WHERE {where} AND minute + 121 < {start}")
        parts.append(f"SELECT '{name}' AS fold, 'history' AS mode, count(*) AS rows, min(minute) AS first_minute, max(minute) AS last_minute FROM bars WHERE minute >= {start} - 1440 AND minute < {start}")
    return " UNION ALL ".join(parts)


@query("split_walk_forward", f"WITH {DENSE_SQL} {_walk_sql()}")
def _walk(spark, sf):
    bars, _, m = _scored(spark, sf)
    minute = F.col("minute")
    tags = []
    for f in m.folds:
        for mode in ("fixed", "expanding", "rolling"):
            tags.append(F.when(splits.walk_forward_train(minute, m, f, mode, 120, 2000), F.struct(F.lit(f.name).alias("fold"), F.lit(mode).alias("mode"))))
        tags.append(F.when(splits.history(minute, f, 1440), F.struct(F.lit(f.name).alias("fold"), F.lit("history").alias("mode"))))
    rows = bars.select("minute", F.explode(F.array_compact(F.array(*tags))).alias("t")).select("minute", "t.*")
    return rows.groupBy("fold", "mode").agg(F.count(F.lit(1)).alias("rows"), F.min("minute").alias("first_minute"), F.max("minute").alias("last_minute"))


def _fold_table_sql() -> str:
    return f"""WITH {DENSE_SQL}, {GAPPY_SQL}, rows AS (SELECT 'dense' AS symbol, minute FROM bars UNION ALL SELECT 'gappy', minute FROM gappy),
    extents AS (SELECT symbol, min(minute) AS first, max(minute) AS last, CASE symbol WHEN 'dense' THEN 5 ELSE 7 END AS k FROM rows GROUP BY symbol),
    cuts AS (SELECT symbol, first, k, unnest(range(0, k)) AS i, last - first + 1 AS n FROM extents),
    folds AS (SELECT symbol, 'fold_0' || CAST(i + 1 AS VARCHAR) AS fold, first, first + n * (4 * k) // (10 * k) - 1 AS trained, first + n * (4 * k + 5 * i) // (10 * k) AS a, first + n * (4 * k + 5 * i + 5) // (10 * k) - 1 AS b FROM cuts),
    tagged AS (SELECT f.symbol, f.fold, r.minute, unnest(CASE WHEN r.minute BETWEEN a AND b THEN ['eval'] ELSE list_concat(
      CASE WHEN r.minute <= trained AND NOT (r.minute <= b AND r.minute + 121 >= a) AND NOT (r.minute > b AND r.minute <= b + 30) THEN ['train'] ELSE [] END,
      CASE WHEN r.minute <= trained AND r.minute + 121 < a THEN ['fixed'] ELSE [] END, CASE WHEN r.minute + 121 < a THEN ['expanding'] ELSE [] END,
      CASE WHEN r.minute >= a - 2000 AND r.minute + 121 < a THEN ['rolling'] ELSE [] END, CASE WHEN r.minute >= a - 1440 AND r.minute < a THEN ['history'] ELSE [] END) END) AS role
      FROM rows r JOIN folds f ON r.symbol = f.symbol)
    SELECT symbol, fold, role, count(*) AS rows, min(minute) AS first_minute, max(minute) AS last_minute FROM tagged GROUP BY symbol, fold, role"""


@query("split_fold_table", _fold_table_sql())
def _fold_table(spark, sf):
    """Two symbols of their own extents, with five and with seven folds."""
    each = [df.select(F.lit(s).alias("symbol"), "minute") for s, df in (("dense", dense_bars(spark, sf)), ("gappy", gappy_bars(spark, sf)))]
    rows = each[0].unionByName(each[1])
    extents = rows.groupBy("symbol").agg(F.min("minute").alias("first"), F.max("minute").alias("last")).withColumn("folds", F.when(F.col("symbol") == "dense", 5).otherwise(7))
    folds = fold_tables.checked(fold_tables.even(extents, 30))
    ranges = fold_tables.evaluated(folds)
    for more in (fold_tables.purged(folds, 120), fold_tables.walk_forward(folds, 120, 2000), fold_tables.history(folds, 1440)):
        ranges = ranges.unionByName(more)
    return fold_tables.met(rows, ranges).groupBy("symbol", "fold", "role").agg(F.count(F.lit(1)).alias("rows"), F.min("minute").alias("first_minute"), F.max("minute").alias("last_minute"))


# --- thresholds and trades ----------------------------------------------------------------------------------------
_WINDOW, _Q, _LEAST = 720, 0.9, 120


def _threshold_sql(partition: str, source: str = "scored") -> str:
    w = f"OVER ({partition} ORDER BY minute RANGE BETWEEN {_WINDOW} PRECEDING AND 1 PRECEDING)"
    return f"SELECT fold, minute, score, CASE WHEN count(score) {w} >= {_LEAST} THEN quantile_cont(score, {_Q}) {w} END AS rolling_thr, count(score) {w} AS history_count FROM {source}"


@query("win_rolling_quantile_fold_local", _wrap(_threshold_sql("PARTITION BY fold"), ("fold", "minute", "history_count"), ["score", "rolling_thr"]))
def _rolling_local(spark, sf):
    rows = _evaluated(spark, sf).select("symbol", "fold", "minute", "score")
    return rounded(simulate.rolling_quantile(rows, _WINDOW, _Q, _LEAST).drop("symbol"))


@query("win_rolling_quantile_continuous", _wrap(_threshold_sql(""), ("fold", "minute", "history_count"), ["score", "rolling_thr"]))
def _rolling_continuous(spark, sf):
    rows = _evaluated(spark, sf).select("symbol", "fold", "minute", "score")
    return rounded(simulate.rolling_quantile(rows, _WINDOW, _Q, _LEAST, ("symbol",)).drop("symbol"))


_HISTORY = (
    "past AS ("
    + " UNION ALL ".join(f"SELECT 'fold_{k + 1:02d}' AS fold, minute, score, false AS is_eval FROM everyone WHERE minute >= {_at(4 + k)} - 1440 AND minute < {_at(4 + k)}" for k in range(5))
    + "), both_sets AS (SELECT fold, minute, score, true AS is_eval FROM scored UNION ALL SELECT * FROM past)"
)


def _past(scored: DataFrame, m: splits.Manifest) -> DataFrame:
    tags = [F.when(splits.history(F.col("minute"), f, 1440), F.lit(f.name)) for f in m.folds]
    return scored.select("symbol", "minute", "score", F.explode(F.array_compact(F.array(*tags))).alias("fold"))


@query(
    "win_rolling_quantile_history",
    _wrap("SELECT * FROM (" + _threshold_sql("PARTITION BY fold", "both_sets").replace("SELECT fold", "SELECT is_eval, fold", 1) + ") WHERE is_eval", ("fold", "minute", "history_count"), ["score", "rolling_thr"], _SCORED + ", " + _HISTORY),
)
def _rolling_history(spark, sf):
    _, scored, m = _scored(spark, sf)
    rows = simulate.with_history(scored.where("fold IS NOT NULL").select("symbol", "fold", "minute", "score"), _past(scored, m))
    return rounded(simulate.rolling_quantile(rows, _WINDOW, _Q, _LEAST).where("is_eval").drop("is_eval", "symbol"))


@query("agg_history_threshold", _wrap(f"SELECT fold, count(score) AS n, greatest(quantile_cont(score, {_Q}), 0e0) AS threshold FROM past GROUP BY fold", ("fold", "n"), ["threshold"], _SCORED + ", " + _HISTORY))
def _history_threshold(spark, sf):
    _, scored, m = _scored(spark, sf)
    return rounded(simulate.history_threshold(_past(scored, m), _Q, 0.0, 100).drop("symbol"))


def _ruled(spark, sf, threshold: float = 20.0) -> DataFrame:
    bars, scored, _ = _scored(spark, sf)
    rows = scored.where("fold IS NOT NULL").join(simulate.path_stats(bars, HOLD), ["symbol", "minute"])
    return rows.withColumn("skip_reason", simulate.entry_rule(F.col("score"), F.lit(threshold)))


def _episodes(spark, sf, threshold: float = 20.0, side: str = "long") -> DataFrame:
    return simulate.fixed_hold_episodes(simulate.entered(_ruled(spark, sf, threshold), HOLD, COOLDOWN), HOLD, side)


def _sim_sql(threshold: float | str, name: str, source: str = "scored", hold: int = HOLD) -> str:
    """The greedy picks of each fold: the next candidate at least hold + 1 + cooldown minutes after the last."""
    return f"""cand_{name} AS (SELECT s.fold, s.minute, s.score, e.open AS p, x.open AS x,
      (SELECT max(high) FROM bars h WHERE h.minute BETWEEN s.minute + 1 AND s.minute + {hold + 1}) AS up, (SELECT min(low) FROM bars h WHERE h.minute BETWEEN s.minute + 1 AND s.minute + {hold + 1}) AS down
      FROM {source} s JOIN bars e ON e.minute = s.minute + 1 JOIN bars x ON x.minute = s.minute + {hold + 1} WHERE s.score > {threshold}),
    pick_{name}(fold, minute) AS (SELECT fold, min(minute) FROM cand_{name} GROUP BY fold
      UNION ALL SELECT p.fold, (SELECT min(c.minute) FROM cand_{name} c WHERE c.fold = p.fold AND c.minute >= p.minute + {1 + hold + COOLDOWN}) FROM pick_{name} p WHERE p.minute IS NOT NULL),
    eps_{name} AS (SELECT c.*, ln(x / p) * 1e4 AS gross FROM cand_{name} c JOIN pick_{name} k ON k.fold = c.fold AND k.minute = c.minute)"""


_EPISODE_SQL = f"""SELECT fold, strftime(make_timestamp(minute * 60000000), 'fixed_long_H{HOLD}_%Y%m%dT%H%M%SZ') AS episode_id, minute AS entry_minute, minute + {HOLD + 1} AS exit_exec_minute,
  score AS entry_score, p AS entry_price, x AS exit_price, gross AS gross_pl_bps, gross - 15 AS net_pl_bps, ln(up / p) * 1e4 AS mfe_bps, ln(down / p) * 1e4 AS mae_bps, ln(up / p) * 1e4 - gross AS giveback_bps FROM eps_a"""
_EPISODE_NAMES = ["entry_score", "entry_price", "exit_price", "gross_pl_bps", "net_pl_bps", "mfe_bps", "mae_bps", "giveback_bps"]


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("sim_fixed_hold", _recursive(_wrap(_EPISODE_SQL, ("fold", "episode_id", "entry_minute", "exit_exec_minute"), _EPISODE_NAMES, _SCORED + ", " + _sim_sql(20.0, "a"))))
def _sim(spark, sf):
    return rounded(_episodes(spark, sf).select("fold", "episode_id", "entry_minute", "exit_exec_minute", *_EPISODE_NAMES))


@query(
    "sim_fixed_hold_short",
    _recursive(_wrap(
        _EPISODE_SQL.replace("fixed_long", "fixed_short").replace("gross AS gross_pl_bps, gross - 15 AS net_pl_bps, ln(up / p) * 1e4 AS mfe_bps, ln(down / p) * 1e4 AS mae_bps, ln(up / p) * 1e4 - gross AS giveback_bps",
        "-gross AS gross_pl_bps, -gross - 15 AS net_pl_bps, -ln(down / p) * 1e4 AS mfe_bps, -ln(up / p) * 1e4 AS mae_bps, -ln(down / p) * 1e4 + gross AS giveback_bps"),
        ("fold", "episode_id", "entry_minute", "exit_exec_minute"), _EPISODE_NAMES, _SCORED + ", " + _sim_sql(20.0, "a"))),
)
def _sim_short(spark, sf):
    return rounded(_episodes(spark, sf, side="short").select("fold", "episode_id", "entry_minute", "exit_exec_minute", *_EPISODE_NAMES))


@query(
    "agg_skip_reasons",
    _recursive(f"""WITH {_SCORED}, {_sim_sql(20.0, 'a')}, d AS (SELECT s.fold, CASE WHEN k.minute = s.minute THEN 'entered' WHEN k.minute IS NOT NULL THEN 'cooldown'
      WHEN s.score IS NULL OR NOT s.score > 20 THEN 'below_threshold' ELSE 'missing_price_path' END AS decision FROM scored s
      LEFT JOIN pick_a k ON k.fold = s.fold AND s.minute >= k.minute AND s.minute < k.minute + {1 + HOLD + COOLDOWN})
    SELECT fold, decision, count(*) AS rows FROM d GROUP BY fold, decision"""),
)
def _skips(spark, sf):
    return simulate.skip_counts(simulate.fixed_hold(_ruled(spark, sf), HOLD, COOLDOWN)).drop("symbol")


def _factor(net: str, none: str = "NULL") -> str:
    wins, losses = f"coalesce(sum({net}) FILTER ({net} > 0), 0)", f"coalesce(-sum({net}) FILTER ({net} < 0), 0)"
    return f"CASE WHEN {losses} > 0 THEN {wins} / {losses} WHEN {wins} > 0 THEN CAST('Infinity' AS DOUBLE) ELSE {none} END"


_METRIC_SQL = f"""SELECT f.fold, count(gross) AS episode_count, coalesce(sum(gross), 0) AS gross_pl_bps_sum, coalesce(sum(gross - 15), 0) AS net_pl_bps_sum, avg(gross - 15) AS avg_net_pl_bps,
  quantile_cont(gross - 15, 0.5) AS median_net_pl_bps, avg(CASE WHEN gross > 15 THEN 1.0 WHEN gross IS NOT NULL THEN 0.0 END) AS win_rate, avg(gross - 15) FILTER (gross > 15) AS avg_win_bps,
  avg(gross - 15) FILTER (gross < 15) AS avg_loss_bps, coalesce(CAST(count(gross) AS DOUBLE) / greatest(1, count(DISTINCT minute // 1440)), 0) AS round_trips_per_day,
  {_factor('(gross - 15)')} AS profit_factor, CASE WHEN count(gross) > 0 THEN {HOLD}e0 END AS avg_hold_minutes, CASE WHEN count(gross) > 0 THEN {HOLD}e0 END AS median_hold_minutes, count(gross) * 15e0 AS fee_paid_bps,
  avg(ln(up / p) * 1e4) AS avg_mfe_bps, avg(ln(down / p) * 1e4) AS avg_mae_bps, avg(ln(up / p) * 1e4 - gross) AS avg_giveback_bps
  FROM (SELECT DISTINCT fold FROM scored) f LEFT JOIN eps_a e ON e.fold = f.fold GROUP BY f.fold"""
_METRIC_NAMES = [
    "gross_pl_bps_sum", "net_pl_bps_sum", "avg_net_pl_bps", "median_net_pl_bps", "win_rate", "avg_win_bps", "avg_loss_bps", "round_trips_per_day", "profit_factor", "avg_hold_minutes",
    "median_hold_minutes", "fee_paid_bps", "avg_mfe_bps", "avg_mae_bps", "avg_giveback_bps",
]


@query("agg_episode_metrics", _recursive(_wrap(_METRIC_SQL, ("fold", "episode_count"), _METRIC_NAMES, _SCORED + ", " + _sim_sql(20.0, "a"))))
def _episode_metrics(spark, sf):
    out = met.episode_metrics(_episodes(spark, sf), _evaluated(spark, sf))
    return rounded(out.select("fold", "episode_count", *_METRIC_NAMES))


_SIDES = ("gross", "net", "mfe", "mae", "giveback")
_VALUE_SQL = {"gross": "{0}.gross", "net": "{0}.gross - 15", "mfe": "ln({0}.up / {0}.p) * 1e4", "mae": "ln({0}.down / {0}.p) * 1e4", "giveback": "ln({0}.up / {0}.p) * 1e4 - {0}.gross"}
_OVERLAP = f"""{_SCORED}, {_sim_sql(20.0, 'a')}, {_sim_sql(30.0, 'b')}, joined AS (SELECT coalesce(a.fold, b.fold) AS fold, coalesce(a.minute, b.minute) AS entry_minute,
  a.gross - 15 AS left_value, b.gross - 15 AS right_value, CASE WHEN a.fold IS NOT NULL AND b.fold IS NOT NULL THEN 'both' WHEN a.fold IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS grp,
  {', '.join(f"CASE WHEN a.fold IS NULL THEN {_VALUE_SQL[v].format('b')} ELSE {_VALUE_SQL[v].format('a')} END AS {v}" for v in _SIDES)}
  FROM eps_a a FULL OUTER JOIN eps_b b ON a.fold = b.fold AND a.minute = b.minute)"""


def _overlapped(spark, sf) -> DataFrame:
    return met.overlap(_episodes(spark, sf), _episodes(spark, sf, 30.0))


@query("join_overlap_outer", _recursive(_wrap("SELECT * FROM joined", ("fold", "entry_minute", "grp"), ["left_value", "right_value", *_SIDES], _OVERLAP)))
def _overlap(spark, sf):
    named = [F.col(f"canonical_{v}_pl_bps" if v in ("gross", "net") else f"canonical_{v}_bps").alias(v) for v in _SIDES]
    return rounded(_overlapped(spark, sf).select("fold", "entry_minute", F.col("group").alias("grp"), F.col("left_net_pl_bps").alias("left_value"), F.col("right_net_pl_bps").alias("right_value"), *named))


_GROUP_STATS = f"""count(j.net) AS episode_count, coalesce(sum(j.gross), 0) AS gross_pl_bps_sum, coalesce(sum(j.net), 0) AS net_pl_bps_sum, avg(j.net) AS avg_net_pl_bps, quantile_cont(j.net, 0.5) AS median_net_pl_bps,
  avg(CASE WHEN j.net > 0 THEN 1.0 WHEN j.net IS NOT NULL THEN 0.0 END) AS win_rate, avg(j.net) FILTER (j.net > 0) AS avg_win_bps, avg(j.net) FILTER (j.net < 0) AS avg_loss_bps,
  {_factor('j.net', '0e0')} AS profit_factor, avg(j.mfe) AS avg_mfe_bps, avg(j.mae) AS avg_mae_bps, avg(j.giveback) AS avg_giveback_bps"""
_GROUP_NAMES = ["gross_pl_bps_sum", "net_pl_bps_sum", "avg_net_pl_bps", "median_net_pl_bps", "win_rate", "avg_win_bps", "avg_loss_bps", "profit_factor", "avg_mfe_bps", "avg_mae_bps", "avg_giveback_bps"]


@query(
    "agg_overlap_groups",
    _recursive(_wrap(
        f"""SELECT g.fold, g.grp AS overlap_group, {_GROUP_STATS} FROM (SELECT DISTINCT fold, unnest(['both', 'left_only', 'right_only', 'all_union']) AS grp FROM joined) g
        LEFT JOIN (SELECT * FROM joined UNION ALL BY NAME SELECT * REPLACE ('all_union' AS grp) FROM joined) j ON j.fold = g.fold AND j.grp = g.grp GROUP BY g.fold, g.grp""",
        ("fold", "overlap_group", "episode_count"), _GROUP_NAMES, _OVERLAP,
    )),
)
def _overlap_groups(spark, sf):
    return rounded(met.overlap_groups(_overlapped(spark, sf)).drop("symbol"))


@query(
    "agg_overlap_total",
    _recursive(_wrap(
        f"""SELECT g.grp AS overlap_group, {_GROUP_STATS} FROM (SELECT unnest(['both', 'left_only', 'right_only']) AS grp) g LEFT JOIN joined j ON j.grp = g.grp GROUP BY g.grp""",
        ("overlap_group", "episode_count"), _GROUP_NAMES, _OVERLAP,
    )),
)
def _overlap_total(spark, sf):
    return rounded(met.overlap_groups(_overlapped(spark, sf), ()))


@query(
    "agg_jaccard",
    _recursive(_wrap(
        """SELECT count(*) FILTER (grp = 'both') AS both_count, count(*) FILTER (grp = 'left_only') AS left_only_count, count(*) FILTER (grp = 'right_only') AS right_only_count,
        CAST(count(*) FILTER (grp = 'both') AS DOUBLE) / count(*) AS jaccard, CAST(count(*) FILTER (grp = 'both') AS DOUBLE) / count(left_value) AS left_overlap_rate,
        CAST(count(*) FILTER (grp = 'both') AS DOUBLE) / count(right_value) AS right_overlap_rate, sum(left_value) AS left_net_sum, sum(right_value) AS right_net_sum,
        sum(left_value) FILTER (grp = 'both') AS both_left_net_sum, sum(right_value) FILTER (grp = 'both') AS both_right_net_sum,
        sum(left_value) FILTER (grp = 'left_only') AS left_only_net_sum, sum(right_value) FILTER (grp = 'right_only') AS right_only_net_sum FROM joined""",
        ("both_count", "left_only_count", "right_only_count"),
        ["jaccard", "left_overlap_rate", "right_overlap_rate", "left_net_sum", "right_net_sum", "both_left_net_sum", "both_right_net_sum", "left_only_net_sum", "right_only_net_sum"], _OVERLAP,
    )),
)
def _jaccard(spark, sf):
    return rounded(met.jaccard(_overlapped(spark, sf)))


def _positions(spark, sf) -> tuple[DataFrame, DataFrame]:
    bars, scored, _ = _scored(spark, sf)
    entries = scored.where("fold IS NOT NULL AND score > 60").where(F.col("minute") % 5 == 0)
    return entries, simulate.exit_positions(bars, entries, scored, 5, 60, 30)


_POSITION_NAMES = ["entry_score", "current_score", "score_decay", "unrealized_pl_bps", "mfe_since_entry_bps", "mae_since_entry_bps", "giveback_from_mfe_bps", "target_exit_hold_delta_bps"]


@query(
    "ds_exit_positions",
    _wrap(
        """SELECT s.fold, s.minute AS entry_minute, s.minute + a.age AS current_minute, a.age AS age_minutes, s.score AS entry_score, c.score AS current_score, s.score - c.score AS score_decay,
        ln(n.close / e.open) * 1e4 AS unrealized_pl_bps, ln(h.up / e.open) * 1e4 AS mfe_since_entry_bps, ln(h.down / e.open) * 1e4 AS mae_since_entry_bps,
        ln(h.up / e.open) * 1e4 - ln(n.close / e.open) * 1e4 AS giveback_from_mfe_bps, ln(l.open / x.open) * 1e4 AS target_exit_hold_delta_bps
        FROM scored s CROSS JOIN (SELECT unnest(range(5, 61, 5)) AS age) a JOIN bars e ON e.minute = s.minute + 1 JOIN bars n ON n.minute = s.minute + a.age JOIN bars x ON x.minute = s.minute + a.age + 1
        JOIN bars l ON l.minute = s.minute + a.age + 31 LEFT JOIN everyone c ON c.minute = s.minute + a.age
        JOIN LATERAL (SELECT max(high) AS up, min(low) AS down FROM bars b WHERE b.minute BETWEEN s.minute + 1 AND s.minute + a.age) h ON true WHERE s.score > 60 AND s.minute % 5 = 0""",
        ("fold", "entry_minute", "current_minute", "age_minutes"), _POSITION_NAMES,
    ),
)
def _exit_positions(spark, sf):
    out = _positions(spark, sf)[1]
    return rounded(out.select("fold", "entry_minute", "current_minute", F.col("age_minutes").cast("long").alias("age_minutes"), *_POSITION_NAMES))


@query("sim_episode")
def _model_exit(spark, sf):
    entries, states = _positions(spark, sf)
    states = states.withColumn("pred", F.col("current_score") - 20)
    rows = entries.select("symbol", "fold", "minute", "score", F.lit(None).cast("string").alias("skip_reason"))
    return simulate.model_exit_episodes(rows, states, 2, 50.0, 60, COOLDOWN)


# --- research -----------------------------------------------------------------------------------------------------
@query(
    "proto_cycles",
    """SELECT strftime(t, 'test_%Y%m') AS cycle_id, CASE WHEN k = 0 THEN 'test' ELSE 'valid' END AS role, CASE WHEN k = 0 THEN 'test' ELSE format('valid_m{:02d}', 4 - k) END AS name,
    CAST(t - to_months(CAST(k AS INTEGER)) AS DATE) AS start_month, CAST(t - to_months(CAST(k AS INTEGER) - 1) AS DATE) AS end_month
    FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)) + INTERVAL 3 MONTH, date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS t FROM orders), (SELECT unnest(range(0, 4)) AS k)""",
)
def _cycles(spark, sf):
    span = spark.read.parquet(f"{sf}/orders.parquet").agg(F.date_format(F.add_months(F.min("o_orderdate"), 3), "yyyy-MM"), F.date_format(F.max("o_orderdate"), "yyyy-MM")).first()
    return research.cycles(spark, span[0], span[1])


def _monthly(spark, sf) -> DataFrame:
    """Monthly results of priorities as if they were policies: (cycle_id, policy, policy_index, fold, net_pl_bps_sum, episode_count)."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    order = F.substring("o_orderpriority", 1, 1).cast("int")
    policy = F.when(order == 1, "all_full").otherwise(F.concat(F.lit("all_minus_"), F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]+", ""))))
    return o.groupBy(F.date_format("o_orderdate", "yyyy").alias("cycle_id"), policy.alias("policy"), order.alias("policy_index"), F.date_format("o_orderdate", "MM").alias("fold")).agg(
        F.sum(F.col("o_totalprice") - 150000).alias("net_pl_bps_sum"), F.count(F.lit(1)).alias("episode_count")
    )


_MONTHLY = """monthly AS (SELECT strftime(o_orderdate, '%Y') AS cycle_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'all_full' ELSE 'all_minus_' || lower(regexp_replace(o_orderpriority, '[^A-Za-z]+', '', 'g')) END AS policy,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS policy_index, strftime(o_orderdate, '%m') AS fold, sum(o_totalprice - 150000) AS net, count(*) AS n FROM orders GROUP BY 1, 2, 3, 4),
candidates AS (SELECT cycle_id, policy, policy_index, total + 0.5 * worst + 0.25 * median AS selector_raw_score, total AS selector_total_net_pl_bps, worst AS selector_worst_fold_net_pl_bps, median AS selector_median_fold_net_pl_bps,
  selector_total_episode_count, selector_active_fold_count, selector_failed_constraints, total + 0.5 * worst + 0.25 * median - 1e6 * failures AS robust_score FROM (
  SELECT cycle_id, policy, policy_index, sum(net) AS total, min(net) AS worst, quantile_cont(net, 0.5) AS median, CAST(sum(n) AS BIGINT) AS selector_total_episode_count, count(*) FILTER (n > 0) AS selector_active_fold_count,
  CASE WHEN min(net) < -500000 THEN 'max_worst_fold_loss_bps' ELSE '' END AS selector_failed_constraints, CASE WHEN min(net) < -500000 THEN 1 ELSE 0 END AS failures FROM monthly GROUP BY 1, 2, 3)),
deltas AS (SELECT c.cycle_id, c.policy, split_part(c.policy, '_minus_', 2) AS family, c.robust_score, f.robust_score AS full_score, c.robust_score - f.robust_score AS delta
  FROM candidates c JOIN candidates f ON f.cycle_id = c.cycle_id AND f.policy = 'all_full' WHERE c.policy <> 'all_full')"""


def _candidates(spark, sf) -> DataFrame:
    return research.selector(_monthly(spark, sf), ("cycle_id", "policy", "policy_index"), 1, 1, -500000.0)


def _two(sql: str) -> str:
    return f"WITH {_MONTHLY} {sql}"


@query(
    "proto_selector",
    _two("""SELECT cycle_id, policy, policy_index, selector_total_episode_count, selector_active_fold_count, selector_failed_constraints, round(selector_total_net_pl_bps, 5) + 0 AS selector_total_net_pl_bps,
    round(selector_worst_fold_net_pl_bps, 5) + 0 AS selector_worst_fold_net_pl_bps, round(selector_median_fold_net_pl_bps, 5) + 0 AS selector_median_fold_net_pl_bps, round(selector_raw_score, 5) + 0 AS selector_raw_score, round(robust_score, 5) + 0 AS robust_score FROM candidates"""),
)
def _selector(spark, sf):
    return rounded(_candidates(spark, sf), 5)


@query("proto_chosen", _two("SELECT cycle_id, arg_max(policy, robust_score) AS policy, round(max(robust_score), 5) + 0 AS robust_score FROM candidates GROUP BY cycle_id"))
def _chosen(spark, sf):
    return rounded(research.chosen(_candidates(spark, sf)), 5)


@query("proto_lofo_deltas", _two("SELECT cycle_id, policy, family, round(robust_score, 5) + 0 AS robust_score, round(full_score, 5) + 0 AS full_score, round(delta, 5) + 0 AS delta FROM deltas"))
def _deltas(spark, sf):
    return rounded(research.ablation_deltas(_candidates(spark, sf)), 5)


@query("proto_combined_drop", _two("SELECT cycle_id, string_agg(family, ',' ORDER BY delta DESC, family) AS drop_families, count(*) AS drop_family_count FROM deltas WHERE delta > 0 GROUP BY cycle_id"))
def _combined(spark, sf):
    return research.combined_drops(research.ablation_deltas(_candidates(spark, sf))).withColumn("drop_families", F.array_join("drop_families", ","))


_GRID = f"""{_SCORED}, grid AS (SELECT unnest(range(0, 180, 5)) AS t), tagged AS (SELECT 'thr_' || t || '|' || fold AS fold, minute, score, CAST(t AS DOUBLE) AS thr FROM scored, grid WHERE score > t),
  every_fold AS (SELECT DISTINCT 'thr_' || t || '|' || fold AS fold FROM scored, grid), {_sim_sql("s.thr", "a", "tagged")}"""


@query("grid_sweep", _recursive(_wrap("SELECT split_part(fold, '|', 1) AS params, split_part(fold, '|', 2) AS fold, * EXCLUDE (fold) FROM (" + _METRIC_SQL.replace("(SELECT DISTINCT fold FROM scored)", "every_fold") + ")", ("params", "fold", "episode_count"), _METRIC_NAMES, _GRID)))
def _sweep(spark, sf):
    bars, scored, _ = _scored(spark, sf)
    grid = spark.createDataFrame([(f"thr_{t}", float(t)) for t in range(0, 180, 5)], "params string, threshold double")
    out = research.sweep(scored.where("fold IS NOT NULL"), simulate.path_stats(bars, HOLD), grid, HOLD, COOLDOWN)
    return rounded(out.select("params", "fold", "episode_count", *_METRIC_NAMES))


_REPLAY = f"""{_SCORED}, {_HISTORY}, thr AS (SELECT fold, greatest(quantile_cont(score, 0.95), 0e0) AS thr FROM past GROUP BY fold HAVING count(score) >= 100),
  ruled AS (SELECT scored.*, thr FROM scored JOIN thr ON thr.fold = scored.fold), {_sim_sql("s.thr", "a", "ruled")}"""


@query("proto_replay", _recursive(_wrap(_EPISODE_SQL, ("fold", "episode_id", "entry_minute", "exit_exec_minute"), _EPISODE_NAMES, _REPLAY)))
def _replay(spark, sf):
    bars, scored, m = _scored(spark, sf)
    out = research.replay(scored.where("fold IS NOT NULL"), _past(scored, m), simulate.path_stats(bars, HOLD), 0.95, 0.0, 100, HOLD, COOLDOWN)
    return rounded(out.select("fold", "episode_id", "entry_minute", "exit_exec_minute", *_EPISODE_NAMES))


@query("topk_recent_rows", _wrap("SELECT fold, minute, score FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY minute DESC) AS k FROM scored) WHERE k <= 100", ("fold", "minute"), ["score"]))
def _recent(spark, sf):
    return rounded(research.recent(_evaluated(spark, sf).select("symbol", "fold", "minute", "score"), 100).drop("symbol"))


@query("agg_label_summary", f"""WITH {GAPPY_SQL}, l AS ({_label_sql('gappy', _ENTRY)}), u AS ({' UNION ALL '.join(f"SELECT '{n}' AS label, {n} AS value FROM l" for n in _ENTRY)})
    SELECT label, count(value) AS non_null, count(*) - count(value) AS null_count, round(avg(value), 4) + 0 AS mean, round(quantile_cont(value, 0.05), 4) + 0 AS p05, round(quantile_cont(value, 0.95), 4) + 0 AS p95 FROM u GROUP BY label""")  # fmt: skip
def _label_summary(spark, sf):
    return rounded(matrix.label_summary(lab.entry_labels(gappy_bars(spark, sf))), 4)


#: The trees of the registered queries: the surveyed settings, but for their number and rate, which are 1,000 and 0.03.
TREES = {"trees": 8, "leaves": 31, "rate": 0.1, "least_rows": 100, "l2": 1.0, "column_share": 0.8}


def learnable(spark, sf, families: tuple[str, ...], work: Work) -> tuple[DataFrame, DataFrame, splits.Manifest]:
    """(bars, features and target as a table, manifest)."""
    bars, scored, m = _scored(spark, sf)
    return bars, work.write(matrix.build(models.labelled(bars, scored, "target"), families, ("target",)), distinct=True), m


@query("ml_gbt_oof")
def _oof(spark, sf):
    """Predictions of each fold by trees over all features of the set v1, learned from its purged training rows."""
    with Work(spark, "gbt_oof") as work:
        _, df, m = learnable(spark, sf, SETS["v1"], work)
        return kept(models.out_of_fold(df, models.feature_columns(df, ("minute", "target")), "target", m, 60, **TREES), "gbt_oof")


_STEPS = {"fast": ("ret_15m_bps", 2000), "slow": ("ret_60m_bps", 2000)}
_STEP_SQL = {"fast": ("c15", 2000), "slow": ("c60", 2000)}
_FIRST_SPLIT = f"""{_SCORED}, steps AS (SELECT b.minute, e.target AS y, {', '.join(f"CASE WHEN {c} IS NOT NULL THEN greatest(-8, least(8, round(({_ln('b.' + c, 'b.close')}) / {k}))) END AS {n}" for n, (c, k) in _STEP_SQL.items())}
  FROM lags b JOIN everyone e ON e.minute = b.minute WHERE e.target IS NOT NULL),
folds AS ({' UNION ALL '.join(f"SELECT 'fold_{k + 1:02d}' AS fold, {_at(4 + k)} AS start" for k in range(5))}),
train AS (SELECT fold, minute, y - avg(y) OVER (PARTITION BY fold) AS r, fast, slow FROM steps JOIN folds ON minute + 61 < start),
any_train AS (SELECT * FROM steps WHERE minute + 61 < (SELECT max(start) FROM folds)),
x AS ({' UNION ALL '.join(f"SELECT fold, {i} AS place, '{n}' AS feature, {n} AS x, r FROM train" for i, n in enumerate(_STEPS))}),
edges AS ({' UNION ALL '.join(f"SELECT DISTINCT '{n}' AS feature, v FROM (SELECT {n} AS v, row_number() OVER (ORDER BY {n}) AS k, count(*) OVER () AS n, max({n}) OVER () AS top FROM any_train WHERE {n} IS NOT NULL) JOIN (SELECT unnest(range(1, 63)) AS q) ON k = ceil(q * n / 63) WHERE v < top UNION ALL SELECT '{n}', 1e9" for n in _STEPS)}),
parts AS (SELECT fold, place, x.feature, v, count(*) AS n, sum(r) AS s, count(*) FILTER (x <= v) AS ln, coalesce(sum(r) FILTER (x <= v), 0) AS ls, count(*) FILTER (x IS NULL) AS un, coalesce(sum(r) FILTER (x IS NULL), 0) AS us FROM x JOIN edges ON edges.feature = x.feature GROUP BY ALL),
sides AS (SELECT *, side, ln + side * un AS a, n - ln - side * un AS b, ls + side * us AS sa FROM parts, (SELECT unnest([0, 1]) AS side) WHERE ln > 0),
gains AS (SELECT *, sa * sa / (a + 1) + (s - sa) * (s - sa) / (b + 1) - s * s / (n + 1) AS gain FROM sides WHERE a >= 100 AND b >= 100),
best AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(gain, 6) DESC, place, v, side) AS k FROM gains)"""


@query("ml_first_split", f"WITH {_FIRST_SPLIT} SELECT fold, feature, CASE WHEN v < 1e9 THEN v END AS threshold, CASE WHEN un > 0 THEN side = 1 ELSE 2 * ln >= n END AS unknown_left, n AS rows, round(ln(gain / n), 5) + 0 AS ln_gain_per_row, round(sa / (a + 1), 2) + 0 AS left_value, round((s - sa) / (b + 1), 2) + 0 AS right_value FROM best WHERE k = 1")
def _first_split(spark, sf):
    """The first split of each fold's walk-forward model, over two returns in steps."""
    bars, scored, m = _scored(spark, sf)
    returns = with_sheet(bars, sheet_of("return_path"))
    steps = [F.when(F.col(c).isNotNull(), F.greatest(F.lit(-8), F.least(F.lit(8), F.round(F.col(c) / k)))).alias(n) for n, (c, k) in _STEPS.items()]
    df = returns.select("symbol", "minute", *steps).join(scored.select("symbol", "minute", "target"), ["symbol", "minute"])
    forest = models.fold_models(df, list(_STEPS), "target", m, 60, "expanding", trees=1, leaves=2, rate=1.0, least_rows=100)
    nodes = forest.nodes(spark).withColumnRenamed("model", "fold")
    value = lambda side: nodes.select("fold", F.col("node").alias(side), F.col("value").alias(f"{side}_value"))
    roots = nodes.where("node = 0").drop("value").join(value("left"), ["fold", "left"]).join(value("right"), ["fold", "right"])
    values = [F.round(c, 2).alias(c) for c in ("left_value", "right_value")]  # residuals are counted in steps of the largest / 2**26
    return rounded(roots.select("fold", "feature", "threshold", "unknown_left", "rows", F.ln(F.col("gain") / F.col("rows")).alias("ln_gain_per_row"), *values), 5)


@query(
    "stream_closed_bars",
    """SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 60 AS start_minute, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 60 + 60 AS end_minute, round(arg_min(value, (ts, event_id)), 6) + 0 AS open, round(max(value), 6) + 0 AS high,
    round(min(value), 6) + 0 AS low, round(arg_max(value, (ts, event_id)), 6) + 0 AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY floor(epoch(ts) / 3600)""",
)
def _stream(spark, sf):
    """The plan of the stream over the table as a batch."""
    from tidemark.streaming.bars import closed_bars

    e = spark.read.parquet(f"{sf}/events.parquet")
    out = closed_bars(e.withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "event_id", "value"), 60)
    minute = lambda c: F.floor(F.unix_timestamp(c) / 60).cast("long")
    return rounded(out.select(minute("start").alias("start_minute"), minute("end").alias("end_minute"), *_BARS))


_FRAMES, _ROLLED = (5, 60), (15,)


def _stream_sql() -> str:
    rolled = [f"CASE WHEN count(close) OVER w{n} = {n} THEN {f}(close) OVER w{n} END AS close_{name}_{n}" for n in _ROLLED for name, f in (("mean", "avg"), ("max", "max"), ("min", "min"))]
    over = ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY minute ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in _ROLLED)
    bars = [f"f{k} AS (SELECT symbol, minute // {k} AS bucket, arg_min(open, minute) AS open, max(high) AS high, min(low) AS low, arg_max(close, minute) AS close, sum(volume) AS volume FROM given GROUP BY 1, 2)" for k in _FRAMES]
    closed = [f"round(f{k}.{c}, 6) + 0 AS m{k}_{c}" for k in _FRAMES for c in _BARS]
    joins = " ".join(f"ASOF LEFT JOIN f{k} ON r.symbol = f{k}.symbol AND r.minute // {k} > f{k}.bucket" for k in _FRAMES)
    names = [*_BARS, *[f"close_{f}_{n}" for n in _ROLLED for f in ("mean", "max", "min")]]
    return f"""WITH e AS (SELECT event_type AS symbol, CAST(floor(epoch(ts) / 60) AS BIGINT) AS minute, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, ts FROM events),
    given AS (SELECT symbol, minute, value AS open, value AS high, value AS low, value AS close, k AS volume FROM e
      WHERE minute * 60000 <= (SELECT epoch_ms(max(ts)) FROM events) - 600000 QUALIFY row_number() OVER (PARTITION BY symbol, minute ORDER BY value DESC NULLS LAST, k DESC NULLS LAST) = 1),
    {", ".join(bars)}, r AS (SELECT *, {", ".join(rolled)} FROM given WINDOW {over})
    SELECT r.symbol, r.minute, {", ".join(f"round(r.{c}, 6) + 0 AS {c}" for c in names)}, {", ".join(closed)} FROM r {joins}"""


@query("stream_aligned_features", _stream_sql())
def _stream_features(spark, sf):
    """The events as a stream, a series for each type; what has come out by the end of the table."""
    from tidemark.streaming import features

    # a pattern may name a file or a folder, where a stream's plain path must be a folder
    events = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events.parque[t]")
    at, value = F.col("ts").cast("timestamp"), [F.col("value").alias(c) for c in _BARS[:4]]
    bars = events.select(F.col("event_type").alias("symbol"), at.alias("ts"), F.floor(F.unix_timestamp(at) / 60).cast("long").alias("minute"), *value, F.get_json_object("props", "$.k").cast("double").alias("volume"))
    return rounded(features.until_now(features.features(bars, _FRAMES, _ROLLED)))
