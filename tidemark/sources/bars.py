"""Minute bars: reading, normalising, writing, and deriving them from event tables.

Bars are rows (symbol, ts, minute, open, high, low, close, volume); ts is the candle's open time in UTC and minute the
whole minutes since the epoch.
"""

from __future__ import annotations

import csv
import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Canonical columns, the exchange's kline layout, and names that stand for a column.
CANONICAL = ("timestamp", "open", "high", "low", "close", "volume")
KLINE = (
    "open_time LONG, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, close_time LONG, quote_volume DOUBLE, "
    "trade_count LONG, taker_buy_base_volume DOUBLE, taker_buy_quote_volume DOUBLE, ignore STRING"
)
ALIASES = {
    "timestamp": ("timestamp", "time", "datetime", "date", "open_time", "opentime", "ts"),
    "open": ("open", "o", "open_price"),
    "high": ("high", "h", "high_price"),
    "low": ("low", "l", "low_price"),
    "close": ("close", "c", "close_price"),
    "volume": ("volume", "v", "vol", "base_volume"),
}
#: Where a row stands in the input.
POSITION = "input_pos"
GLOB = "*.{csv,csv.gz,txt,txt.gz,parquet,pq}"


class SchemaError(ValueError):
    """Required columns are missing or not as they should be."""


def clean_name(name: str) -> str:
    return re.sub(r"[-/\s]+", "_", name.strip().lower())


def renamed(df: DataFrame) -> DataFrame:
    """Columns cleaned, and known aliases renamed; the first column that fits a name takes it."""
    names = [clean_name(c) for c in df.columns]
    taken = set(names) & set(CANONICAL)
    out = []
    for n in names:
        fit = next((k for k, v in ALIASES.items() if n in v), n)
        if fit != n and fit not in taken:
            taken.add(fit)
            n = fit
        out.append(n)
    return df.toDF(*out)


def parsed_time(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """The column as UTC timestamp. Whole numbers are epochs whose unit is told by their median size."""
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, T.TimestampType):
        return df
    if isinstance(kind, T.TimestampNTZType):
        return df.withColumn(column, c.cast("timestamp"))
    if isinstance(kind, (T.StringType, T.DateType)):
        as_number = c.try_cast("double")
        if isinstance(kind, T.StringType) and df.select(F.coalesce(F.every(as_number.isNotNull()), F.lit(False))).first()[0]:
            return parsed_time(df.withColumn(column, as_number.cast("long")), column)
        return df.withColumn(column, c.try_cast("timestamp"))
    size = df.select(F.percentile(F.abs(c), 0.5)).first()[0] or 0
    per_second = 1 if size < 1e11 else 1e3 if size < 1e14 else 1e6 if size < 1e17 else 1e9
    return df.withColumn(column, F.timestamp_micros((c.cast("decimal(38,0)") * 1_000_000 / int(per_second)).cast("long")))


def normalize(df: DataFrame, *, symbol: str = "series", drop_duplicates: bool = False, keep_extra: bool = False, sort: bool = False) -> DataFrame:
    """Bars from a raw table. Required columns must be there; numbers that do not parse become NULL, as does NaN.

    Nothing is filled or repaired. With drop_duplicates, of rows with one timestamp the last of the input stays: by
    input_pos where there is one (see positioned), else by the order that Spark reads the rows in. With sort, rows come
    in order of symbol and time, and of input_pos where times are equal. input_pos stays.
    """
    raw = renamed(df)
    if missing := [c for c in CANONICAL if c not in raw.columns]:
        raise SchemaError(f"missing columns: {missing}")
    raw = parsed_time(raw)
    numbers = {c: F.nullif(F.col(c).try_cast("double"), F.lit(float("nan"))) for c in CANONICAL[1:]}
    raw = raw.withColumns(numbers)
    if "symbol" not in raw.columns:
        raw = raw.withColumn("symbol", F.lit(symbol))
    if drop_duplicates:
        order = F.col(POSITION) if POSITION in raw.columns else F.monotonically_increasing_id()
        last = Window.partitionBy("symbol", "timestamp").orderBy(order.desc())
        raw = raw.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    extra = [c for c in raw.columns if c not in CANONICAL and c != "symbol" and (keep_extra or c == POSITION)]
    out = raw.select("symbol", F.col("timestamp").alias("ts"), F.floor(F.unix_timestamp("timestamp") / 60).cast("long").alias("minute"), *CANONICAL[1:], *extra)
    return out.orderBy("symbol", "ts", *[c for c in (POSITION,) if c in out.columns]) if sort else out


def positioned(df: DataFrame, rows: str | None = None) -> DataFrame:
    """df, as a reader gives it, with input_pos: (file, block, row), a total order of its rows that stays with them
    however they are dealt out later. rows names what numbers a block's rows; by default the order they are read in."""
    row = F.monotonically_increasing_id() if rows is None else F.col(rows)
    return df.withColumn(POSITION, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), row.alias("row")))


def layouts(spark: SparkSession, path: str, glob: str = "*.{csv,csv.gz,txt,txt.gz}") -> dict[tuple[str, ...], list[str]]:
    """Text files below a path by layout: the names of their header, or () for the kline layout without one.

    One aggregate takes each file's first line. A file whose first line has the required columns is headed; else it must
    have as many fields as the kline layout, or what was wrong with the header is raised, for the first such file. The
    driver gets a line for each file, as it has listed them all to read them; empty files have no layout.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    lines = positioned(lines).select("value", POSITION)
    first = lines.groupBy(F.col(POSITION)["file"].alias("file")).agg(F.min_by("value", POSITION).alias("line"))
    out: dict[tuple[str, ...], list[str]] = {}
    for r in first.orderBy("file").collect():
        names = next(csv.reader([r["line"].lstrip("\ufeff")]), [])
        kinds = spark.createDataFrame([], ", ".join(f"`{i}` string" for i in range(len(names)))).toDF(*names) if names and len(set(map(clean_name, names))) == len(names) else None
        missing = [c for c in CANONICAL if kinds is None or c not in renamed(kinds).columns]
        if missing and len(names) != len(KLINE.split(",")):
            raise SchemaError(f"{r['file']}: missing columns: {missing}")
        out.setdefault(() if missing else tuple(names), []).append(r["file"])
    return out


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV with a header, or CSV in the kline layout without one."""
    if re.search(r"\.(parquet|pq)/?$", path):
        return spark.read.parquet(path)
    headed = spark.read.option("header", True).csv(path)
    if {c for c in CANONICAL} <= set(renamed(headed).columns):
        return headed
    plain = spark.read.schema(KLINE).csv(path)
    if len(headed.columns) != len(plain.columns):
        raise SchemaError(f"{path}: neither the canonical columns nor the kline layout")
    return plain


def read_bars(spark: SparkSession, path: str, *, drop_duplicates: bool = False, sort: bool = False, position: bool = False, **options) -> DataFrame:
    """Bars of a file, or of all files below a folder: Parquet, and CSV of any layouts, each read in one go and united by
    name. options are those of normalize(); with position, rows keep their input_pos."""
    parts = []
    reader = spark.read.option("recursiveFileLookup", True)
    try:
        part = reader.option("pathGlobFilter", "*.{parquet,pq}").parquet(path)
        parts += [positioned(part, "_metadata.row_index")] if part.columns else []
    except AnalysisException as e:  # no file of this kind
        if not {"UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"} & {(e.getCondition() or "").split(".")[0]}:
            raise
    for names, files in layouts(spark, path).items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names]) if names else KLINE
        parts.append(positioned(spark.read.schema(schema).option("header", bool(names)).option("enforceSchema", True).csv(files)))
    if not parts:
        raise SchemaError(f"{path}: no bar files")
    # each layout tells its own unit of time; of rows with one time in several files, the last file's stays
    bars = [normalize(p, **options) for p in parts]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), bars)
    if drop_duplicates:
        last = Window.partitionBy("symbol", "ts").orderBy(F.col(POSITION).desc())
        out = out.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    if sort:
        out = out.orderBy("symbol", "ts", POSITION)
    return out if position else out.drop(POSITION)


def write_bars(bars: DataFrame, path: str) -> None:
    """By symbol and month, so that reads of a time range prune folders; CSV if the path ends so."""
    if path.endswith((".csv", ".csv.gz")):
        bars.write.mode("overwrite").option("header", True).csv(path)
    else:
        bars.withColumn("month", F.date_format("ts", "yyyy-MM")).write.mode("overwrite").partitionBy("symbol", "month").parquet(path)


def _ohlc(open_: Column, close: Column) -> tuple[Column, Column]:
    return F.greatest(open_, close) * 1.001, F.least(open_, close) * 0.999


def dense_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One gap-free series from events: the event's number is its minute, its value the close, the last one's the open."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    # a join on the number before, so that no window gathers the series in one task
    before = e.select((F.col("event_id") + 1).alias("event_id"), F.col("value").alias("before"))
    e = e.join(before, "event_id", "left")
    opened = F.coalesce("before", "value")
    high, low = _ohlc(opened, F.col("value"))
    return e.select(
        F.lit("series").alias("symbol"),
        F.timestamp_seconds(F.col("event_id") * 60).alias("ts"),
        F.col("event_id").alias("minute"),
        opened.alias("open"),
        high.alias("high"),
        low.alias("low"),
        F.col("value").alias("close"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
    )


DENSE_SQL = """dense0 AS (SELECT 'series' AS symbol, event_id AS minute, value AS close,
  coalesce(lag(value) OVER (ORDER BY event_id), value) AS open, CAST(json_extract(props, '$.k') AS DOUBLE) AS volume FROM events),
bars AS (SELECT symbol, minute, open, greatest(open, close) * 1.001 AS high, least(open, close) * 0.999 AS low, close, volume,
  row_number() OVER (ORDER BY minute) AS idx FROM dense0)"""


def gappy_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the minutes that have events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.withColumn("minute", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60).cast("long"))
    at = F.struct("ts", "event_id")
    return e.groupBy("minute").agg(
        F.min_by("value", at).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", at).alias("close"),
        F.sum(F.get_json_object("props", "$.k").cast("double")).alias("volume"),
    ).select(F.lit("series").alias("symbol"), F.timestamp_seconds(F.col("minute") * 60).alias("ts"), "minute", "open", "high", "low", "close", "volume")


GAPPY_SQL = """gappy AS (SELECT 'series' AS symbol, CAST(floor(epoch(ts) / 60) AS BIGINT) AS minute, arg_min(value, (ts, event_id)) AS open,
  max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, sum(CAST(json_extract(props, '$.k') AS DOUBLE)) AS volume
  FROM events GROUP BY 2)"""
