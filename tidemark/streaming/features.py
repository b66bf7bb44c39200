"""Features of a stream of bars: rolling statistics and the last closed bar of longer timeframes, as the batch has them.

Rows of a symbol are given out in order of time, once the watermark says that none before them can still come. Until then
they wait in state; what is kept after that is the longest window's rows, and two bars for each timeframe.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidemark.sources.tables import shared_dir

VALUES = ["open", "high", "low", "close", "volume"]
BAR = "minute long, " + ", ".join(f"{c} double" for c in VALUES)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def output_schema(frames: tuple[int, ...], windows: tuple[int, ...]) -> str:
    rolled = [f"close_{f}_{n} double" for n in windows for f in ("mean", "max", "min")]
    closed = [f"m{k}_{c} double" for k in frames for c in VALUES]
    return ", ".join(["symbol string", BAR, *rolled, *closed])


def features(bars: DataFrame, frames: tuple[int, ...] = (5, 60), windows: tuple[int, ...] = (15,), late: str = "10 minutes") -> DataFrame:
    """(symbol, minute, open ... volume, close_mean_<n> ..., m<frame>_open ...) of a stream (symbol, ts, minute, open, high,
    low, close, volume), in append mode.

    close_<f>_<n>: of the last n rows' closes, this one's included; NULL before n rows, or if one is unknown. m<frame>_: the
    last bar of `frame` minutes with known prices that had closed by the row's minute, anchored at the epoch.

    A row comes out once the watermark, `late` behind the newest ts, has reached its minute. Rows that come later than that
    are dropped. Of several rows of one minute, that of the latest micro-batch stays, and within one the greatest by its
    values. Rows without symbol, ts or minute are dropped; NaN counts as NULL. State is kept in RocksDB, so that the
    session's spark.sql.streaming.stateStore.providerClass must name it (ROCKS).
    """
    rows = bars.where("symbol IS NOT NULL AND ts IS NOT NULL AND minute IS NOT NULL").select("symbol", "ts", "minute", *VALUES)
    return rows.withWatermark("ts", late).groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=Aligned(frames, windows), outputStructType=output_schema(frames, windows), outputMode="append", timeMode="eventtime"
    )


def until_now(stream: DataFrame) -> DataFrame:
    """What a stream gives for all its sources hold now, as a table of the folder that driver and executors share."""
    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    folder, before = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def resampled(rows: pd.DataFrame, frame: int) -> pd.DataFrame:
    """Bars of `frame` minutes of rows in order of time, unfinished and unknown ones included, by number of the period."""
    out = rows.groupby(rows["minute"] // frame).agg({"open": "first", "high": "max", "low": "min", "close": "last"})
    return out.assign(volume=rows.groupby(rows["minute"] // frame)["volume"].sum(min_count=1))


class Aligned(StatefulProcessor):
    def __init__(self, frames: tuple[int, ...], windows: tuple[int, ...]) -> None:
        self.frames, self.windows = frames, windows

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", BAR)
        self.recent = handle.getListState("recent", BAR)
        self.given = handle.getValueState("given", "minute long")
        # the unfinished bar of each timeframe, as a row at its first minute, and the last closed one
        self.unfinished = handle.getListState("unfinished", f"frame int, {BAR}")
        self.closed = handle.getListState("closed", f"frame int, {BAR}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        given, parts = self.given.get(), []
        for pdf in rows:  # a micro-batch comes in several parts, and a minute's rows may lie in more than one
            parts.append(_greatest(pdf if given is None else pdf[pdf["minute"] > given[0]]))
        pdf = _greatest(pd.concat(parts)) if parts else ()
        if len(pdf):
            self.waiting.appendList(_tuples(pdf))
            self.handle.registerTimer(int(pdf["minute"].min()) * 60_000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = _frame(self.waiting.get()).drop_duplicates("minute", keep="last").sort_values("minute")
        final = waiting["minute"] * 60_000 <= timerValues.getCurrentWatermarkInMs()
        ready, later = waiting[final].reset_index(drop=True), waiting[~final]
        if not len(ready):
            return
        if len(later):
            self.waiting.put(_tuples(later))
            self.handle.registerTimer(int(later["minute"].min()) * 60_000)
        else:
            self.waiting.clear()
        self.given.update((int(ready["minute"].iloc[-1]),))
        out = {"symbol": key[0], **{c: ready[c] for c in ready.columns}, **self._rolled(ready), **self._closed(ready)}
        yield pd.DataFrame(out)

    def _rolled(self, ready: pd.DataFrame) -> dict[str, np.ndarray]:
        both = pd.concat([_frame(self.recent.get()), ready], ignore_index=True)
        out, close = {}, both["close"].to_numpy()
        for n in self.windows:
            padded = np.concatenate([np.full(n, np.nan), close])[-(len(ready) + n - 1) :] if n > 1 else close[-len(ready) :]
            runs = np.lib.stride_tricks.sliding_window_view(padded, n)
            for name, f in (("mean", np.mean), ("max", np.max), ("min", np.min)):
                out[f"close_{name}_{n}"] = f(runs, axis=1)
        if keep := max(self.windows, default=1) - 1:
            self.recent.put(_tuples(both.tail(keep)))
        return out

    def _closed(self, ready: pd.DataFrame) -> dict[str, np.ndarray]:
        before, last = ({r[0]: r[1:] for r in state.get()} for state in (self.unfinished, self.closed))
        out: dict[str, np.ndarray] = {}
        for frame in self.frames:
            rows = pd.concat([_frame([before[frame]] if frame in before else []), ready], ignore_index=True)
            made = resampled(rows, frame)
            end = made.index[-1]
            whole = made[(made.index < end) & made[VALUES[:4]].notna().all(axis=1)]
            if frame in last:
                whole = pd.concat([_frame([last[frame]]).set_index("minute").rename_axis(None), whole])
            at = np.searchsorted(whole.index.to_numpy(), ready["minute"].to_numpy() // frame) - 1
            for c in VALUES:
                values = np.append(whole[c].to_numpy(dtype=float), np.nan)
                out[f"m{frame}_{c}"] = values[np.where(at >= 0, at, len(whole))]
            before[frame] = (int(end * frame), *map(float, made.iloc[-1][VALUES]))
            if len(whole):
                last[frame] = (int(whole.index[-1]), *map(float, whole.iloc[-1][VALUES]))
        for state, bars in ((self.unfinished, before), (self.closed, last)):
            if bars:
                state.put([(frame, *bar) for frame, bar in bars.items()])
        return out


def _greatest(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for each minute, in order of time: the greatest by its values, an unknown one being least."""
    return rows[["minute", *VALUES]].sort_values(["minute", *VALUES], na_position="first").drop_duplicates("minute", keep="last")


def _frame(rows) -> pd.DataFrame:
    out = pd.DataFrame(list(rows), columns=["minute", *VALUES])
    return out.astype({"minute": "int64", **{c: "float64" for c in VALUES}})


def _tuples(pdf: pd.DataFrame) -> list[tuple]:
    return [(int(m), *v) for m, v in zip(pdf["minute"], pdf[VALUES].to_numpy(dtype=float).tolist())]
