"""Gradient-boosted regression trees over binned features, many models at once.

Features are cut into bins once, and rows stand in a table as the bytes of their bins. Trees then grow from sums of
residuals by (model, node, feature, bin): tasks add up their rows, one shuffle by (model, node, block of features) adds
up the tasks and finds each block's best split, and the driver sees one split for each block. All models of a call, such
as the folds of a cross-validation, share every job: a row counts for each model that it trains.

A tree grows by its best split first, up to a number of leaves. Histograms of all nodes that may be split next come from
one job, so that a tree of 31 leaves takes about as many jobs as it is deep, not as many as it has splits. Residuals are
whole numbers (a fixed fraction of the largest target), so that sums are exact and trees do not depend on how rows are
dealt out. Unknown values have a bin of their own; a split sends them to the side where they do better.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.tables import Work

#: Bins of known values; features of a block of the shuffle; bytes of sums that a task holds; trees between two rewrites
#: of the table with the predictions so far; rows whose bins are turned at a time.
BINS, BLOCK, SUM_BYTES, KEEP, ROWS = 63, 256, 256 << 20, 4, 8192
#: Values that a task sorts at a time to cut bins, and points of a column that it keeps of them.
CUT_CELLS, POINTS = 1 << 24, 20_000
#: A row counts as this in a sum of residuals of ROWS rows, which are below half of it: one sum tells both.
ROW = 1 << 39
#: Residuals are counted in this fraction of the largest distance of a target from the middle.
UNIT = 1 << 26
_SPLIT = "model int, node int, gain double, feature int, cut int, unknown_left boolean, left_sum long, left_rows long, sum long, rows long"


@dataclass
class Tree:
    """Nodes in arrays: feature -1 is a leaf; a bin of at most `cut`, or an unknown value if unknown_left, goes left."""

    feature: np.ndarray
    cut: np.ndarray
    unknown_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    rows: np.ndarray

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The leaf that each row of bins ends in."""
        out, open_ = np.zeros(len(codes), np.int64), [(0, np.arange(len(codes)))]
        while open_:
            node, rows = open_.pop()
            if self.feature[node] < 0 or not len(rows):
                out[rows] = node
                continue
            code = codes[:, self.feature[node]].take(rows)
            left = code <= self.cut[node]
            if not self.unknown_left[node]:
                left &= code != 0
            open_ += [(self.left[node], rows[left]), (self.right[node], rows[~left])]
        return out


@dataclass
class Forest:
    """Models of one call: for each a constant and its trees."""

    columns: list[str]
    edges: list[np.ndarray]
    start: dict[str, float]
    trees: dict[str, list[Tree]] = field(default_factory=dict)

    def codes(self, values: np.ndarray) -> np.ndarray:
        """Bins of rows of features: 0 for an unknown value, k for one above k - 1 edges."""
        out = np.empty(values.shape, np.uint8)
        for j, edge in enumerate(self.edges):
            x = values[:, j]
            out[:, j] = np.where(np.isnan(x), 0, 1 + np.searchsorted(edge, x, side="left"))
        return out

    def score(self, codes: np.ndarray, model: str) -> np.ndarray:
        out = np.full(len(codes), self.start[model])
        for tree in self.trees[model]:
            out += tree.value[tree.leaves(codes)]
        return out

    def predict(self, df: DataFrame, model: str | Column | None = None, keep: list[str] | None = None) -> DataFrame:
        """df (or the columns to keep) with pred. model is a name, or a column of names for each row; NULL for none."""
        only = next(iter(self.trees)) if model is None and len(self.trees) == 1 else model
        if only is None:
            raise ValueError(f"one of {sorted(self.trees)} must be named")
        keep = df.columns if keep is None else keep
        name = only if isinstance(only, Column) else F.lit(only)
        features = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in self.columns])
        rows = df.select(*[F.col(f"`{c}`") for c in keep], name.alias("__model"), features.alias("__x"))
        schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("pred", T.DoubleType())])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = self.codes(_matrix(batch.column(batch.num_columns - 1), len(self.columns)))
                names = batch.column(batch.num_columns - 2).dictionary_encode()
                kinds, of = names.dictionary.to_pylist(), names.indices.fill_null(-1).to_numpy()
                pred = np.full(batch.num_rows, np.nan)
                for k, m in enumerate(kinds):
                    if m in self.trees:
                        own = np.flatnonzero(of == k)
                        pred[own] = self.score(codes[own], m)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(pred, from_pandas=True)], names=[*keep, "pred"])

        return rows.mapInArrow(work, schema)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """(model, tree, node, feature, threshold, unknown_left, left, right, value, gain, rows): all nodes, leaves with no
        feature. A value up to the threshold goes left; no threshold: all known values do."""
        out = []
        for m, trees in self.trees.items():
            for t, x in enumerate(trees):
                for i in range(len(x.feature)):
                    j = int(x.feature[i])
                    inner = j >= 0
                    edge = self.edges[j] if inner else ()
                    out.append((
                        m, t, i, self.columns[j] if inner else None, float(edge[x.cut[i] - 1]) if inner and x.cut[i] <= len(edge) else None, bool(x.unknown_left[i]) if inner else None,
                        int(x.left[i]) if inner else None, int(x.right[i]) if inner else None, float(x.value[i]), float(x.gain[i]), int(x.rows[i]),
                    ))
        return spark.createDataFrame(out, "model string, tree int, node int, feature string, threshold double, unknown_left boolean, left int, right int, value double, gain double, rows long")

    def importance(self, spark: SparkSession) -> DataFrame:
        """(model, feature, importance_split, importance_gain): splits on each feature and their summed gains; features
        that no split uses have 0 of both."""
        used = self.nodes(spark).where("feature IS NOT NULL").groupBy("model", "feature")
        used = used.agg(F.count(F.lit(1)).alias("importance_split"), F.sum("gain").alias("importance_gain"))
        every = spark.createDataFrame([(m, c) for m in self.trees for c in self.columns], "model string, feature string")
        return every.join(used, ["model", "feature"], "left").fillna({"importance_split": 0, "importance_gain": 0.0})

    def save(self, spark: SparkSession, path: str) -> None:
        """Two tables: nodes, and one row of what is common to them."""
        self.nodes(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        facts = json.dumps({"columns": self.columns, "edges": [e.tolist() for e in self.edges], "start": self.start})
        spark.createDataFrame([(facts,)], "facts string").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        facts = json.loads(spark.read.parquet(f"{path}/facts").first()["facts"])
        out = Forest(facts["columns"], [np.array(e) for e in facts["edges"]], facts["start"], {m: [] for m in facts["start"]})
        place = {c: j for j, c in enumerate(out.columns)}
        held: dict[tuple[str, int], list] = {}
        for r in spark.read.parquet(f"{path}/nodes").orderBy("model", "tree", "node").collect():
            held.setdefault((r["model"], r["tree"]), []).append(r)
        for (m, _), rows in held.items():
            feature = [-1 if r["feature"] is None else place[r["feature"]] for r in rows]
            cut = [0 if j < 0 else len(out.edges[j]) + 1 if r["threshold"] is None else 1 + int(np.searchsorted(out.edges[j], r["threshold"])) for j, r in zip(feature, rows)]
            get = lambda c, kind, none=0: np.array([none if r[c] is None else r[c] for r in rows], kind)  # noqa: B023, E731
            out.trees[m].append(Tree(np.array(feature), np.array(cut), get("unknown_left", bool), get("left", int), get("right", int), get("value", float), get("gain", float), get("rows", int)))
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def edges(df: DataFrame, columns: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of the bins of each column but its last: quantiles of the known values, each once.

    Tasks sort some rows' values at a time and send every n-th, POINTS of a column or all if they are fewer, so that a
    quantile's rank is off by one in POINTS at most. A column's points are put together apart from those of others:
    no task holds all columns.
    """
    width = len(columns)
    size = max(POINTS, CUT_CELLS // width)

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            values = np.concatenate(held)
            held.clear()
            for at in range(0, width, 16):
                out = []
                for j in range(at, min(at + 16, width)):
                    x = values[:, j]
                    x = np.sort(x[~np.isnan(x)])
                    step = max(1, -(-len(x) // POINTS))
                    if len(x):
                        out.append((j, len(x), step, np.append(x[step - 1 : -1 : step], x[-1]).tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["column", "n", "step", "points"])

        for batch in batches:
            values = _matrix(batch.column(0), width)
            for at in range(0, len(values), size):
                held.append(values[at : at + size])
                count += len(held[-1])
                if count >= size:
                    yield from sent()
                    count = 0
        if held:
            yield from sent()

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        x = [np.frombuffer(p) for p in pdf["points"]]
        rows = [np.append(np.full(len(p) - 1, step), n - step * (len(p) - 1)) for p, n, step in zip(x, pdf["n"], pdf["step"])]
        x, rows = np.concatenate(x), np.concatenate(rows)
        order = np.argsort(x, kind="stable")
        x, to = x[order], np.cumsum(rows[order])
        at = np.searchsorted(to, np.ceil(np.arange(1, bins) / bins * to[-1]))
        return pd.DataFrame({"column": [pdf["column"].iloc[0]], "edges": [np.unique(x[at][x[at] < x[-1]]).tolist()]})

    x = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in columns])
    sent = df.select(x.alias("x")).mapInArrow(points, "column int, n long, step long, points binary")
    found = {r["column"]: r["edges"] for r in sent.groupBy("column").applyInPandas(cut, "column int, edges array<double>").collect()}
    return [np.array(found.get(j, ()), float) for j in range(width)]


class _Growth:
    """One model's tree while it grows. Nodes get their best split from histograms; which splits are taken, best gain
    first, is told anew each time more of them are known."""

    def __init__(self, rows: int, leaves: int, least_rows: int, depth: int | None) -> None:
        self.leaves, self.least_rows, self.most_depth = leaves, least_rows, depth
        self.sum, self.rows, self.depth = [0], [rows], [0]
        self.best: list[dict | None] = [None]
        self.known, self.left = [not rows], [-1]  # the root's sum comes with its histogram
        self.taken: list[int] = []

    def _may_split(self, node: int) -> bool:
        return self.rows[node] >= 2 * self.least_rows and (self.most_depth is None or self.depth[node] < self.most_depth)

    def pending(self) -> list[int]:
        return [i for i, k in enumerate(self.known) if not k]

    def learn(self, node: int, best: dict) -> None:
        self.known[node], self.sum[node] = True, best["sum"]
        self.best[node] = best if best["feature"] >= 0 else None

    def _expand(self, node: int) -> None:
        b = self.best[node]
        self.left[node] = len(self.sum)
        for s, n in ((b["left_sum"], b["left_rows"]), (self.sum[node] - b["left_sum"], self.rows[node] - b["left_rows"])):
            self.sum.append(s)
            self.rows.append(n)
            self.depth.append(self.depth[node] + 1)
            self.best.append(None)
            self.left.append(-1)
            self.known.append(True)
            self.known[-1] = not self._may_split(len(self.sum) - 1)

    def choose(self) -> None:
        """Take splits as far as is known, and open the nodes that may be next: no more than there are leaves left."""
        if not self.known[0]:
            return
        self.taken, open_ = [], [0] if self.best[0] and self._may_split(0) else []
        while open_ and len(self.taken) + 1 < self.leaves:
            open_.sort(key=lambda i: (-self.best[i]["gain"], i))
            node = open_.pop(0)
            self.taken.append(node)
            if len(self.taken) + 1 == self.leaves:
                return
            if self.left[node] < 0:
                self._expand(node)
            children = (self.left[node], self.left[node] + 1)
            if not all(self.known[c] for c in children):
                for other in open_[: self.leaves - len(self.taken) - 1]:
                    if self.left[other] < 0:
                        self._expand(other)
                return
            open_ += [c for c in children if self.best[c]]

    def tree(self, scale: float, rate: float, l2: float, final: bool) -> Tree:
        """The tree of the splits taken; while it grows, of all that are open."""
        inner = self.taken if final else [i for i, c in enumerate(self.left) if c >= 0]
        inner = [i for i in inner if self.best[i]]
        if final:
            for i in inner:
                if self.left[i] < 0:
                    self._expand(i)
        n = len(self.sum)
        feature = np.full(n, -1)
        cut, left, right, gain = np.zeros(n, int), np.zeros(n, int), np.zeros(n, int), np.zeros(n)
        unknown_left = np.zeros(n, bool)
        for i in inner:
            b = self.best[i]
            feature[i], cut[i], unknown_left[i], gain[i] = b["feature"], b["cut"], b["unknown_left"], b["gain"]
            left[i], right[i] = self.left[i], self.left[i] + 1
        value = rate * np.array(self.sum, float) / scale / (np.array(self.rows, float) + l2)
        return Tree(feature, cut, unknown_left, left, right, value, gain, np.array(self.rows)) if not final else _compact(Tree(feature, cut, unknown_left, left, right, value, gain, np.array(self.rows)))


def _compact(x: Tree) -> Tree:
    """Without the nodes that no split leads to, numbered as a walk meets them."""
    order, stack = [], [0]
    while stack:
        i = stack.pop()
        order.append(i)
        if x.feature[i] >= 0:
            stack += [int(x.right[i]), int(x.left[i])]
    new = np.zeros(len(x.feature), int)
    new[order] = np.arange(len(order))
    pick = lambda a: a[order]
    return Tree(pick(x.feature), pick(x.cut), pick(x.unknown_left), new[pick(x.left)], new[pick(x.right)], pick(x.value), pick(x.gain), pick(x.rows))


def best_split(sums: np.ndarray, rows: np.ndarray, scale: float, least_rows: int, l2: float, least_gain: float) -> tuple | None:
    """(gain, feature, cut, unknown_left, left_sum, left_rows) of the best split by sums and rows of (feature, bin), bin 0
    unknown; None if there is none. Known values stand on the left; all of them do where a split parts them from the
    unknown. Of equal gains, the first feature and then the lowest cut."""
    unknown_sum, unknown_rows = sums[:, :1], rows[:, :1]
    low_sum, low_rows = np.cumsum(sums[:, 1:], axis=1), np.cumsum(rows[:, 1:], axis=1)
    total, n = low_sum[:, -1:] + unknown_sum, low_rows[:, -1:] + unknown_rows
    gains = []
    for left_sum, left_rows in ((low_sum, low_rows), (low_sum + unknown_sum, low_rows + unknown_rows)):
        right_rows = n - left_rows
        with np.errstate(divide="ignore", invalid="ignore"):
            g = (left_sum / scale) ** 2 / (left_rows + l2) + ((total - left_sum) / scale) ** 2 / (right_rows + l2) - (total / scale) ** 2 / (n + l2)
        gains.append(np.where((low_rows > 0) & (left_rows >= least_rows) & (right_rows >= least_rows), g, -np.inf))
    both = np.maximum(*gains)
    j, k = np.unravel_index(int(both.argmax()), both.shape)
    gain = float(both[j, k])
    if not gain > least_gain:
        return None
    if unknown_rows[j, 0]:
        unknown_left = bool(gains[1][j, k] > gains[0][j, k])
        side = int(unknown_left)
    else:  # none seen here: to the larger side
        unknown_left, side = bool(2 * low_rows[j, k] >= n[j, 0]), 0
    left_sum, left_rows = low_sum[j, k] + side * unknown_sum[j, 0], low_rows[j, k] + side * unknown_rows[j, 0]
    return gain, int(j), int(k) + 1, unknown_left, int(left_sum), int(left_rows)


def grow(
    df: DataFrame, columns: list[str], target: str, models: dict[str, Column] | None = None, trees: int = 20, leaves: int = 31, depth: int | None = None, rate: float = 0.1,
    least_rows: int = 20, l2: float = 1.0, least_gain: float = 1e-12, column_share: float = 1.0, bins: int = BINS, seed: int = 42,
) -> Forest:
    """Boosted trees for squared error, one model for each condition of `models` on the rows that it is true for.

    Rows without a finite target train nothing; a model without rows, or with no rows at all, predicts 0. column_share is the
    part of the columns that each tree may use, drawn by seed. Bins are cut by the quantiles of all rows that train any
    model. df is read three times; columns may hold NULL or NaN, which are unknown.
    """
    spark = df.sparkSession
    models = {"all": F.lit(True)} if models is None else models
    if not columns or not 1 < bins < 256:
        raise ValueError("trees need columns, and 2 to 255 bins")
    names, width = list(models), len(columns)
    y = F.col(f"`{target}`").cast("double")
    y = F.when(F.abs(y) < float("inf"), y)
    member = [F.coalesce(c, F.lit(False)) for c in models.values()]
    rows = df.where(y.isNotNull()).select(y.alias("__y"), F.array(*member).alias("__m"), *[F.col(f"`{c}`") for c in columns]).where(F.exists("__m", lambda m: m))
    forest = Forest(columns, edges(rows, columns, bins), {m: 0.0 for m in names}, {m: [] for m in names})
    x = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in columns])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            member = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.uint8).reshape(-1, len(names))
            codes = forest.codes(_matrix(batch.column(2), width))
            margin = np.zeros((batch.num_rows, len(names)))
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(member), _packed(codes), _packed(margin)], names=["y", "member", "codes", "margin"])

    with Work(spark, "trees") as work:
        table = work.write(rows.select("__y", "__m", x.alias("__x")).mapInArrow(binned, "y double, member binary, codes binary, margin binary"))
        scale, sums = _start(table, names)
        for k, m in enumerate(names):
            forest.start[m] = sums[k][0] / scale / sums[k][1] if sums[k][1] else 0.0
        since: list[list[Tree]] = [[] for _ in names]
        constants = np.array([forest.start[m] for m in names])
        for t in range(trees):
            if t and t % KEEP == 0:
                table = work.write(_with_margins(table, since), instead=table)
                since = [[] for _ in names]
            rng = np.random.default_rng([seed, t])
            some = [np.sort(rng.choice(width, max(1, round(column_share * width)), replace=False)) for _ in names]
            growing = [_Growth(n, leaves, least_rows, depth) for _, n in sums]
            while wanted := [(k, i) for k, g in enumerate(growing) for i in g.pending()]:
                most = max(1, SUM_BYTES // (16 * (bins + 1) * max(map(len, some))))
                for at in range(0, len(wanted), most):
                    part = wanted[at : at + most]
                    found = _splits(table, since, constants, scale, growing, part, some, bins, least_rows, l2, least_gain)
                    for k, i in part:
                        growing[k].learn(i, found[(k, i)])
                for g in growing:
                    g.choose()
            for k, g in enumerate(growing):
                g.choose()
                tree = g.tree(scale, rate, l2, True)
                forest.trees[names[k]].append(tree)
                since[k].append(tree)
    return forest


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as byte strings."""
    x = np.ascontiguousarray(x)
    size = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * size, size, dtype=np.int32)), pa.py_buffer(x.reshape(-1).view(np.uint8))])


def _unpacked(column: pa.Array, kind: type) -> np.ndarray:
    n = len(column)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].view(kind).reshape(n, -1)


def _start(table: DataFrame, names: list[str]) -> tuple[float, list[tuple[int, int]]]:
    """(scale, sum and rows of the targets of each model), sums in whole numbers of 1 / scale."""
    most = table.agg(F.max(F.abs("y"))).first()[0] or 1.0
    scale = UNIT / most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for batch in batches:
            y = np.rint(batch.column(0).to_numpy() * scale).astype(np.int64)
            member = _unpacked(batch.column(1), np.uint8).astype(np.int64)
            total, count = total + y @ member, count + member.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names), dtype=np.int32)), pa.array(total), pa.array(count)], names=["model", "s", "n"])

    parts = table.select("y", "member").mapInArrow(work, "model int, s long, n long").groupBy("model")
    got = {r["model"]: (int(r["s"]), int(r["n"])) for r in parts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    return scale, [got.get(k, (0, 0)) for k in range(len(names))]


def _with_margins(table: DataFrame, since: list[list[Tree]]) -> DataFrame:
    """The table with the predictions of the trees that came since."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, margin = _unpacked(batch.column(2), np.uint8), _unpacked(batch.column(3), np.float64).copy()
            for k, own in enumerate(since):
                for tree in own:
                    margin[:, k] += tree.value[tree.leaves(codes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _packed(margin)], names=batch.schema.names)

    return table.mapInArrow(work, table.schema)


def _histograms(own: np.ndarray, slot: np.ndarray, r: np.ndarray, nodes: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, rows) of whole residuals by (feature, node, bin), of ROWS rows at most; own are the rows' bins by feature."""
    base, size = slot * (bins + 1), nodes * (bins + 1)
    shape = (len(own), nodes, bins + 1)
    if np.abs(r).sum() < ROW // 2:  # as it nearly always is: sums stay below 2**53, where floating point is exact
        both, weight = np.empty((len(own), size)), r + ROW
        for j in range(len(own)):
            both[j] = np.bincount(base + own[j], weight, size)
        both = both.astype(np.int64)
        rows = both + ROW // 2 >> 39
        return (both - (rows << 39)).reshape(shape), rows.reshape(shape)
    sums, rows = np.empty((len(own), size), np.int64), np.empty((len(own), size), np.int64)
    for j in range(len(own)):
        sums[j], rows[j] = np.bincount(base + own[j], r, size), np.bincount(base + own[j], minlength=size)
    return sums.reshape(shape), rows.reshape(shape)


def _splits(
    table: DataFrame, since: list[list[Tree]], constants: np.ndarray, scale: float, growing: list[_Growth], wanted: list[tuple[int, int]], some: list[np.ndarray],
    bins: int, least_rows: int, l2: float, least_gain: float,
) -> dict[tuple[int, int], dict]:
    """The best split of each (model, node) that is wanted (feature -1: none), and the sum of its rows, from one job."""
    slots: dict[int, np.ndarray] = {}
    trees = {k: growing[k].tree(scale, 1.0, l2, False) for k in {k for k, _ in wanted}}
    order: dict[int, list[int]] = {k: [] for k in trees}
    for k, i in wanted:
        order[k].append(i)
    for k, nodes in order.items():
        slots[k] = np.full(len(trees[k].feature), -1)
        slots[k][nodes] = np.arange(len(nodes))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: np.zeros((2, len(some[k]), len(nodes), bins + 1), np.int64) for k, nodes in order.items()}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                y, member = batch.column(0).to_numpy(), _unpacked(batch.column(1), np.uint8)
                codes, margin = _unpacked(batch.column(2), np.uint8), _unpacked(batch.column(3), np.float64)
                for k, sums in held.items():
                    rows = np.flatnonzero(member[:, k])
                    near = np.asfortranarray(codes[rows])  # by columns
                    slot = slots[k][trees[k].leaves(near)]
                    if (inside := slot >= 0).sum() < len(rows):
                        rows, slot, near = rows[inside], slot[inside], near.T[:, inside].T
                    if not len(rows):
                        continue
                    so_far = margin[rows, k]
                    for tree in since[k]:
                        so_far = so_far + tree.value[tree.leaves(near)]
                    residual = np.rint((y[rows] - constants[k] - so_far) * scale)
                    sums += _histograms(near.T[some[k]], slot, residual, len(order[k]), bins)
        held = {k: np.moveaxis(x, (0, 2), (3, 0)) for k, x in held.items()}  # node, feature, bin, (sum, rows)
        out = [(k, i, b, held[k][s, b : b + BLOCK].tobytes()) for k, nodes in order.items() for s, i in enumerate(nodes) for b in range(0, len(some[k]), BLOCK)]
        for at in range(0, len(out), 64):
            part = list(zip(*out[at : at + 64]))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in part[:3]], pa.array(part[3], pa.binary())], names=["model", "node", "block", "sums"])

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        k, i, b = (int(pdf[c].iloc[0]) for c in ("model", "node", "block"))
        total = np.frombuffer(pdf["sums"].iloc[0], np.int64).copy()
        for more in pdf["sums"].iloc[1:]:
            total += np.frombuffer(more, np.int64)
        total = total.reshape(-1, bins + 1, 2)
        split = best_split(total[..., 0], total[..., 1], scale, least_rows, l2, least_gain)
        gain, j, cut, unknown_left, left_sum, left_rows = split or (0.0, -1, 0, False, 0, 0)
        row = (k, i, gain, int(some[k][b + j]) if split else -1, cut, unknown_left, left_sum, left_rows, int(total[0, :, 0].sum()), int(total[0, :, 1].sum()))
        return pd.DataFrame([row], columns=[c.split()[0] for c in _SPLIT.split(", ")])

    parts = table.mapInArrow(work, "model int, node int, block int, sums binary")
    found: dict[tuple[int, int], dict] = {}
    for r in parts.groupBy("model", "node", "block").applyInPandas(best, _SPLIT).collect():  # one row for each block
        key, now = (r["model"], r["node"]), r.asDict()
        if key not in found or (now["feature"] < 0, -now["gain"], now["feature"]) < (found[key]["feature"] < 0, -found[key]["gain"], found[key]["feature"]):
            found[key] = now
    return found
