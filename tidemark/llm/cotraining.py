"""A quality classifier by co-training.

Two logistic models look at different sides of a document: what the text says (words, characters), and what is known of
its page without reading it (source, language, recorded length). Each round, a model learns from the labelled documents
and from the others that the calibrated other model of the round before is confident about. A fifth of the labelled
documents is held out: neither model learns from them, as labels or as pseudo-labels; on them both views are calibrated
and then combined. All documents are scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, materialise, padded, slices, table, word_hashes, words_of

#: Labelled documents that the models learn from at most, the first by hash (a fifth of them only calibrates).
LABELLED = 20_000
#: Rounds, Newton steps of each, confidence that makes a pseudo-label, its weight, and the ridge penalty.
ROUNDS, STEPS, CONFIDENT, PSEUDO_WEIGHT, RIDGE = 3, 4, 0.97, 0.2, 3.0
#: Hash buckets of words, sources and languages, and steps of the recorded length, each three times the one before.
WORDS, SOURCES, LANGUAGES, LENGTHS = 64, 24, 8, 9
_CLASS = np.zeros(256, np.int64)
for _k, _set in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&", "|<>", "!", ".,;:?", "\n"), 1):
    _CLASS[[ord(c) for c in _set]] = _k
_CLASS[128:] = 9
CLASSES = 10


def text_view(column: pa.Array) -> np.ndarray:
    """Features of what each text says: shares of character classes and of word buckets, and some word statistics."""
    buffer, rows = padded(column)
    n = len(rows) - 1
    row = np.repeat(np.arange(n), np.diff(rows))
    chars = np.bincount(row * CLASSES + _CLASS[buffer], minlength=n * CLASSES).reshape(n, CLASSES)
    starts, ends = words_of(buffer)
    hashes = word_hashes(buffer, starts, ends)
    of = np.searchsorted(rows, starts, side="right") - 1
    words = np.bincount(of, minlength=n)
    buckets = np.bincount(of * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    different = np.bincount(np.unique(np.stack([of, hashes.view(np.int64)]), axis=1)[0], minlength=n) if len(of) else words
    last = np.bincount(of, np.isin(_CLASS[buffer[ends - 1]], (4, 5, 6)), n) if len(of) else words
    one = np.maximum(words, 1)
    size = np.maximum(np.diff(rows), 1)
    more = [np.log1p(words) / 5, different / one, last / one, np.bincount(of, ends - starts, n) / one / 10 if len(of) else words]
    return np.concatenate([chars / size[:, None] * 4, np.sqrt(buckets / one[:, None]), np.stack(more, 1), np.ones((n, 1))], 1)


def page_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Features of what is known of each page: source, language, and how far its recorded length is in each step."""
    n = len(source)
    out = np.zeros((n, SOURCES + LANGUAGES + LENGTHS + 1))
    for i, (s, k) in enumerate(zip(source, lang)):
        out[i, zlib.crc32(repr(s).encode()) % SOURCES] = 1
        out[i, SOURCES + zlib.crc32(repr(k).encode()) % LANGUAGES] = 1
    steps = np.log1p(np.array([x or 0 for x in n_chars], np.float64).clip(0)) / np.log(3) - 2
    out[:, SOURCES + LANGUAGES : -1] = np.clip(steps[:, None] - np.arange(LENGTHS), 0, 1)
    out[:, -1] = 1
    return out


def views(docs: DataFrame) -> DataFrame:
    """(doc_id, text_view, page_view), float32 numbers as binary. Nulls count as empty text, or as a value of their own."""
    for name, kind in (("source", "string"), ("lang", "string"), ("n_chars", "long")):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast(kind))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                both = [text_view(part.column(1)), page_view(*(part.column(i).to_pylist() for i in (2, 3, 4)))]
                packed = [pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary()) for x in both]
                yield pa.RecordBatch.from_arrays([part.column(0), *packed], names=["doc_id", "text_view", "page_view"])

    return map_arrow(docs, work, "doc_id long, text_view binary, page_view binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), -1).astype(np.float64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the weighted logistic loss."""
    p = _sigmoid(x @ model)
    return x.T @ (weight * (y - p)), (x * (weight * p * (1 - p))[:, None]).T @ x


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 12, ridge: float = RIDGE) -> np.ndarray:
    model = np.zeros(x.shape[1])
    for _ in range(steps):
        gradient, hessian = _sums(x, y, np.ones(len(y)), model)
        model += np.linalg.solve(hessian + ridge * np.eye(len(model)), gradient - ridge * model)
    return model


def _calibrated(margin: np.ndarray, line: np.ndarray) -> np.ndarray:
    return _sigmoid(margin * line[0] + line[1])


def _calibration(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(slope, intercept) that turn a model's margins into probabilities, fitted on documents it has not learned from."""
    return fit_logistic(np.stack([margin, np.ones(len(y))], 1), y, ridge=0.1)


def _pseudo_sums(features: DataFrame, other: list[tuple[np.ndarray, np.ndarray]], now: list[np.ndarray]) -> list[tuple]:
    """(number of pseudo-labels, gradient, Hessian) for either view, over all documents that are not labelled. Model i of
    `now` learns from what model 1 - i of `other`, given with its calibration, is confident about."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: list | None = None
        for x in batches:
            if not len(x):
                continue
            both = [_matrix(x["text_view"]), _matrix(x["page_view"])]
            part = []
            for i in (0, 1):
                model, line = other[1 - i]
                p = _calibrated(both[1 - i] @ model, line)
                sure = (p >= CONFIDENT) | (p <= 1 - CONFIDENT)
                own = both[i][sure]
                part.append((float(sure.sum()), *_sums(own, (p[sure] > 0.5).astype(float), np.ones(len(own)), now[i])))
            total = part if total is None else [tuple(a + b for a, b in zip(s, t)) for s, t in zip(total, part)]
        if total is not None:
            for i, (n, g, h) in enumerate(total):
                flat = np.concatenate([[n], g, h.reshape(-1)])
                yield pd.DataFrame({"view": i, "at": np.arange(len(flat)), "value": flat})

    rows = features.where("NOT labelled").select("text_view", "page_view").mapInPandas(work, "view int, at int, value double")
    got = rows.groupBy("view", "at").agg(F.sum("value").alias("value")).toPandas()
    out = []
    for i in (0, 1):
        d = len(now[i])
        flat = np.zeros(1 + d + d * d)
        own = got[got["view"] == i]
        flat[own["at"].to_numpy()] = own["value"].to_numpy()
        out.append((flat[0], flat[1 : 1 + d], flat[1 + d :].reshape(d, d)))
    return out


def labelled_sample(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, quality) of the first `most` labelled documents by hash. Rows with nulls and values other than 0 and 1
    are left out; of several labels of a document the largest holds."""
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = min(1.0, 1.2 * most / max(1, known.count()))
    order = F.xxhash64("doc_id")
    return known.where(F.pmod(order, F.lit(1_000_000)) < int(share * 1_000_000) + 1).orderBy(order, "doc_id").limit(most)


def train(features: DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """([(model, calibration) of the text view, of the page view], combination) from rows of views() with `labelled` and
    `quality`. Of rows with one doc_id only one is learned from. Without labels of both kinds all weights are 0, so that
    every score is 1/2."""
    one = F.max(F.struct("text_view", "page_view", "quality")).alias("one")
    rows = features.where("labelled").groupBy("doc_id").agg(one).select("doc_id", "one.*").toPandas().sort_values("doc_id", kind="stable")
    y = rows["quality"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        probe = features.limit(1).toPandas()
        sizes = [len(probe[c].iloc[0]) // 4 if len(probe) else 1 for c in ("text_view", "page_view")]
        return [(np.zeros(n), np.zeros(2)) for n in sizes], np.zeros(3)
    both = [_matrix(rows["text_view"]), _matrix(rows["page_view"])]
    held = np.array([zlib.crc32(b"held %d" % d) % 5 == 0 for d in rows["doc_id"]])
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    learn, calibrate = ~held, held if held.any() else ~held
    models = [fit_logistic(x[learn], y[learn]) for x in both]

    def lines() -> list[np.ndarray]:
        return [_calibration((x @ m)[calibrate], y[calibrate]) for x, m in zip(both, models)]

    for _ in range(ROUNDS):
        before = list(zip([m.copy() for m in models], lines()))
        for _ in range(STEPS):
            pseudo = _pseudo_sums(features, before, models)
            for i in (0, 1):
                n, g, h = pseudo[i]
                # pseudo-labels never outweigh the labels, however many there are
                weight = min(PSEUDO_WEIGHT, learn.sum() / n) if n else 0.0
                gradient, hessian = _sums(both[i][learn], y[learn], np.ones(int(learn.sum())), models[i])
                models[i] = models[i] + np.linalg.solve(
                    hessian + weight * h + RIDGE * np.eye(len(models[i])), gradient + weight * g - RIDGE * models[i]
                )
    views_ = list(zip(models, lines()))
    z = _stacked([(x @ m) * line[0] + line[1] for x, (m, line) in zip(both, views_)])
    return views_, fit_logistic(z[calibrate], y[calibrate], ridge=0.1)


def _stacked(margins: list[np.ndarray]) -> np.ndarray:
    """Calibrated log odds of both views, bounded so that no view alone decides, and a constant."""
    return np.stack([*(np.clip(m, -8, 8) for m in margins), np.ones(len(margins[0]))], 1)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_text, p_page, p_quality) of every document, the first two calibrated. Null texts count as empty, other
    nulls as values of their own; an empty table gives no rows; rows with equal ids are scored one by one; other columns
    are not looked at. A text is read once, whole, by one task."""
    sample = labelled_sample(labels, LABELLED)
    # LABELLED rows of two numbers
    known = F.broadcast(sample.withColumnRenamed("doc_id", "known_id"))
    features = views(docs).join(known, F.col("doc_id") == F.col("known_id"), "left").withColumn("labelled", F.col("known_id").isNotNull()).drop("known_id")
    features = materialise(features, "cotraining_views")
    models, combination = train(features)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                margins = [(_matrix(x[c]) @ m) * line[0] + line[1] for c, (m, line) in zip(("text_view", "page_view"), models)]
                z = _stacked(margins) @ combination
                yield pd.DataFrame({"doc_id": x["doc_id"], "p_text": _sigmoid(margins[0]), "p_page": _sigmoid(margins[1]), "p_quality": _sigmoid(z)})

    return features.select("doc_id", "text_view", "page_view").mapInPandas(work, "doc_id long, p_text double, p_page double, p_quality double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("kept", F.col("p_quality") >= 0.5)
