"""Periodic runs of words, by recursive frequency splitting and a lag scan.

A run of period q has at least four periods, so that each of its words stands in it four times or more. A word that
occurs less often within a segment can be in none of the segment's runs, and splits it; the parts, where words occur
less often still, are split again until nothing changes. All documents of a slice are split together, a round being one
sort. Few segments survive, and their lags are scanned all at once: a run of period q holds three multiples of q, one
after the other, whose words equal those q further on, so that n / q comparisons tell the places to look at for lag q,
and n log n for all lags of a segment of n words. Those places are followed to both sides to their ends.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, padded, slices, table, words_of

#: A run has at least so many periods, and so many words.
PERIODS, LEAST_WORDS = 4, 6
#: Comparisons that the lag scan of one segment holds at a time.
BLOCK = 1 << 16
#: Places that are looked at before a stretch is followed to its ends.
PROBES = 12

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string"


def surviving(words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
    """Segments (start, end) of the rows of words, none of which a rare word splits any more.

    words are numbers; row i is words[bounds[i]:bounds[i + 1]]. A round counts the words of each segment that changed
    in the round before, and splits it at those that occur fewer than PERIODS times; parts of fewer than LEAST_WORDS
    words hold no run and go.
    """
    at = np.arange(len(words))  # places that are still looked at
    segment = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    done: list[tuple[int, int]] = []
    kinds = int(words.max()) + 1 if len(words) else 1
    while len(at):
        _, inverse, n = np.unique(segment * kinds + words[at], return_inverse=True, return_counts=True)
        often = n[inverse] >= PERIODS
        # a segment without a rare word stands
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        size = np.diff(np.append(first, len(segment)))
        whole = np.add.reduceat(often, first, dtype=np.int64) == size
        done += [(int(at[f]), int(at[f]) + int(s)) for f, s in zip(first[whole], size[whole]) if s >= LEAST_WORDS]
        stay = often & ~np.repeat(whole, size)
        at, old = at[stay], segment[stay]
        if not len(at):
            break
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (old[1:] != old[:-1])])
        segment = np.cumsum(new) - 1
        large = np.bincount(segment)[segment] >= LEAST_WORDS
        at, segment = at[large], segment[large]
    return sorted(done)


def _same(words: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words equal each other one after the other, from i and j > i on (step 1) or back (step -1)."""
    total, block = 0, 32
    while True:
        n = min(block, len(words) - j if step > 0 else i + 1)
        if n <= 0:
            return total
        a = words[i : i + n] if step > 0 else words[i - n + 1 : i + 1][::-1]
        b = words[j : j + n] if step > 0 else words[j - n + 1 : j + 1][::-1]
        differ = np.flatnonzero(a != b)
        if len(differ):
            return total + int(differ[0])
        total, i, j, block = total + n, i + step * n, j + step * n, block * 2


class _Found:
    """Runs found so far. Those of one period come in order of start, and so of end."""

    def __init__(self) -> None:
        self.starts: dict[int, list[int]] = {}
        self.ends: dict[int, list[int]] = {}

    def add(self, start: int, end: int, period: int) -> None:
        self.starts.setdefault(period, []).append(start)
        self.ends.setdefault(period, []).append(end)

    def holds(self, start: int, end: int, divides: int = 0) -> bool:
        """Whether one run holds all words from start to end; with `divides`, one whose period divides it."""
        for period, starts in self.starts.items():
            if divides % period == 0:
                k = bisect_right(starts, start) - 1
                if k >= 0 and self.ends[period][k] >= end:
                    return True
        return False

    def multiples(self, place: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Which stretches of PERIODS - 1 periods lie in a run whose period divides theirs."""
        out = np.zeros(len(place), bool)
        for r, starts in self.starts.items():
            some = np.flatnonzero((period % r == 0) & ~out)
            k = np.searchsorted(starts, place[some], side="right") - 1
            out[some] = (k >= 0) & (np.array(self.ends[r])[k] >= place[some] + (PERIODS - 1) * period[some])
        return out


def lag_scan(words: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a segment, by start and then period.

    Lags are scanned in ascending order. A place whose stretch lies in a run whose period divides the lag tells of that
    run alone; a stretch that a run of smaller period holds does not have the lag as its smallest period.
    """
    n, lag, found = len(words), 1, _Found()
    while lag * PERIODS <= n:
        lags, held = [], 0  # as many lags at once as BLOCK comparisons allow
        while lag * PERIODS <= n and (not lags or held < BLOCK):
            lags.append(lag)
            held += (n - 1) // lag - PERIODS + 2
            lag += 1
        q = np.array(lags)
        each = (n - 1) // q - PERIODS + 2
        period = np.repeat(q, each)
        place = (np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)) * period
        for k in range(PERIODS - 1):
            hit = words[place + k * period] == words[place + (k + 1) * period]
            place, period = place[hit], period[hit]
        for k in range(1, PROBES + 1):  # words between these places have to be equal too
            between = place + k * (PERIODS - 2) * period // (PROBES + 1)
            hit = words[between] == words[between + period]
            place, period = place[hit], period[hit]
        fresh = ~found.multiples(place, period)
        last, end = 0, -1
        for p, q_ in zip(place[fresh].tolist(), period[fresh].tolist()):
            if q_ == last and p < end:
                continue  # within the stretch that was followed last
            if found.holds(p, p + (PERIODS - 1) * q_, q_):
                continue  # a run of this very block
            start = p - _same(words, p - 1, p - 1 + q_, -1)
            last, end = q_, p + _same(words, p, p + q_, 1)
            if end + q_ - start >= max(LEAST_WORDS, PERIODS * q_) and not found.holds(start, end + q_):
                found.add(start, end + q_, q_)
    return sorted(((s, e - s, q) for q, starts in found.starts.items() for s, e in zip(starts, found.ends[q])), key=lambda r: (r[0], r[2]))


def repeated_words(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words of a document as the query takes them: by a hash of doc_id, one in ten repeats its end periodically."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = words.copy()
    i = np.arange(a, n)
    out[a:] = words[a + (i - a) % p]
    return out


def runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """doc_id, n_words, runs (by start and then period) and kept_text of each document.

    kept_text is the words that no run holds after its first period, joined by one space. With `planted`, words are
    changed by `repeated_words` first. A null text has no words; a null doc_id stays null and changes nothing; texts of
    any length are taken whole, by one task each; repeated rows are looked at one by one; columns of docs may have any
    names; an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _slice_runs(part, planted)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_arrow(docs, work, SCHEMA)


def _slice_runs(part: pa.RecordBatch, planted: bool) -> pa.RecordBatch:
    buffer, bounds = padded(part.column(1))
    starts, ends = words_of(buffer)
    size = np.concatenate([[0], np.cumsum(ends - starts)])
    inside = np.zeros(len(buffer) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    letters = buffer[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(size.astype(np.int32)), pa.py_buffer(letters)])
    different = column.dictionary_encode()
    known, words = different.dictionary.to_pylist(), different.indices.to_numpy().astype(np.int64)
    row = np.searchsorted(starts, bounds)
    ids = part.column(0).to_pylist()
    if planted:
        words = np.concatenate([repeated_words(words[a:b], i) for i, a, b in zip(ids, row[:-1], row[1:])]) if len(words) else words
    gone = np.zeros(len(words) + 1, np.int32)
    found: list[list[tuple[int, int, int]]] = [[] for _ in ids]
    for a, b in surviving(words, row):
        i = int(np.searchsorted(row, a, side="right")) - 1
        for start, length, period in lag_scan(words[a:b]):
            found[i].append((a + start - int(row[i]), length, period))
            gone[a + start + period] += 1
            gone[a + start + length] -= 1
    kept = np.cumsum(gone[:-1]) == 0
    texts = []
    for a, b in zip(row[:-1].tolist(), row[1:].tolist()):
        own = words[a:b][kept[a:b]].tolist()
        texts.append(b" ".join([known[w] for w in own]).decode())
    flat = [r for rows in found for r in rows]
    offsets = np.concatenate([[0], np.cumsum([len(rows) for rows in found])]).astype(np.int32)
    fields = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
    return pa.RecordBatch.from_arrays(
        [
            part.column(0),
            pa.array(np.diff(row)),
            pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"])),
            pa.array(texts, pa.string()),
        ],
        names=["doc_id", "n_words", "runs", "kept_text"],
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the runs: the one of the greatest length / period (compared in whole numbers; of equal ones the first
    by start and then period), all runs as lines, and the text without repetitions."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return runs(table(spark, sf_dir, "documents"), planted=True).withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )
