"""Removing repeated word windows by super-k-mer partitioning.

Consecutive windows of words that share a minimiser travel as one packed string to the minimiser's bucket. There the
words get exact numbers, the windows are sorted, and each knows in how many places, and in which smallest doc_id, it
starts. Only strings whose minimiser repeats travel at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import repeats
from tidemark.llm.common import NO_ID, cuts, distinct_texts, gram_hash, map_arrow, materialise, padded, shuffle_partitions, slices, stream_groups, substrings, table, text_buffer, word_hashes, words_of
from tidemark.llm.suffix_dedup import _member, by_key, text_number

#: Words of a window, and of the grams that minimisers are.
WINDOW, GRAM = 13, 4
#: Bytes of packed strings whose windows are sorted together.
SORT_BYTES = 2 << 20
#: Bytes of packed strings in one batch.
CHUNK = 8 << 20


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, ends, hashes, bounds) of the words of some rows; bounds count words."""
    buffer, rows = padded(column)
    starts, ends = words_of(buffer)
    return buffer, starts, ends, word_hashes(buffer, starts, ends), np.searchsorted(starts, rows)


def _anchors(texts: DataFrame, window: int) -> DataFrame:
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, _, _, hashes, bounds = _words(part.column(1))
                h, row, _, _ = repeats.runs(hashes, bounds, window, GRAM)
                if not len(h):
                    continue
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))
                yield h[new], part.column(0).to_numpy()[row[new]], np.diff(np.concatenate([new, [len(h)]]))

    return map_arrow(texts.select(text_number(), "text"), lambda b: repeats.gathered(parts(b)), repeats.SCHEMA)


def _super_kmers(part: pa.RecordBatch, window: int) -> Iterator[tuple]:
    """(h, row, first, windows, words, buffer, stop): super-k-mers of (…, text, list) rows whose minimiser is in the row's
    list, some at once; words has the numbers of their words one after the other, which end at stop in buffer, each with
    a space behind it."""
    buffer, starts, ends, hashes, bounds = _words(part.column(2))
    h, row, first, windows = repeats.runs(hashes, bounds, window, GRAM)
    wanted = part.column(3)
    mine = _member(h, row, wanted.flatten().to_numpy(), np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy())))
    h, row, first, windows = h[mine], row[mine], first[mine], windows[mine]
    at, size = bounds[row] + first, windows + window - 1
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends - starts + 1)])
    for c in cuts(upto[at + size] - upto[at], CHUNK):
        to = np.cumsum(size[c])
        word = np.arange(int(to[-1])) + np.repeat(at[c] - (to - size[c]), size[c])
        width = ends[word] - starts[word] + 1
        stop = np.cumsum(width)
        data = buffer[np.arange(int(stop[-1])) + np.repeat(starts[word] - (stop - width), width)]
        data[stop - 1] = 32
        yield h[c], row[c], first[c], windows[c], hashes[word], data, stop


def _packed(texts: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """Super-k-mers with a repeated minimiser: (h, key, first_id, first, seg), words joined by one space."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for h, row, first, windows, _, data, stop in _super_kmers(part, window):
                    offsets = np.concatenate([[0], stop[np.cumsum(windows + window - 1) - 1]]).astype(np.int32)
                    seg = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                    who = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(h), part.column(0).take(who), part.column(1).take(who), pa.array(first), seg], names=["h", "key", "first_id", "first", "seg"])

    few = by_key(texts, found.where(F.size("few") > 0).select("owner", "few"))
    chosen = texts.join(few, "key").select("key", "first_id", "text", "few")
    return map_arrow(chosen, work, "h long, key binary, first_id long, first long, seg binary")


def window_ranks(numbers: np.ndarray, length: int) -> np.ndarray:
    """Rank of each run of `length` numbers, equal runs having equal ranks, by sorting pairs of ranks."""
    have, rank, n = 1, numbers.astype(np.uint64), len(numbers)
    while have < length:
        step = min(have, length - have)
        m = n - have - step + 1
        rank = np.unique(rank[:m] * np.uint64(n + 1) + rank[step : step + m], return_inverse=True)[1].astype(np.uint64)
        have += step
    return rank.astype(np.int64)


def _bucketed(packed: DataFrame, window: int) -> DataFrame:
    """(key, start, stop): runs of window starts whose words also start in a smaller doc_id."""

    def sort(t: pa.Table) -> pa.RecordBatch | None:
        owner, first = t.column("first_id").to_numpy(), t.column("first").to_numpy()
        segs = t.column("seg").combine_chunks()
        code, rep, several = repeats.collapsed(t.column("h").to_numpy(), segs)
        least = np.full(len(rep), NO_ID)
        np.minimum.at(least, code, owner)
        # an equal string in a smaller document: all its windows are there
        copy = np.flatnonzero(owner > least[code])
        raw, bounds = text_buffer(segs)
        spaces = np.concatenate([[0], np.cumsum(raw == 32)])
        windows = spaces[bounds[1:]] - spaces[bounds[:-1]] - window + 1
        rows, starts, stops = [copy], [first[copy]], [(first + windows)[copy]]
        if len(several):
            at, start, stop = ordered(segs.take(pa.array(rep[several])), least[several])
            # these hold for the rows of that string with its smallest doc_id
            mine = np.flatnonzero(owner == least[code])
            mine = mine[np.argsort(code[mine], kind="stable")]
            low = np.searchsorted(code[mine], several[at], side="left")
            many = np.searchsorted(code[mine], several[at], side="right") - low
            row = mine[np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)] if len(at) else np.zeros(0, np.int64)
            rows, starts, stops = rows + [row], starts + [np.repeat(start, many) + first[row]], stops + [np.repeat(stop, many) + first[row]]
        row = np.concatenate(rows)
        if not len(row):
            return None
        return pa.RecordBatch.from_arrays([t.column("key").combine_chunks().take(pa.array(row)), *(pa.array(np.concatenate(x)) for x in (starts, stops))], names=["key", "start", "stop"])

    def ordered(segs: pa.Array, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, start, stop): windows of different strings that also stand in one with a smaller owner."""
        raw, bounds = text_buffer(segs)
        space = np.flatnonzero(raw == 32)
        offsets = np.concatenate([[0], space - np.arange(len(space))]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(space), [None, pa.py_buffer(offsets), pa.py_buffer(raw[raw != 32])])
        rank = window_ranks(words.dictionary_encode().indices.to_numpy(), window)
        edge = np.searchsorted(space, bounds)  # words before each string
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(edge))[: len(rank)]
        at = np.flatnonzero(np.arange(len(rank)) + window <= edge[row + 1])
        order = np.lexsort((owner[row[at]], rank[at]))
        r, o = rank[at][order], owner[row[at]][order]
        new = np.concatenate([[True], r[1:] != r[:-1]])
        least = o[np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))]
        hit = np.sort(at[order[o > least]])
        row = row[hit]
        cut = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (row[1:] != row[:-1])])[: len(hit)])
        size = np.diff(np.concatenate([cut, [len(hit)]]))
        start = hit[cut] - edge[row[cut]]
        return row[cut], start, start + size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for t in stream_groups(batches, "h"):
            held.append(t)  # whole buckets: equal windows never stand in two of them
            if sum(x.nbytes for x in held) >= SORT_BYTES:
                if (out := sort(pa.concat_tables(held).combine_chunks())) is not None:
                    yield out
                held = []
        if held and (out := sort(pa.concat_tables(held).combine_chunks())) is not None:
            yield out

    dealt = packed.repartition(shuffle_partitions(packed.sparkSession), "h").sortWithinPartitions("h")
    return map_arrow(dealt, work, "key binary, start long, stop long")


def _hot_windows(texts: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """(key, start, stop) of windows that also start in a smaller doc_id, of minimisers too common for one bucket: each
    window is a packed string of its own."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for part in slices(batch, "text"):
                owner, rank = part.column(0).to_numpy(), part.column(1).to_numpy()
                for _, row, first, windows, hashes, data, stop in _super_kmers(part, window):
                    size = windows + window - 1
                    of = np.repeat(np.arange(len(row)), windows)
                    place = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
                    word = np.repeat(np.cumsum(size) - size, windows) + place
                    begin = np.concatenate([[0], stop])
                    width = begin[word + window] - 1 - begin[word]
                    whole = gram_hash(hashes, window).view(np.int64)[word]
                    for c in cuts(width, CHUNK):
                        yield whole[c], owner[row[of[c]]], rank[row[of[c]]], (first[of] + place)[c], substrings(data, begin[word[c]], width[c])

    hot = by_key(texts, found.where(F.size("many") > 0).select("owner", "many"))
    chosen = texts.join(hot, "key").select(text_number(), "first_id", "text", "many")
    rows = map_arrow(chosen, lambda b: repeats.string_rows(parts(b), True), repeats.STRINGS)
    later = repeats.repeated_strings(rows, True).where("later")
    # a text's runs come together before the texts' keys are looked up: one row for each text is joined, not one for each run
    runs = later.groupBy("owner").agg(F.collect_set(F.struct("start", "stop")).alias("runs"))
    return by_key(texts, runs).select("key", F.inline("runs"))


def _cut(part: pa.RecordBatch, window: int) -> pa.RecordBatch:
    column = {n: part.column(i) for i, n in enumerate(part.schema.names)}
    buffer, starts, ends, _, bounds = _words(column["text"])
    data = buffer.tobytes()
    to = column["found"].offsets.to_numpy()
    start, stop = (column["found"].values.field(k).to_numpy() for k in range(2))
    count, removed, kept = [], [], []
    for i in range(part.num_rows):
        a, b = int(bounds[i]), int(bounds[i + 1])
        n = b - a
        change = np.zeros(n + window + 1, np.int32)
        mine = slice(to[i], to[i + 1]) if column["found"][i].is_valid else slice(0, 0)
        # each window start covers itself and the words after it
        np.add.at(change, start[mine], 1)
        np.add.at(change, stop[mine] + window - 1, -1)
        gone = np.cumsum(change[:n]) > 0
        left = np.flatnonzero(~gone) + a
        count.append(n)
        removed.append(int(gone.sum()))
        kept.append(b" ".join([data[x:y] for x, y in zip(starts[left].tolist(), ends[left].tolist())]).decode())
    return pa.RecordBatch.from_arrays(
        [column["key"], column["first_id"], pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
        names=["key", "first_id", "n_words", "n_removed", "kept"],
    )


def dedup(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(rows, cut): rows has (doc_id, key) of each document; cut, for each key, that is each different text,
    (key, first_id, n_words, n_removed, kept), which is what is left of it in its smallest doc_id.

    A word is removed if a window of `window` words that covers it also starts in a document with a smaller doc_id.
    In a copy of a text under a larger doc_id every window does. A null text has no words; a null doc_id is larger than
    any other; documents with equal ids are not smaller than each other. An empty table gives no rows; other columns are
    not looked at. A text, and a word, may be of any length; a text is worked on by one task at a time.
    """
    rows, texts = distinct_texts(docs, "window_texts")
    found = materialise(repeats.lists(repeats.repeated(_anchors(texts, window))), "window_lists")
    spans = _bucketed(_packed(texts, found, window), window).unionByName(_hot_windows(texts, found, window))
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    joined = texts.join(spans, "key", "left").select("key", "first_id", "text", "found")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _cut(part, window)

    return rows, map_arrow(joined, work, "key binary, first_id long, n_words long, n_removed long, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cut = dedup(table(spark, sf_dir, "documents"))
    cut = cut.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256)).drop("kept")
    copy = (F.coalesce("doc_id", F.lit(NO_ID)) > F.col("first_id")) & (F.col("n_words") >= WINDOW)
    return rows.join(cut, "key").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
