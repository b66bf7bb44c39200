"""What the two substring operators share: minimiser runs, and finding the keys and strings that occur more than once.

A window of `span` units has a minimiser: the gram of `gram` units in it whose hash is smallest (the first, if equal).
Equal windows have equal minimisers at equal places, so that windows need only be compared where minimisers repeat.
Consecutive windows with one minimiser make a run, which travels as one string to the minimiser's bucket.

A minimiser with more than MOST_RUNS runs would make too large a bucket. It gives way to the longest one, the window
itself: windows of such runs travel as strings of their own, after each task has put equal ones together, and are
sorted in buckets of single windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import gram_hash, map_arrow, shuffle_partitions, slide_argmin, stream_groups

#: Rows that a task gathers before it combines them, and what a key's runs may number to be compared in one place.
GATHER, MOST_RUNS = 1_500_000, 2000
#: Bytes of window strings that a task gathers before it combines them.
GATHER_BYTES = 24 << 20


def runs(values: np.ndarray, bounds: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first, windows) of each run of a buffer of units, rows being given by bounds.

    first is the start of the first window, counted from the start of its row; no window crosses rows. What a window's
    minimiser is depends on the window alone: whole hashes are compared, then places.
    """
    n = len(values)
    empty = np.zeros(0, np.int64)
    if n < span:
        return empty, empty, empty, empty
    hashes = gram_hash(values, gram)
    least = slide_argmin(hashes, span - gram + 1)
    bad = np.zeros(n + 1, np.int32)
    row_from, row_to = bounds[:-1], bounds[1:]
    filled = row_to > row_from
    np.add.at(bad, np.maximum(row_from, row_to - span + 1)[filled], 1)
    np.add.at(bad, row_to[filled], -1)
    valid = np.cumsum(bad[:-1])[: len(least)] == 0
    at = np.flatnonzero(valid)
    if not len(at):
        return empty, empty, empty, empty
    anchor = least[at]
    row = np.searchsorted(bounds, at, side="right") - 1
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    first, row = at[new], row[new]
    count = np.diff(np.concatenate([new, [len(at)]]))
    return hashes[anchor[new]].view(np.int64), row, first - bounds[row], count


def _combined(key: np.ndarray, owner: np.ndarray, times: np.ndarray, distinct: bool = False) -> pa.RecordBatch:
    """One row per (key, owner) of what a task has gathered; state 2 need not meet other tasks' rows, as another owner
    here has the key; 1 is known to be repeated too; 0 is yet to be seen."""
    order = np.lexsort((owner, key))
    key, owner, times = key[order], owner[order], times[order]
    if distinct and len(key):
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]))
        key, owner, times = key[new], owner[new], times[new]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    alone = first & np.concatenate([first[1:], [True]])
    state = np.where(first, np.where(alone & (times < 2), 0, 1), 2).astype(np.int8)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(owner), pa.array(times.astype(np.int32)), pa.array(state)], names=["h", "owner", "n", "state"])


def gathered(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], distinct: bool = False) -> Iterator[pa.RecordBatch]:
    """Combine (key, owner, times) arrays of a task, a million or so at once. distinct: one owner with a key in several
    rows has it once, else each row counts."""
    held: list[tuple] = []
    for part in parts:
        held.append(part)
        if sum(len(x[0]) for x in held) >= GATHER:
            yield _combined(*(np.concatenate(x) for x in zip(*held)), distinct)
            held = []
    if held and sum(len(x[0]) for x in held):
        yield _combined(*(np.concatenate(x) for x in zip(*held)), distinct)


SCHEMA = "h long, owner long, n int, state byte"


def _in_keys(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Batches sorted by key as tables of about `rows` rows or GATHER_BYTES, no key being split."""
    held: list[pa.Table] = []
    for t in stream_groups(batches, key):
        held.append(t)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= GATHER_BYTES:
            yield pa.concat_tables(held).combine_chunks()
            held = []
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _met(rows: DataFrame) -> DataFrame:
    """Rows dealt by h and sorted, but those that need not meet others dealt evenly."""
    where = F.when(F.col("state") == 2, F.xxhash64("owner", "h")).otherwise(F.col("h"))
    return rows.repartition(shuffle_partitions(rows.sparkSession), where).sortWithinPartitions("h")


def repeated(rows: DataFrame, distinct: bool = False) -> DataFrame:
    """(h, owner, n) of all keys that occur more than once in rows of SCHEMA from gathered().

    One shuffle and no hot task: of the rows of a key that a task has gathered, one meets the other tasks' by key; the
    others are known to be repeated already, and go elsewhere.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _in_keys(batches, "h", 250_000):
            h, owner, n, state = (t.column(i).to_numpy() for i in range(4))
            if distinct:
                order = np.lexsort((-state, owner, h))
                h, owner, n, state = h[order], owner[order], n[order], state[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]))
                h, owner, n, state = h[new], owner[new], n[new], state[new]
            meets = np.flatnonzero(state < 2)
            k = h[meets]
            first = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
            alone = first & np.concatenate([first[1:], [True]]) if len(k) else first
            keep = np.ones(len(h), bool)
            keep[meets] = ~alone | (state[meets] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(owner[keep]), pa.array(n[keep])], names=["h", "owner", "n"])

    return map_arrow(_met(rows), work, "h long, owner long, n int")


def lists(found: DataFrame) -> DataFrame:
    """(owner, few, many): the repeated keys of each owner; those with up to MOST_RUNS runs in all, and the others.

    Only the keys with too many runs are joined back, and Spark broadcasts them where they are few."""
    hot = found.groupBy("h").agg(F.sum("n").alias("runs")).where(F.col("runs") > MOST_RUNS).select("h", F.lit(True).alias("hot"))
    joined = found.select("h", "owner").join(hot, "h", "left")
    return joined.groupBy("owner").agg(
        F.collect_list(F.when(F.col("hot").isNull(), F.col("h"))).alias("few"),
        F.collect_list(F.when(F.col("hot"), F.col("h"))).alias("many"),
    )


def collapsed(h: np.ndarray, segs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, rep, several): code of each string, equal strings having equal codes; the first row with each code; and
    the codes in buckets of several different strings, which alone can share windows without being equal. (Windows of
    one run have different places of the minimiser, so that no string repeats a window of its own.)"""
    code = segs.dictionary_encode().indices.to_numpy()
    _, rep = np.unique(code, return_index=True)
    bucket, where = np.unique(h[rep], return_inverse=True)
    return code, rep, np.flatnonzero(np.bincount(where, minlength=len(bucket))[where] > 1)


STRINGS = "h long, owner long, rank long, first long, stop long, state byte, seg binary, also array<long>"


def _sorted_strings(rank: np.ndarray, owner: np.ndarray, first: np.ndarray, segs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, head, size): rows by string, then rank, owner and place; the row of order that each one's string begins
    with, and how many it has."""
    code = segs.dictionary_encode().indices.to_numpy()
    order = np.lexsort((first, owner, rank, code))
    new = np.concatenate([[True], code[order][1:] != code[order][:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order, head, np.bincount(head, minlength=len(order))[head]


def string_rows(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]], same_rank: bool) -> Iterator[pa.RecordBatch]:
    """Rows of STRINGS from (h, owner, rank, first, string) arrays of single windows of a task.

    Equal strings are put together: the first of each, by rank, owner and place, meets other tasks'; the others are
    known to be repeated by an earlier one, and become runs of places. same_rank: only a smaller rank counts as earlier, so
    that for each owner with the first one's rank one row meets others', with the owner's other places (also).
    """
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        h, owner, rank, first = (np.concatenate(x) for x in list(zip(*held))[:4])
        segs = pa.concat_arrays([x[4] for x in held])
        order, head, size = _sorted_strings(rank, owner, first, segs)
        meets = head == np.arange(len(order))
        along = np.zeros(len(order), bool)  # of the row before that meets
        if same_rank:
            of = owner[order]
            along = (rank[order] == rank[order[head]]) & ~meets
            first_here = along & np.concatenate([[True], of[1:] != of[:-1]])
            meets, along = meets | first_here, along & ~first_here
        go = order[meets]
        begin = np.flatnonzero(meets)
        upto = np.concatenate([[0], np.cumsum(along)])
        each = upto[np.concatenate([begin[1:], [len(order)]])] - upto[begin]
        also = first[order[along]]
        rest = ~meets & ~along
        o, f, s = spans(owner[order[rest]], first[order[rest]])
        zero = np.zeros(len(o), np.int64)
        state = np.concatenate([np.where(size[meets] > 1, 1, 0), np.full(len(o), 2)]).astype(np.int8)
        cols = [np.concatenate(x) for x in ((h[go], o), (owner[go], o), (rank[go], zero), (first[go], f), (first[go] + 1, s))]
        strings = pa.concat_arrays([segs.take(pa.array(go)), pa.nulls(len(o), pa.binary())])
        offsets = np.concatenate([[0], np.cumsum(each), np.full(len(o), len(also))]).astype(np.int32)
        lists_ = pa.ListArray.from_arrays(pa.array(offsets), pa.array(also))
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(state), strings, lists_], names=["h", "owner", "rank", "first", "stop", "state", "seg", "also"])

    for part in parts:
        held.append(part)
        if sum(x[4].nbytes for x in held) >= GATHER_BYTES:
            yield flush()
            held.clear()
    if held:
        yield flush()


def spans(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, stop): places as runs."""
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] > place[:-1] + 1)])[: len(owner)])
    last = np.concatenate([new[1:], [len(owner)]])[: len(new)] - 1
    return owner[new], place[new], place[last] + 1


def repeated_strings(rows: DataFrame, same_rank: bool) -> DataFrame:
    """(owner, start, stop, later): runs of places of strings that occur more than once, from rows of STRINGS; later if
    one of smaller rank has the string, or without same_rank also the same one before."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _in_keys(batches, "h", 250_000):
            owner, rank, first, stop, state = (t.column(i).to_numpy() for i in range(1, 6))
            done = state == 2
            out = [(owner[done], first[done], stop[done], np.ones(int(done.sum()), bool))]
            if len(go := np.flatnonzero(~done)):
                order, head, size = _sorted_strings(rank[go], owner[go], first[go], t.column("seg").combine_chunks().take(pa.array(go)))
                at, top = go[order], go[order[head]]
                known = np.bincount(head, state[at], len(head))[head] > 0
                late = rank[at] > rank[top] if same_rank else at != top
                also = t.column("also").combine_chunks()
                upto, places = also.offsets.to_numpy(), also.values.to_numpy()
                for kind in (True, False):
                    mine = at[((size > 1) | known) & (late == kind)]
                    each = upto[mine + 1] - upto[mine]
                    more = places[np.arange(each.sum()) + np.repeat(upto[mine] - (np.cumsum(each) - each), each)]
                    o, f, s = spans(np.concatenate([owner[mine], np.repeat(owner[mine], each)]), np.concatenate([first[mine], more]))
                    out.append((o, f, s, np.full(len(o), kind)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["owner", "start", "stop", "later"])

    return map_arrow(_met(rows), work, "owner long, start long, stop long, later boolean")
