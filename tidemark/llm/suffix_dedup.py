"""Removing repeated byte strings by suffix order and longest previous factors.

A position's longest previous factor is the longest string from there that also starts earlier. In suffix order the
best earlier match is at the nearest neighbour above or below with a smaller position. A corpus is too large for one
suffix array, so that minimisers bring together only suffixes that can share `LENGTH` bytes. Each bucket of runs gets
its suffix order by rank doubling, the previous and next smaller positions in it, and from these the factor lengths and
where each factor stands earlier. A position whose factor reaches LENGTH is a later copy; one that is the source of such
a factor is the first of its copies, unless it has such a factor itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import repeats
from tidemark.llm.common import cuts, distinct_texts, gram_hash, map_arrow, materialise, shuffle_partitions, slices, stream_groups, substrings, table, text_buffer

#: Strings of so many bytes are looked for; minimisers are grams of GRAM bytes.
LENGTH, GRAM = 200, 48
#: Bytes of runs whose suffixes are sorted together.
SORT_BYTES = 2 << 20
#: Bytes of strings in one batch, and the least common length at which factors are looked for.
CHUNK, LEAST_FACTOR = 8 << 20, 64


def rank_tables(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(size, rank) for 1, 8, 16, 32 ... and `length` bytes: the rank of each position's string of that size, equal
    strings having equal ranks. Up to eight bytes are one number; then pairs of ranks are sorted, the last overlapping.
    """
    n, have, out = len(data), 1, [(1, data)]
    rank = data.astype(np.uint64)
    while have * 2 <= min(length, 8):
        rank = (rank[: n - 2 * have + 1] << np.uint64(8 * have)) | rank[have : n - have + 1]
        have *= 2
    while True:
        rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
        out.append((have, rank.astype(np.int32)))
        if have == length:
            return out
        step = min(have, length - have)
        m = n - have - step + 1
        rank = rank[:m] * np.uint64(n + 1) + rank[step : step + m]
        have += step


def smaller_neighbours(position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In suffix order, the index of the nearest smaller position before and after each; -1 and n where none is.

    By pointer jumping: all indices at once follow their neighbours' pointers while the position there is larger.
    """
    n = len(position)
    padded = np.concatenate([[-1], position, [-1]])
    previous, following = np.arange(n), np.arange(2, n + 2)
    while len(up := np.flatnonzero(padded[previous] > position)):
        previous[up] = np.concatenate([[0], previous, [0]])[previous[up]]
    while len(up := np.flatnonzero(padded[following] > position)):
        following[up] = np.concatenate([[n + 1], following, [n + 1]])[following[up]]
    return previous - 1, following - 1


def previous_factors(tables: list[tuple[int, np.ndarray]], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(factor, before, after) of the ascending positions `at`, all of which have as many bytes as the last table's
    size: the length of the longest previous factor among them, up to that size, and the two positions that can be its
    source, the nearest smaller ones in suffix order; -1 where there is none."""
    most, rank = tables[-1]
    order = at[np.lexsort((at, rank[at]))]
    factor, sources = np.zeros(len(order), np.int64), []
    for near in smaller_neighbours(order):
        some = (near >= 0) & (near < len(order))
        source = np.full(len(order), -1)
        source[some] = order[near[some]]
        factor[some] = np.maximum(factor[some], _common(tables, order[some], source[some], most))
        sources.append(source)
    back = np.argsort(order)
    return factor[back], sources[0][back], sources[1][back]


def _common(tables: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common bytes of the strings of `most` bytes at a and at b: ranks tell whether those of a table's size are equal,
    tried from the largest down, and single bytes at the end."""
    out = np.where(tables[-1][1][a] == tables[-1][1][b], most, 0)
    part = np.flatnonzero(out == 0)
    x, y, have = a[part], b[part], np.zeros(len(part), np.int64)
    sizes = tables[-2:0:-1] + tables[:1] * 7
    for size, rank in sizes:
        fits = (have + size < most) & (x + have < len(rank)) & (y + have < len(rank))
        i, j = np.minimum(x + have, len(rank) - 1), np.minimum(y + have, len(rank) - 1)
        have += np.where(fits & (rank[i] == rank[j]), size, 0)
    out[part] = have
    return out


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, bounds = text_buffer(part.column(1))
                owner = part.column(0).to_numpy()
                h, row, _, _ = repeats.runs(raw, bounds, length, GRAM)
                pair, times = np.unique(np.stack([row, h]), axis=1, return_counts=True) if len(h) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
                yield pair[1], owner[pair[0]], times

    return map_arrow(texts.select(text_number(), "text"), lambda b: repeats.gathered(parts(b)), repeats.SCHEMA)


def text_number() -> Column:
    """A number of each text, as a short form of its key."""
    return F.xxhash64("key").alias("owner")


def by_key(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of `found` by owner with the texts' keys instead: only numbers and keys are joined, no text moves."""
    return found.join(texts.select("key", text_number()), "owner").drop("owner")


def _segments(texts: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """Runs with a repeated minimiser, as strings: (h, key, first_id, first, seg)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, h, row, first, windows = _chosen_runs(part, length)
                size = windows + length - 1
                at = text_buffer(part.column(2))[1][row] + first
                for c in cuts(size, CHUNK):
                    who = pa.array(row[c])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[c]), part.column(0).take(who), part.column(1).take(who), pa.array(first[c]), substrings(raw, at[c], size[c])], names=["h", "key", "first_id", "first", "seg"]
                    )

    few = by_key(texts, found.where(F.size("few") > 0).select("owner", "few"))
    chosen = texts.join(few, "key").select("key", "first_id", "text", "few")
    return map_arrow(chosen, work, "h long, key binary, first_id long, first long, seg binary")


def _chosen_runs(part: pa.RecordBatch, length: int) -> tuple[np.ndarray, ...]:
    """(raw, h, row, first, windows): runs of (…, text, list) whose minimiser is in the row's list."""
    raw, bounds = text_buffer(part.column(2))
    h, row, first, windows = repeats.runs(raw, bounds, length, GRAM)
    wanted = part.column(3)
    owner = np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy()))
    mine = _member(h, row, wanted.flatten().to_numpy(), owner)
    return raw, h[mine], row[mine], first[mine], windows[mine]


def _member(h: np.ndarray, row: np.ndarray, wanted: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which (row, h) are among the (owner, wanted)."""
    if not len(wanted) or not len(h):
        return np.zeros(len(h), bool)
    both_h, both_row = np.concatenate([h, wanted]), np.concatenate([row, owner])
    order = np.lexsort((np.arange(len(both_h)) < len(h), both_h, both_row))
    new = np.concatenate([[True], (both_h[order][1:] != both_h[order][:-1]) | (both_row[order][1:] != both_row[order][:-1])])
    group = np.cumsum(new) - 1
    has = np.zeros(group[-1] + 1, bool)
    has[group[order >= len(h)]] = True
    out = np.zeros(len(both_h), bool)
    out[order] = has[group]
    return out[: len(h)]


def _bucketed(segments: DataFrame, length: int) -> DataFrame:
    """(key, start, stop, later): runs of window starts that occur more than once; later if they have an earlier match:
    in a text with a smaller first_id (then key), or before in the same one."""

    def sort(t: pa.Table) -> pa.RecordBatch | None:
        first = t.column("first").to_numpy()
        code, rep, sorted_ = repeats.collapsed(t.column("h").to_numpy(), t.column("seg").combine_chunks())
        size = np.diff(text_buffer(t.column("seg"))[1]) - length + 1
        copy = rep[code] != np.arange(len(code))
        shared = np.zeros(len(rep), bool)
        shared[code[copy]] = True
        # strings that stand in several places are repeated as they are: later copies whole, their first place too
        rows, starts, stops, later = [np.flatnonzero(copy)], [first[copy]], [(first + size)[copy]], [np.ones(int(copy.sum()), bool)]
        plain = rep[shared]
        rows, starts, stops, later = rows + [plain], starts + [first[plain]], stops + [(first + size)[plain]], later + [np.zeros(len(plain), bool)]
        if len(sorted_):
            rest = np.sort(rep[sorted_])  # earlier texts first, so that smaller positions are earlier
            at, start, stop, late = factored(t.column("seg").combine_chunks().take(pa.array(rest)), length)
            at = rest[at]
            rows, starts, stops, later = rows + [at], starts + [start + first[at]], stops + [stop + first[at]], later + [late]
        row = np.concatenate(rows)
        if not len(row):
            return None
        arrays = [pa.array(np.concatenate(x)) for x in (starts, stops, later)]
        return pa.RecordBatch.from_arrays([t.column("key").combine_chunks().take(pa.array(row)), *arrays], names=["key", "start", "stop", "later"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for t in stream_groups(batches, "h"):
            held.append(t)  # whole buckets: equal strings never stand in two of them
            if sum(x.nbytes for x in held) >= SORT_BYTES:
                if (out := sort(pa.concat_tables(held).combine_chunks())) is not None:
                    yield out
                held = []
        if held and (out := sort(pa.concat_tables(held).combine_chunks())) is not None:
            yield out

    dealt = segments.repartition(shuffle_partitions(segments.sparkSession), "h").sortWithinPartitions("h", "first_id", "key", "first")
    return map_arrow(dealt, work, "key binary, start long, stop long, later boolean")


def factored(segs: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, stop, later): runs of starts in different strings, the earliest first, whose longest previous
    factor reaches `length` (later) or that are the source of such a factor."""
    raw, bounds = text_buffer(segs)
    tables = rank_tables(raw, length)
    bad = np.zeros(len(raw) + 1, np.int32)
    bad[bounds[1:] - length + 1] += 1
    bad[bounds[1:]] -= 1
    at = np.flatnonzero(np.cumsum(bad[:-1])[: len(tables[-1][1])] == 0)
    # of starts that share less than this with any other, no factor is long enough to matter
    rank = next(r for size, r in tables if size >= min(LEAST_FACTOR, length))[at]
    at = at[np.bincount(rank)[rank] > 1]
    factor, *sources = previous_factors(tables, at)
    last = tables[-1][1]
    state = np.zeros(len(raw), np.int8)
    late = factor >= length
    for source in sources:
        from_ = source[late]
        from_ = from_[(from_ >= 0) & (last[from_] == last[at[late]])]
        state[from_] = 1
    state[at[late]] = 2
    hit = np.flatnonzero(state)
    row = np.searchsorted(bounds, hit, side="right") - 1
    new = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (row[1:] != row[:-1]) | (state[hit[1:]] != state[hit[:-1]])])[: len(hit)])
    size = np.diff(np.concatenate([new, [len(hit)]]))
    start = hit[new] - bounds[row[new]]
    return row[new], start, start + size, state[hit[new]] == 2


def _hot_windows(texts: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """(key, start, stop, later) of the runs whose minimiser is too common for one bucket: each window is a string."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, _, row, first, windows = _chosen_runs(part, length)
                if not len(row):
                    continue
                whole, bounds = gram_hash(raw, length).view(np.int64), text_buffer(part.column(2))[1]
                owner, rank = part.column(0).to_numpy(), part.column(1).to_numpy()
                for c in cuts(windows * length, CHUNK):
                    stop = np.cumsum(windows[c])
                    of = np.repeat(row[c], windows[c])
                    place = np.arange(int(stop[-1])) + np.repeat(first[c] - (stop - windows[c]), windows[c])
                    at = bounds[of] + place
                    yield whole[at], owner[of], rank[of], place, substrings(raw, at, np.full(len(at), length))

    hot = by_key(texts, found.where(F.size("many") > 0).select("owner", "many"))
    chosen = texts.join(hot, "key").select(text_number(), "first_id", "text", "many")
    rows = map_arrow(chosen, lambda b: repeats.string_rows(parts(b), False), repeats.STRINGS)
    return by_key(texts, repeats.repeated_strings(rows, False)).select("key", "start", "stop", "later")


def dedup(docs: DataFrame, length: int = LENGTH, keep_first: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, cut): rows has (doc_id, key) of each document, cut for each key, that is each different text,
    (key, n_bytes, n_removed, n_spans, spans, kept binary).

    Texts are UTF-8 bytes, null is empty, and no match crosses documents. A byte is removed if a string of `length`
    bytes that covers it also starts anywhere else; with keep_first, only if it starts earlier: in a text with a
    smaller doc_id, or before in this one. spans are the maximal removed runs (start, stop). Rows with equal texts are
    copies of each other. An empty table gives no rows; other columns are not looked at. A text is worked on by one task
    at a time, in memory of some 30 times its size; its strings travel in batches of CHUNK bytes.
    """
    rows, texts = distinct_texts(docs, "suffix_texts")
    found = materialise(repeats.lists(repeats.repeated(_anchors(texts, length))), "suffix_lists")
    spans = _bucketed(_segments(texts, found, length), length).unionByName(_hot_windows(texts, found, length))
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("start", "stop", "later")).alias("found"))
    cut = texts.join(spans, "key", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _cut(part, length, keep_first)

    return_schema = "key binary, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,stop:long>>, kept binary"
    return rows, map_arrow(cut.select("key", "text", "copies", "found"), work, return_schema)


def _cut(part: pa.RecordBatch, length: int, keep_first: bool) -> pa.RecordBatch:
    columns = {n: part.column(i) for i, n in enumerate(part.schema.names)}
    out: dict[str, list] = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "spans", "kept")}
    copies, found = columns["copies"].to_pylist(), columns["found"]
    ends = found.offsets.to_numpy()
    start, stop, later = (found.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    raw, bounds = text_buffer(columns["text"])
    for i in range(part.num_rows):
        own = raw[bounds[i] : bounds[i + 1]]
        n = len(own)
        # where more removed strings begin than end, counted from the first byte on
        change = np.zeros(n + 1, np.int32)
        if n >= length and copies[i] > 1 and not keep_first:
            change[[0, n]] += (1, -1)
        mine = slice(ends[i], ends[i + 1]) if found[i].is_valid else slice(0, 0)
        some = later[mine] | (not keep_first)
        np.add.at(change, start[mine][some], 1)
        np.add.at(change, stop[mine][some] + length - 1, -1)
        gone = np.cumsum(change[:n]) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        out["n_bytes"].append(n)
        out["n_removed"].append(int(gone.sum()))
        out["n_spans"].append(len(edge) // 2)
        out["spans"].append([{"start": int(a), "stop": int(b)} for a, b in edge.reshape(-1, 2)])
        out["kept"].append(own[~gone].tobytes())
    kinds = [pa.int64()] * 3 + [pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
    return pa.RecordBatch.from_arrays([columns["key"], *(pa.array(v, k) for v, k in zip(out.values(), kinds))], names=["key", *out])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All copies of repeated strings of 200 bytes removed."""
    rows, cut = dedup(table(spark, sf_dir, "documents"), keep_first=False)
    digest = cut.select("key", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return rows.join(digest, "key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
