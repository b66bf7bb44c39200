"""Best-fit packing by a configuration linear program over the length histogram.

Documents are tokenised and cut into pieces; the counts of pieces by length (at most `capacity` numbers, whatever the
corpus) go to the driver, which plans how to fill sequences. A configuration is a multiset of lengths that fits one
sequence; the program asks for how often each is to be used so that all pieces are covered by the fewest sequences.
Each round of multiplicative weights covers its part of the demand: prices of lengths set what a knapsack dynamic
program makes of any room, configurations are read off its values and used until a length is covered, and covered
lengths drop out. Lengths that ended in badly filled sequences then weigh more. The mean of the rounds is a fractional
cover; it is rounded, and what rounding leaves over is filled with the largest piece that fits. Pieces find their
places by their rank within their length.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, materialise, padded, slices, table

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a Python worker remembers.
CACHE_WORDS = 250_000
#: Rounds of multiplicative weights, their rate, and the part of the lengths that may drop out before prices are used
#: anew.
ROUNDS, RATE, STALE = 3, 0.5, 0.2
#: Configurations that leave more than 1 / WELL_FILLED of a sequence empty are not rounded.
WELL_FILLED = 256
#: Pieces that one group of the ranking holds on average.
RANK_GROUP = 50_000

#: Letters only, in forms that the tokenizer's normaliser does not split or join: exactly one pre-token.
_ONE_PRETOKEN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_KIND = np.zeros(256, np.uint8)  # 1 letter, 2 digit, 3 punctuation, 0 space or other
_KIND[[*range(ord("a"), ord("z") + 1)]] = 1
_KIND[[*range(ord("0"), ord("9") + 1)]] = 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 3
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class _Words:
    """Token ids of the parts of texts, each part encoded once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads only take memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, parts: list[bytes]) -> None:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        one = [p for p in parts if _ONE_PRETOKEN.fullmatch(p)]
        rest = [p for p in parts if not _ONE_PRETOKEN.fullmatch(p)]
        runs = [one[i : i + 256] for i in range(0, len(one), 256)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([b" ".join(r).decode() for r in runs], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(run) or ends[-1] != len(ids):
                rest += run
                continue
            for p, a, b in zip(run, np.concatenate([[0], ends[:-1]]), ends):
                self.known[p] = ids[a:b].tobytes()
        for p, e in zip(rest, self.tokenizer.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False)):
            self.known[p] = np.array(e.ids, np.uint32).tobytes()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of all rows, and where each row's begin.

        Texts fall into parts where the tokenizer's own splitting always cuts: at ASCII white space, between ASCII
        letters and punctuation, and around ASCII digits. Equal parts have equal ids.
        """
        buffer, bounds = padded(column)
        buffer = _LOWER[buffer]
        kind, space = _KIND[buffer], _SPACE[buffer]
        before, now = kind[:-1], kind[1:]
        cut = (before != now) & (before > 0) & (now > 0) | (before == 2) & (now == 2)
        edge = np.flatnonzero(cut | (space[:-1] != space[1:])) + 1
        edge = np.concatenate([[0], edge, [len(buffer)]])
        solid = ~space[edge[:-1]]
        starts, ends = edge[:-1][solid], edge[1:][solid]
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        size = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        different = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(size), pa.py_buffer(buffer[~space])]).dictionary_encode()
        parts, inverse = different.dictionary.to_pylist(), different.indices.to_numpy()
        if fresh := [p for p in parts if p not in self.known]:
            held = len(self.known) <= CACHE_WORDS
            self.learn(fresh if held else parts)
        ids = [self.known[p] for p in parts]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        store, at = np.frombuffer(b"".join(ids), np.uint32), np.concatenate([[0], np.cumsum(lengths)[:-1]])
        each = lengths[inverse]
        ends_out = np.cumsum(each)
        total = int(ends_out[-1])
        places = np.repeat(at[inverse] - (ends_out - each), each)
        places += np.arange(total)
        row = np.searchsorted(starts, bounds)
        return store[places], np.concatenate([[0], ends_out])[row]


@functools.cache
def _words(path: str) -> _Words:
    """One tokenizer and one memory of words for all tasks of a Python worker."""
    return _Words(path)


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: (doc_id, piece, start, length, ids_crc32[, ids]).

    A document is the ids of its text and then END_ID; a null text counts as empty. Only documents of more than
    `capacity` ids are cut, into pieces of `capacity`, the last one shorter if need be. ids are little-endian unsigned
    32-bit numbers.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = words.encode(part.column(1))
                odd = {}
                texts = part.column(1)
                for mark in words.special:
                    import pyarrow.compute as pc

                    for i in np.flatnonzero(pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)):
                        odd[int(i)] = words.whole(texts[int(i)].as_py())
                rows: list[tuple] = []
                for i, doc_id in enumerate(part.column(0).to_pylist()):
                    own = np.append(odd.get(i, ids[bounds[i] : bounds[i + 1]]), np.uint32(END_ID)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        data = own[at : at + capacity].tobytes()
                        rows.append((doc_id, k, at, len(data) // 4, zlib.crc32(data)) + ((data,) if with_ids else ()))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids,
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_arrow(docs, work, schema)


def _best_values(price: np.ndarray, sizes: np.ndarray, best: np.ndarray, take: np.ndarray, capacity: int) -> None:
    """Knapsack by dynamic program: the best value for each room up to capacity, and the size taken first (0: none)."""
    worth = price[sizes]
    best[: capacity + 1] = take[: capacity + 1] = 0
    for room in range(int(sizes[0]), capacity + 1):
        n = int(np.searchsorted(sizes, room, side="right"))
        values = worth[:n] + best[room - sizes[:n]]
        k = int(values.argmax())
        best[room], take[room] = values[k], sizes[k]


def configurations(counts: np.ndarray, capacity: int, rounds: int = ROUNDS, rate: float = RATE) -> list[tuple[tuple[int, ...], float]]:
    """The fractional solution: configurations and how often each is used, best filled first. Together they hold
    counts[n] pieces of each length n, no more and no less.
    """
    weight, part = np.ones(capacity + 1), np.arange(capacity + 1) / capacity
    used: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        # of rooms filled alike, the larger pieces fill it best: small ones still fit later
        price = weight * (part + part**2 / (2 * capacity))
        need = counts / rounds
        empty = np.zeros(capacity + 1)  # room that is left over beside the pieces of each length
        sizes, known, small = np.flatnonzero(need), 0, 0
        best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
        while len(sizes):
            if len(sizes) < (1 - STALE) * known or not known:
                _best_values(price, sizes, best, take, capacity)
                known = small = len(sizes)
            elif len(sizes) < (1 - STALE / 20) * small:  # the last pieces of a sequence decide how full it gets
                _best_values(price, sizes, best, take, capacity // 8)
                small = len(sizes)
            first = int(sizes[-1])
            config, room = [first], capacity - first
            while room >= sizes[0]:
                n = int(take[room])
                if n and not need[n]:  # covered since the prices were used: the best of the others
                    k = int(np.searchsorted(sizes, room, side="right"))
                    n = int(sizes[int((price[sizes[:k]] + best[room - sizes[:k]]).argmax())])
                if not n:
                    break
                config.append(n)
                room -= n
            held, each = np.unique(config, return_counts=True)
            share = need[held] / each
            times = share.min()
            key = tuple(sorted(config, reverse=True))
            used[key] = used.get(key, 0.0) + times
            empty[held] += each * times * room
            need[held] = np.where(share > times * (1 + 1e-9), need[held] - each * times, 0.0)
            if not need[held].all():
                sizes = sizes[need[sizes] > 0]
        weight[counts > 0] *= np.exp(rate * (empty / np.maximum(counts, 1) * rounds / capacity)[counts > 0])
    return sorted(used.items(), key=lambda x: (-sum(x[0]), -x[1], x[0]))


class _Left:
    """Pieces that have no place yet, and the configurations used so far."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts.astype(np.int64).copy()
        self.used: dict[tuple[int, ...], int] = {}

    def use(self, key: tuple[int, ...], most: int) -> int:
        sizes, each = np.unique(key, return_counts=True)
        times = min(most, int((self.counts[sizes] // each).min()))
        if times > 0:
            self.counts[sizes] -= each * times
            self.used[key] = self.used.get(key, 0) + times
        return max(times, 0)


def rounded(counts: np.ndarray, capacity: int = CAPACITY) -> _Left:
    """The fractional solution in whole numbers of sequences: rounded down, and up where the parts that were cut off
    so far, added up, make one more. Configurations that leave much room are not used; their pieces are left over."""
    left, over = _Left(counts), 0.0
    for key, share in configurations(left.counts, capacity) if counts.any() else []:
        if capacity - sum(key) > capacity // WELL_FILLED:
            break
        whole = int(share + over)
        over += share - left.use(key, whole)
        over = min(over, 1.0)
    return left


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and whole numbers of sequences that together hold exactly counts[n] pieces of each length n."""
    left = rounded(counts, capacity)
    while left.counts.any():  # the rest, largest first, each time with the largest piece that fits
        sizes = np.flatnonzero(left.counts)
        rest, room, key = left.counts.copy(), capacity, []
        while room >= sizes[0]:
            k = int(np.searchsorted(sizes, room, side="right")) - 1
            while k >= 0 and not rest[sizes[k]]:
                k -= 1
            if k < 0:
                break
            times = min(int(rest[sizes[k]]), room // int(sizes[k]))
            key += [int(sizes[k])] * times
            rest[sizes[k]] -= times
            room -= int(sizes[k]) * times
        left.use(tuple(key), 1 << 62)
    return sorted(left.used.items())


def placements(plan_: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """For each length, runs of ranks and the sequences and offsets they go to, sorted by (length, first rank)."""
    rows, sequence, taken = [], 0, np.zeros(capacity + 1, np.int64)
    for key, times in plan_:
        offset = 0
        for n in sorted(set(key), reverse=True):
            each = key.count(n)
            rows.append((n, taken[n], each, sequence, offset))
            taken[n] += each * times
            offset += n * each
        sequence += times
    rows.sort()
    return dict(zip(("length", "rank", "each", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 5).T))


def ranked(pieces: DataFrame) -> DataFrame:
    """pieces with rank: a number from 0 within each length. Groups are cut small by a hash, so that a length that
    most pieces have is not one task's work."""
    groups = max(8, pieces.count() // RANK_GROUP * 4)
    cut = pieces.withColumn("cut", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    sizes = cut.groupBy("length", "cut").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "cut", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "cut").orderBy("doc_id", "piece", "ids_crc32")
    return cut.withColumn("own", F.row_number().over(own) - 1).join(sizes, ["length", "cut"]).withColumn("rank", F.col("before") + F.col("own"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. pieces must stand on storage: they are read twice.

    Only the histogram of lengths, at most `capacity` numbers, reaches the driver; only the plan, whose size depends on
    the number of different lengths, goes back to the executors. An empty table gives no rows.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    at = placements(plan(counts, capacity), capacity)
    big = np.int64(1) << np.int64(48)
    index = at["length"] * big + at["rank"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            k = np.searchsorted(index, x["length"].to_numpy() * big + x["rank"].to_numpy(), side="right") - 1
            q = x["rank"].to_numpy() - at["rank"][k]
            out = x.drop(columns=["rank"])
            out["sequence_id"] = at["sequence"][k] + q // at["each"][k]
            out["offset"] = at["offset"][k] + q % at["each"][k] * x["length"].to_numpy()
            yield out

    fields = pieces.schema.simpleString()[len("struct<") : -1]
    rows = ranked(pieces).select(*pieces.columns, "rank")
    return rows.mapInPandas(work, ", ".join(f.replace(":", " ", 1) for f in fields.split(",")) + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence, from packed pieces with ids: (sequence_id, n_tokens, ids binary)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"),
        F.aggregate("parts", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
    )


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of all documents with their places: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return pack(materialise(tokenised(docs, path), "pack_pieces"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
