"""Packing along a space-filling curve: documents that are alike share sequences, and nothing is padded.

A document's token ids, hashed to a vector of BUCKETS signed counts and projected to DIMENSIONS numbers, make a point;
its place on a Hilbert curve through all points is the key that documents are range-sorted by. Laid end to end in that
order, neighbours on the curve are neighbours in the stream of ids, which is cut every `capacity` ids. What is left at
the end of the stream is cut by powers of two.

Ids travel through one shuffle, as two bytes each where the vocabulary allows it. The driver sees two sums for each
dimension and one for each range. A document is one row, and is tokenised whole by one task; equal keys are parted by
doc_id and by a number drawn for each row, so that no group of copies is bound to one range.
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
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, materialise, padded, shuffle_partitions, slices, table, text_buffer

CAPACITY = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"
#: Text parts whose ids a Python worker remembers, twice: those met of late, and those before them.
CACHE_PARTS = 200_000
#: Hashed vectors have so many numbers; points so many; each is told apart to so many bits along the curve.
BUCKETS, DIMENSIONS, BITS = 256, 4, 12

_KIND = np.zeros(256, np.uint8)  # 1 letter, 2 digit, 3 punctuation but the apostrophe, 0 other
_KIND[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = 1
_KIND[[*range(ord("0"), ord("9") + 1)]] = 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 3
_PAIRS = np.array([a != b and a > 0 and b > 0 for a in range(4) for b in range(4)])
#: A space and a word of printable ASCII characters or Latin letters: with more of them, the tokenizer cuts before each.
_SPACED = re.compile(rb" (?:[!-~]|\xc3[\x80-\xbf])+")
_SOLID = np.zeros(256, bool)
_SOLID[33:127] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True


def _cuts(buffer: np.ndarray) -> np.ndarray:
    """Places where the tokenizer's own splitting always cuts: before a space that a word follows, around a line feed
    between words, and between ASCII letters, digits and punctuation."""
    kind = _KIND[buffer]
    cut = _PAIRS[kind[:-1] * 4 + kind[1:]]
    space = np.flatnonzero(buffer[1:-1] == 0x20)
    before, after = buffer[space], buffer[space + 2]
    cut[space[_SOLID[after] | _SOLID[before] & ~_BLANK[after]]] = True
    line = np.flatnonzero(buffer[1:-1] == 10)
    line = line[_SOLID[buffer[line]] & _SOLID[buffer[line + 2]]]
    cut[line] = cut[line + 1] = True
    return np.flatnonzero(cut) + 1


class _Parts:
    """Token ids of the parts of texts, each part encoded once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.largest = max([END_ID, *vocabulary.values()])
        self.spaced = np.zeros(self.largest + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # the space of byte-level vocabularies
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        rng = np.random.default_rng(11)
        self.bucket = rng.integers(0, BUCKETS, self.largest + 1)
        self.sign = rng.choice([-1.0, 1.0], self.largest + 1)
        self.axes = rng.standard_normal((BUCKETS, DIMENSIONS))

    def learn(self, parts: list[bytes]) -> None:
        """Words with a space before them are encoded many at once, one after the other: each of their tokens that begins
        with a space begins a word. All other parts are encoded one by one."""
        words, rest = [], []
        for p in parts:
            (words if _SPACED.fullmatch(p) else rest).append(p)
        runs = [words[at : at + 256] for at in range(0, len(words), 256)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([b"".join(r).decode() for r in runs], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            first = np.flatnonzero(self.spaced[ids])
            if len(first) != len(run) or first[0]:
                rest += run
                continue
            data, at = ids.tobytes(), [*(4 * first).tolist(), 4 * len(ids)]
            self.known.update(zip(run, [data[a:b] for a, b in zip(at, at[1:])]))
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for p, e in zip(some, self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)):
                self.known[p] = np.array(e.ids, np.uint32).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of each text and END_ID after them, and where each row's begin."""
        buffer, bounds = padded(texts)
        rows = len(bounds) - 1
        ends_row = bounds[1:] - 1  # the line feed after each row, which is no text
        begins = np.zeros(len(buffer), bool)
        begins[_cuts(buffer)] = True
        begins[bounds[:-1]] = begins[ends_row] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(buffer))
        mark = np.zeros(len(buffer), bool)
        mark[ends_row] = True
        last = mark[starts]
        size = np.where(last, 0, ends - starts)
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buffer[~mark])])
        different = column.dictionary_encode()
        inverse = different.indices.to_numpy()
        raw, at = text_buffer(different.dictionary)
        data, at = raw.tobytes(), at.tolist()
        parts = [data[a:b] for a, b in zip(at, at[1:])]
        if len(self.known) > CACHE_PARTS:  # parts that are met again move on, the others are forgotten at the next turn
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        known[b""] = np.array([END_ID], np.uint32).tobytes()  # stands for the end of a row
        fresh = [p for p in parts if p not in known]
        known.update([(p, old[p]) for p in fresh if p in old])
        self.learn([p for p in fresh if p not in old])
        ids = [known[p] for p in parts]
        for i in self._odd(texts):  # a text with a special token's name in it has ids of its own
            own = (starts >= bounds[i]) & (starts < ends_row[i])
            inverse = inverse.copy() if not inverse.flags.writeable else inverse
            ids += [np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32).tobytes(), b""]
            inverse[own] = len(ids) - 1
            inverse[np.flatnonzero(own)[0]] = len(ids) - 2
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        store, at = np.frombuffer(b"".join(ids), np.uint32), np.concatenate([[0], np.cumsum(lengths)[:-1]])
        each = lengths[inverse]
        stop = np.cumsum(each)
        places = np.repeat(at[inverse] - (stop - each), each)
        places += np.arange(len(places))
        first = np.searchsorted(starts, bounds[:rows])
        return store[places], np.concatenate([np.concatenate([[0], stop])[first], stop[-1:]])

    def _odd(self, texts: pa.Array) -> list[int]:
        found: set[int] = set()
        for mark in self.special:
            found.update(np.flatnonzero(pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)).tolist())
        return sorted(found)

    def points(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """A point for each row: signed counts of its ids by bucket, damped by square roots, to length 1, projected.
        The end token, which all rows have, does not count."""
        rows = len(bounds) - 1
        weight = self.sign[ids]
        weight[bounds[1:] - 1] = 0
        out = np.empty((rows, DIMENSIONS))
        for at in range(0, rows, 4096):
            end = min(rows, at + 4096)
            a, b = bounds[at], bounds[end]
            row = np.repeat(np.arange(end - at), np.diff(bounds[at : end + 1]))
            v = np.bincount(row * BUCKETS + self.bucket[ids[a:b]], weight[a:b], (end - at) * BUCKETS).reshape(-1, BUCKETS)
            v = np.sign(v) * np.sqrt(np.abs(v))
            size = np.linalg.norm(v, axis=1, keepdims=True)
            out[at:end] = v @ self.axes / np.maximum(size, 1e-12)
        return out


@functools.cache
def _parts(path: str) -> _Parts:
    """One tokenizer and one memory of parts for all tasks of a Python worker."""
    return _Parts(path)


def pointed(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, spread, tokens, wide, point, ids) of each document; ids as little-endian numbers of two bytes, or of
    four where wide. spread is drawn from a row's place in its task; it only parts rows that are alike, and stands
    once the rows are written."""
    schema = "doc_id long, spread long, tokens long, wide boolean, point array<double>, ids binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, seen = _parts(path), 0
        wide = parts.largest > 0xFFFF
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = parts.encode(part.column(1))
                n = part.num_rows
                size = 4 if wide else 2
                data = np.ascontiguousarray(ids.astype("<u4" if wide else "<u2")).tobytes()
                point = parts.points(ids, bounds)
                spread = (np.arange(seen, seen + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                seen += n
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(spread),
                        pa.array(np.diff(bounds)),
                        pa.array(np.full(n, wide)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, n * DIMENSIONS + 1, DIMENSIONS, dtype=np.int32)), pa.array(point.ravel())),
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((bounds * size).astype(np.int32)), pa.py_buffer(data)]),
                    ],
                    names=["doc_id", "spread", "tokens", "wide", "point", "ids"],
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_arrow(docs, work, schema)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (whole numbers below 2**bits, one column for each dimension).

    From the highest bit down, the axes of each row's current sub-cube are turned as the curve turns them there: an axis
    whose bit is set mirrors the lower bits of the first axis, one whose bit is not set trades them with it. The bits of
    the turned axes, differenced from axis to axis and undone of the turns still open, read as one number.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for axis in range(n):
            mirror = (x[axis] >> bit & 1).astype(bool)
            trade = np.where(mirror, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(mirror, low, trade)
            x[axis] ^= trade
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    turned = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turned ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= turned
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in range(n):
            out = out << 1 | x[axis] >> bit & 1
    return out


def curve_keyed(points: DataFrame) -> DataFrame:
    """points with the key of each row instead of its point. Each dimension is cut so that cells hold about as many
    documents each, by the mean and the spread over all documents."""
    sums = points.agg(*[F.struct(F.avg(F.col("point")[d]).alias("m"), F.stddev_pop(F.col("point")[d]).alias("s")).alias(f"d{d}") for d in range(DIMENSIONS)]).first()
    mean = np.array([s["m"] or 0.0 for s in sums])
    scale = np.array([s["s"] or 1.0 for s in sums])

    @F.pandas_udf("long")
    def key(point: pd.Series) -> pd.Series:
        z = (np.stack(point.to_numpy()) - mean) / scale if len(point) else np.zeros((0, DIMENSIONS))
        # the logistic curve comes within 0.01 of the normal distribution's share of points below z
        cells = np.clip((1 << BITS) / (1 + np.exp(-1.702 * np.clip(z, -20, 20))), 0, (1 << BITS) - 1)
        return pd.Series(hilbert_keys(cells.astype(np.int64)))

    return points.withColumn("key", key("point")).drop("point")


def laid_out(keyed: DataFrame) -> DataFrame:
    """Rows in ranges of (key, doc_id, spread), with range and the number of ids before them in it (before)."""
    ranged = keyed.repartitionByRange(shuffle_partitions(keyed.sparkSession), "key", "doc_id", "spread").sortWithinPartitions("key", "doc_id", "spread")
    ranged = ranged.select("doc_id", "key", "tokens", "wide", "ids", F.spark_partition_id().alias("range"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            tokens = batch.column(2).to_numpy()
            stop = np.cumsum(tokens) + total
            if len(stop):
                total = int(stop[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stop - tokens)], names=[*batch.schema.names, "before"])

    return map_arrow(ranged, work, "doc_id long, key long, tokens long, wide boolean, ids binary, range int, before long")


class _Stream:
    """Where the sequences of a stream of `total` ids begin: every `capacity` ids; the rest by powers of two."""

    def __init__(self, total: int, capacity: int) -> None:
        self.capacity, self.full = capacity, total // capacity
        rest = total - self.full * capacity
        sizes = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.tail = self.full * capacity + np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def sequence(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, first id, end) of the sequences that hold the ids at these places."""
        number = at // self.capacity
        first, end = number * self.capacity, (number + 1) * self.capacity
        late = at >= self.tail[0]
        k = np.clip(np.searchsorted(self.tail, at, side="right") - 1, 0, max(0, len(self.tail) - 2))
        return (
            np.where(late, self.full + k, number),
            np.where(late, self.tail[k], first),
            np.where(late, self.tail[np.minimum(k + 1, len(self.tail) - 1)], end),
        )


def pack(laid: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of rows that stand on storage in ranges: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, key[, ids])."""
    totals = {r["range"]: r["n"] for r in laid.groupBy("range").agg(F.sum("tokens").alias("n")).collect()}
    base, total = {}, 0
    for r in sorted(totals):
        base[r], total = total, total + totals[r]
    stream = _Stream(total, capacity)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "key"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 8 + [pa.binary()] * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            get = dict(zip(batch.schema.names, batch.columns))
            tokens = get["tokens"].to_numpy()
            begin = get["before"].to_numpy() + np.array([base[r] for r in get["range"].to_pylist()], np.int64)
            end, row, at = begin + tokens, np.arange(len(tokens)), begin
            runs = []  # a round cuts one piece off each document that still has ids
            while len(row):
                number, first, stop = stream.sequence(at)
                stop = np.minimum(stop, end[row])
                runs.append(np.stack([row, at - begin[row], stop - at, number, at - first]))
                more = stop < end[row]
                row, at = row[more], stop[more]
            row, start, length, number, offset = np.concatenate(runs, axis=1)
            order = np.lexsort((start, row))
            row, start, length, number, offset = (x[order] for x in (row, start, length, number, offset))
            # ids are read document by document, so that only one is held as four bytes each
            crc, out, last, own = np.empty(len(row), np.int64), [], -1, None
            for i, (r, a, n) in enumerate(zip(row.tolist(), start.tolist(), length.tolist())):
                if r != last:
                    own, last = np.frombuffer(get["ids"][r].as_py(), "<u4" if get["wide"][r].as_py() else "<u2").astype("<u4"), r
                data = own[a : a + n].tobytes()
                crc[i] = zlib.crc32(data)
                if with_ids:
                    out.append(data)
            columns = [get["doc_id"].take(pa.array(row)), start, length, crc, tokens[row], number, offset, get["key"].take(pa.array(row))] + [out] * with_ids
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = ", ".join(f"{n} long" for n in names[:8]) + ", ids binary" * with_ids
    return map_arrow(laid, work, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence, from pieces packed with ids: (sequence_id, n_tokens, ids binary). At most `capacity`
    pieces make one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"),
        F.aggregate("parts", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places along the curve.

    A null text counts as an empty one, which is the end token alone. A text of any length is taken whole, by one task.
    Repeated rows have pieces of their own, which lie side by side; null ids sort first among equal keys. Only doc_id
    and text are read, so that other columns may have any names. An empty table gives no rows.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    points = materialise(pointed(docs, path), "curve_points")
    return pack(materialise(laid_out(curve_keyed(points)), "curve_laid"), capacity, with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
