"""Helpers the corpus operators share: shared storage, text buffers, streamed groups, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: ASCII space and \x09-\x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Texts are worked on in slices of about so many bytes, so that memory does not follow the batch size.
SLICE_BYTES = 2 << 20
#: A null doc_id sorts after every other.
NO_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir; a local one only where executors are threads (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "tidemark-shared")
    return folder.rstrip("/")


#: Folders and tables that this process has written to the shared folder, for release().
_written: list[tuple[str, str | None]] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    _written.append((path, None))
    return spark.read.schema(schema).parquet(path)


def written() -> int:
    """How many tables operators have written to the shared folder so far, for release()."""
    return len(_written)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Drop what operators have written to the shared folder, but the first `keep` tables: call it when their results
    stand elsewhere."""
    while len(_written) > keep:
        path, name = _written.pop()
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its row offsets, without a copy; null rows have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[bounds[0] : bounds[-1]]
    return raw, bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have about `most` bytes; a longer text stays whole."""
    if not batch.num_rows:
        return
    _, bounds = text_buffer(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser for 64-bit hashes, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def gram_hash(values: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each run of k values, by doubling: position i covers values[i:i+k]."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    have, level, out, done = values.astype(np.uint64), 1, None, 0
    mix(have)
    while True:
        if k & level:
            part = have[done : done + n]
            if out is None:
                out = part.copy()
            else:
                out *= np.uint64(0x9E3779B97F4A7C15)
                out += part
                out ^= out >> np.uint64(29)
            done += level
        if done == k:
            return mix(out)
        have = have[:-level] * np.uint64(0xD6E8FEB86659FD93) + have[level:]
        have ^= have >> np.uint64(32)
        level *= 2


def slide_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """Place of the least of each run of w values; of equal ones, the first."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    least, at, level = values, np.arange(len(values), dtype=np.int32), 1

    def joined(shift: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        here, there = least[:m], least[shift : shift + m]
        return np.minimum(here, there), np.where(here <= there, at[:m], at[shift : shift + m])

    while level * 2 <= w:
        least, at = joined(level, len(least) - level)
        level *= 2
    return at if level == w else joined(w - level, n)[1]


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte buffer; row bounds must be spaces or given apart."""
    space = _IS_SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts = edge[~space[edge]] if len(edge) else edge
    ends = edge[space[edge]] if len(edge) else edge
    if len(raw) and not space[0]:
        starts = np.concatenate([[0], starts])
    if len(raw) and not space[-1]:
        ends = np.concatenate([ends, [len(raw)]])
    return starts, ends


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All rows in one byte buffer with a line feed after each, and the start of each row in it (one more at the end)."""
    raw, bounds = text_buffer(column)
    rows = len(bounds) - 1
    out = np.full(len(raw) + rows, 10, np.uint8)
    keep = np.ones(len(out), bool)
    keep[bounds[1:] + np.arange(rows)] = False
    out[keep] = raw
    return out, bounds + np.arange(rows + 1)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word. Its pieces of eight bytes are mixed with their places, so that no sum of them is a
    polynomial of the bytes, then added, and mixed again with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    pieces = (size + 7) >> 3
    first = np.cumsum(pieces) - pieces
    place = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    left = np.repeat(size, pieces) - 8 * place
    eight = np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    value = eight[np.repeat(starts, pieces) + 8 * place].astype(np.uint64)
    value &= np.uint64((1 << 64) - 1) >> (8 * (8 - np.minimum(left, 8))).astype(np.uint64)
    value ^= mix((place + 1).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    out = np.add.reduceat(mix(value), first)
    out += size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(out)


def substrings(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The byte strings raw[start : start + size]."""
    stop = np.cumsum(size)
    places = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(start - (stop - size), size)
    offsets = np.concatenate([np.zeros(1, np.int64), stop]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw[places])])


def cuts(size: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows whose sizes have a sum of about `most`; a larger row stands alone."""
    stop, at = np.cumsum(size), 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(stop, stop[at] - size[at] + most, side="right")))
        yield slice(at, end)
        at = end


def stream_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by key, recut so that no key's rows are split; a table may hold many keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key))
        last = keys[batch.num_rows - 1].as_py()
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() == last and keys[0].as_py() == last:
            held.append(batch)
            continue
        values = keys.to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(values != values[-1])[-1]) + 1 if (values != values[-1]).any() else 0
        if held or cut:
            whole = held + ([batch.slice(0, cut)] if cut else [])
            if whole:
                yield pa.Table.from_batches(whole).combine_chunks()
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(work, schema)


def distinct_texts(docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): rows has doc_id and text key of each document; texts has one row per different text, as a table
    in the shared folder bucketed by key, so that later joins on key move none of the texts again.

    texts: key binary (MD5 of the text), text, copies long, first_id long (smallest doc_id; null ids count as last).
    A null text is an empty text.
    """
    spark = docs.sparkSession
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    rows = keyed.select("doc_id", "key")
    texts = keyed.groupBy("key").agg(
        F.first("text").alias("text"),
        F.count(F.lit(1)).alias("copies"),
        F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first_id"),
    )
    at = f"{name}_{uuid.uuid4().hex}"
    _written.append((f"{shared_dir(spark)}/{at}", at))
    (
        texts.write.format("parquet")
        .option("compression", "zstd")
        .option("path", f"{shared_dir(spark)}/{at}")
        .bucketBy(shuffle_partitions(spark), "key")
        .saveAsTable(at)
    )
    return rows, spark.table(at)


def components(edges: DataFrame, name: str) -> DataFrame:
    """Smallest node reachable from each node of edges (a, b): rows (node, component).

    Nodes are longs. Alternates large-star and small-star steps, which keep the number of edges at most what it was and
    end after about log(nodes) rounds; each round is a written table.
    """
    now = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    last = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (
            both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        now = materialise(small, name)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
        last = mark
