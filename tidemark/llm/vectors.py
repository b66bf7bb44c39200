"""Near-duplicate vectors by iterative quantisation.

A rotation of the principal directions is learned on a bounded sample so that signs of rotated vectors make balanced
binary codes. Multi-index tables hold substrings of the codes: vectors that share a substring (and label) meet in a
bucket, where the original vectors decide by their exact cosine. Equal vectors are one entry.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import components, map_arrow, materialise, shuffle_partitions, stream_groups, table

#: Least cosine of a link.
COSINE = 0.98
#: Rows that the rotation is learned on at most, the first by hash, and rounds of learning.
SAMPLE, ROUNDS, SEED = 20_000, 30, 7
#: Vectors wanted in a bucket on average, and the part of links at COSINE exactly that no table may miss.
BUCKET, MISS = 16, 0.0005
#: Vectors of one block; larger buckets are compared block by block, in different tasks.
BLOCK = 512


def learn_rotations(sample: np.ndarray, count: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projections): `count` projections, each d x d, of iterative quantisation from different starts.

    Each alternates: codes are the signs of the rotated vectors, and the rotation is the orthogonal matrix that brings
    the vectors nearest to their codes.
    """
    rng = np.random.default_rng(SEED)
    d = sample.shape[1]
    mean = sample.mean(0) if len(sample) else np.zeros(d)
    centred = sample - mean
    _, _, directions = np.linalg.svd(centred.T @ centred + 1e-9 * np.eye(d))
    projected = centred @ directions.T
    out = []
    for _ in range(count):
        rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds):
            codes = np.where(projected @ rotation >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(codes.T @ projected)
            rotation = (u @ v).T
        out.append(directions.T @ rotation)
    return mean, np.stack(out) if out else np.zeros((0, d, d))


def plan_tables(n: int, d: int, cosine: float = COSINE) -> tuple[int, int]:
    """(bits of a substring, number of tables): substrings so long that random vectors fill buckets with about BUCKET
    of n, and so many tables that two vectors at exactly `cosine` miss each other in all with probability MISS."""
    bits = max(1, min(d, 48, math.ceil(math.log2(max(2.0, n / BUCKET)))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - same)))


def code_bits(x: np.ndarray, mean: np.ndarray, projections: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bits of each row's code in each table, as rows x tables x bits."""
    per = x.shape[1] // bits
    signs = np.concatenate([((x - mean) @ p >= 0)[:, : per * bits] for p in projections], 1)[:, : tables * bits]
    return signs.reshape(len(x), tables, bits)


def _usable() -> Column:
    """Whether a row can have links: label and vector not null, all components finite, not all zero."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col("label").isNotNull() & F.coalesce(fine & F.exists(e, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(column: pa.Array, wide: bool) -> np.ndarray:
    """Unit vectors, in double precision, of vectors as bytes."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.float64 if wide else np.float32)
    x = raw.astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links(vectors: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, groups, counts, edges). rows: (vec_id, key) of every row, key being null where it can have no links; rows
    of equal vectors and labels have equal keys. groups: (key, class, copies, least) of each key: a number, its rows
    and their smallest vec_id. counts: (class, n) rows of other classes that are linked to a class. edges: (a, b)
    between classes, enough to join all that are linked.

    Every row is indexed. A pair is counted in the first table in which it meets, which both codes tell. Vectors of
    different length are compared only with their like.
    """
    spark = vectors.sparkSession
    wide = vectors.schema["embedding"].dataType.elementType.simpleString() != "float"
    kind = "array<double>" if wide else "array<float>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.col("label").cast("long").alias("label"))
    # 0.0 and -0.0 are one number
    same = F.transform("embedding", lambda x: x + F.lit(0.0).cast("double" if wide else "float"))
    keyed = rows.withColumn("embedding", same).withColumn("key", F.when(_usable(), F.unhex(F.md5(F.concat_ws(",", F.col("label"), F.to_json("embedding"))))))
    groups = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    groups = materialise(groups.withColumn("d", F.size("embedding")).withColumn("class", F.monotonically_increasing_id()), "vector_classes")
    entries = None
    for d, n in sorted((r["d"], r["n"]) for r in groups.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()):
        part = _entries(groups.where(F.col("d") == d), d, n, cosine, wide)
        entries = part if entries is None else entries.unionByName(part)
    everyone = keyed.select("vec_id", "key")
    if entries is None:
        return everyone, groups, spark.createDataFrame([], "class long, n long"), spark.createDataFrame([], "a long, b long")
    found = materialise(_compared(materialise(entries, "vector_entries"), cosine, wide), "vector_links")
    counts = found.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    return everyone, groups, counts, found.where("b IS NOT NULL").select("a", "b")


def _entries(groups: DataFrame, d: int, n: int, cosine: float, wide: bool) -> DataFrame:
    """(bucket, t, label, class, copies, tables, codes, x): each class in each table; codes has the bits of all of them,
    x the vector as it was given, both as bytes."""
    bits, tables = plan_tables(n, d, cosine)
    share = min(1.0, 1.2 * SAMPLE / max(1, n))
    order = F.xxhash64("key", F.lit(SEED))
    sample = groups.where(F.pmod(order, F.lit(1_000_000)) < int(share * 1_000_000) + 1).orderBy(order, "key").limit(SAMPLE).select("embedding").toPandas()
    x = np.stack(sample["embedding"]).astype(np.float64) if len(sample) else np.zeros((0, d))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean, projections = learn_rotations(x, math.ceil(tables / max(1, d // bits)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.int64(1) << np.arange(bits, dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            own = _matrix(b.column(3))
            code = code_bits(own / np.linalg.norm(own, axis=1, keepdims=True), mean, projections, bits, tables)
            m = len(own)
            row = pa.array(np.repeat(np.arange(m), tables))
            packed = pa.array([c.tobytes() for c in np.packbits(code.reshape(m, -1), axis=1)], pa.binary())
            exact = pa.array([v.tobytes() for v in own.astype(np.float64 if wide else np.float32)], pa.binary())
            t = np.tile(np.arange(tables, dtype=np.int32), m)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k).take(row) for k in range(3)), pa.array(t), pa.array((code @ weights).reshape(-1)), pa.array(np.full(len(t), tables, np.int32)), packed.take(row), exact.take(row)],
                names=["class", "copies", "label", "t", "code", "tables", "codes", "x"],
            )

    out = map_arrow(groups.select("class", "copies", "label", "embedding"), work, "class long, copies long, label long, t int, code long, tables int, codes binary, x binary")
    return out.withColumn("bucket", F.xxhash64(F.lit(d), "label", "t", "code")).drop("code")


def _compared(entries: DataFrame, cosine: float, wide: bool) -> DataFrame:
    """(a, n, b): rows linked to class a that are counted in some block, and an edge from a to b if b is not null."""
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = entries.join(sizes, "bucket").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("class", F.lit(1)), F.col("blocks")).cast("int"))
    # block i goes to the pairs (i, j) and (j, i); pairs are numbered low * blocks + high
    pair = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.least(F.col("block"), j.cast("int")).cast("long") * F.col("blocks") + F.greatest(F.col("block"), j.cast("int")),
    )
    dealt = dealt.withColumn("pair", F.explode(pair)).withColumn("task", F.xxhash64("bucket", "pair"))
    keys = ("task", "bucket", "pair", "label", "t")
    dealt = dealt.repartition(shuffle_partitions(entries.sparkSession), "task").sortWithinPartitions(*keys, "class")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream_groups(batches, "task"):
            group = np.stack([whole.column(c).to_numpy() for c in keys])
            cut = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(0), [True]]))
            who, times, to = [], [], []
            ids, copies, block, t, tables = (whole.column(c).to_numpy() for c in ("class", "copies", "block", "t", "tables"))
            codes, xs = whole.column("codes").combine_chunks(), whole.column("x").combine_chunks()
            for a, b in zip(cut[:-1], cut[1:]):
                if b - a < 2:
                    continue
                x = _unit(xs.slice(a, b - a), wide)
                near = np.triu(x @ x.T >= cosine, 1)
                own = block[a:b]
                if own.min() != own.max():
                    near &= own[:, None] != own[None, :]  # pairs within a block are that block's own
                i, j = np.nonzero(near)
                if len(i) and t[a]:
                    bits = np.unpackbits(np.frombuffer(b"".join(codes.slice(a, b - a).to_pylist()), np.uint8).reshape(b - a, -1), axis=1)
                    each = bits.shape[1] // tables[a]
                    c = bits[:, : each * t[a]].reshape(b - a, t[a], each)
                    differs = np.concatenate([(c[p] != c[q]).any(2).all(1) for p, q in zip(np.array_split(i, len(i) // 65536 + 1), np.array_split(j, len(j) // 65536 + 1))])
                    i, j = i[differs], j[differs]
                if not len(i):
                    continue
                n = np.bincount(i, copies[a:b][j], b - a) + np.bincount(j, copies[a:b][i], b - a)
                some = np.flatnonzero(n)
                u, v = _forest(i, j, b - a)
                who += [ids[a:b][some], ids[a:b][u]]
                times += [n[some].astype(np.int64), np.zeros(len(u), np.int64)]
                to += [pa.nulls(len(some), pa.int64()), pa.array(ids[a:b][v])]
            if who:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who)), pa.array(np.concatenate(times)), pa.concat_arrays(to)], names=["a", "n", "b"])

    columns = dealt.select(*keys, "class", "copies", "block", "tables", "codes", "x")
    return map_arrow(columns, work, "a long, n long, b long")


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph with edges (i, j) on n nodes."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    u = np.flatnonzero(label != np.arange(n))
    return u, label[u]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Two rows are linked if their labels are equal and not null and their cosine, in double precision, is at least
    `cosine`. Rows whose vector is null, all zero, or has null or non-finite components have no links and are their own
    component; so is a row with a null vec_id, whose component is null. Rows that share a vec_id are rows of their own:
    each counts as a link of the others that it is linked with. An empty table gives no rows; other columns are not
    looked at.
    """
    rows, groups, counts, edges = links(vectors, cosine)
    component = components(edges, "vector_components").withColumnRenamed("node", "class")
    per = groups.select("key", "class", "copies", "least").join(counts, "class", "left").join(component, "class", "left")
    per = materialise(
        per.select("key", "least", F.coalesce("component", "class").alias("component"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "vector_counts"
    )
    least = per.groupBy("component").agg(F.min("least").alias("component_id"))
    known = per.select("key", "component", "n_links").join(least, "component").drop("component")
    return rows.join(known, "key", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
