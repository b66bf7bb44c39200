"""Joining documents by the Jaccard similarity of their word n-grams: a grouped prefix join.

Sets of n-gram hashes are ordered by hash; two sets that are similar enough share at least l elements of their zones,
the first |x| - need + l elements. Elements that no other zone has are dropped on the way: a set with too few of the
others links with nothing. The rest order their zones by frequency, rarest first, and keep the prefix in which partners
must share one element. Sets with identical prefixes and size are one group. Groups that share a prefix element and fit
in size are dealt to one cluster, so that no pair of them is ever a row; there, group pairs are filtered by size and by
where in their zones the shared elements stand, then expanded, and members are verified pair by pair on their full sets,
unless pairs found before join them already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import repeats
from tidemark.llm.common import NO_ID, WORD_CLASS, components, distinct_texts, gram_hash, map_arrow, materialise, padded, shuffle_partitions, slices, stream_groups, table, word_hashes, words_of

#: Words of a shingle, and the least similarity in hundredths.
SHINGLE, PERCENT = 4, 85
#: The zone has size / ZONE elements more than a plain prefix.
ZONE = 10
#: Sets and elements of one block; larger clusters are compared block by block, in different tasks.
BLOCK, BLOCK_ELEMENTS = 1024, 4_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def sets_of(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, bounds): the distinct shingle hashes of each row, ascending (as unsigned numbers)."""
    buffer, rows = padded(column)
    buffer = _LOWER[buffer]
    starts, ends = words_of(buffer)
    words = word_hashes(buffer, starts, ends)
    bounds = np.searchsorted(starts, rows)
    count = np.diff(bounds)
    grams = gram_hash(words, shingle)
    row = np.repeat(np.arange(len(count)), count)[: len(grams)]
    inside = np.arange(len(grams)) + shingle <= bounds[row + 1] if len(grams) else np.zeros(0, bool)
    value, row = grams[inside], row[inside]
    for k in range(1, shingle):  # texts of fewer words are one element
        if len(short := np.flatnonzero(count == k)):
            value = np.concatenate([value, gram_hash(words, k)[bounds[short]] ^ np.uint64(k)])
            row = np.concatenate([row, short])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    if len(value):
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])])
        value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(count) + 1))


def _owners(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hash of each set: equal sets have equal owners."""
    size = np.diff(bounds)
    mixed = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= value | np.uint64(1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    out = sums[bounds[1:]] - sums[bounds[:-1]]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) + size.astype(np.uint64)
    return out.view(np.int64)


def _need(n, percent: int):
    """Least overlap of a set of n elements with any partner."""
    return (percent * n + 99) // 100


def _zone(n, percent: int):
    return n - _need(n, percent) + np.maximum(1, n // ZONE)


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("long")


def _prefix_length(n: Column, percent: int) -> tuple[Column, Column]:
    """(elements of the zone, elements that zones of partners share at least) of a set of n."""
    need = _div(percent * n + 99, 100)
    zone = n - need + F.greatest(F.lit(1), _div(n, ZONE))
    return zone, F.greatest(F.lit(1), _div(need, ZONE))


def _described(texts: DataFrame, shingle: int) -> DataFrame:
    """(key, owner, n) of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                value, bounds = sets_of(part.column(1), shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_owners(value, bounds)), pa.array(np.diff(bounds))], names=["key", "owner", "n"])

    return map_arrow(texts.select("key", "text"), work, "key binary, owner long, n long")


def _zone_rows(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for part in slices(batch, "text"):
                value, bounds = sets_of(part.column(0), shingle)
                n = np.diff(bounds)
                size = np.where(n > 0, _zone(n, percent), 0)
                stop = np.cumsum(size)
                at = np.arange(int(stop[-1])) + np.repeat(bounds[:-1] - (stop - size), size)
                yield value[at].view(np.int64), np.repeat(_owners(value, bounds), size), np.ones(len(at), np.int32)

    return map_arrow(texts.select("text"), lambda b: repeats.gathered(parts(b), True), repeats.SCHEMA)


def candidates(texts: DataFrame, sets: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(owner, cluster, grp, n, prefix, zones, share): sets that may have partners; all partners of a set are in its
    cluster. zones counts the elements of its zone that others have, of which partners share `share` at least."""
    found = repeats.repeated(_zone_rows(texts, shingle, percent), distinct=True)
    sizes = sets.select("owner", "n").distinct()
    zone, share = _prefix_length(F.col("n"), percent)
    held = found.groupBy("owner").agg(F.collect_set("h").alias("hs")).join(sizes, "owner").where(F.size("hs") >= share)
    held = materialise(held, "jaccard_held")
    each = held.select("owner", F.explode("hs").alias("h"))
    often = each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = each.join(often, "h").groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("zone"))
    ordered = ordered.join(held.select("owner", "n"), "owner")
    # elements of the zone that no other has come first in the order, and can be shared with nobody
    most = zone - share + 1 - (zone - F.size("zone"))
    prefix = F.slice(F.transform("zone", lambda x: x["h"]), F.lit(1), F.greatest(most, F.lit(0)).cast("int"))
    prefixes = ordered.where(most > 0).select("owner", "n", prefix.alias("prefix"), F.size("zone").alias("zones"), share.alias("share"))
    grouped = materialise(prefixes.withColumn("grp", F.xxhash64("n", "prefix")), "jaccard_prefixes")
    groups = grouped.groupBy("grp").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("members"))
    # partners' sizes are in the same or in neighbouring bands, so that each band also looks into the next
    band = F.floor(F.log(F.col("n").cast("double")) / -float(np.log(percent / 100 - 1e-9))).cast("long")
    posted = groups.select("grp", F.explode("prefix").alias("h"), band.alias("band"))
    posted = posted.select("grp", "h", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    leaders = posted.groupBy("h", "band").agg(F.min("grp").alias("leader"))
    edges = posted.join(leaders, ["h", "band"]).where("grp <> leader").select(F.col("grp").alias("a"), F.col("leader").alias("b")).distinct()
    cluster = components(edges, "jaccard_candidates").withColumnRenamed("node", "grp")
    # components() leaves out the smallest node itself
    cluster = cluster.union(cluster.select(F.col("component").alias("grp"), "component")).distinct()
    whole = groups.select("grp", "members").join(cluster, "grp", "left").where("component IS NOT NULL OR members > 1")
    return grouped.join(whole, "grp").select("owner", F.coalesce("component", "grp").alias("cluster"), "grp", "n", "prefix", "zones", "share")


def verified(texts: DataFrame, sets: DataFrame, chosen: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): links between sets of a cluster, enough of them to join all that are linked."""
    one = sets.groupBy("owner").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_ELEMENTS)).cast("int")
    more = ["owner", "cluster", "blocks", "grp", "prefix", "zones", "share"]
    who = chosen.join(chosen.groupBy("cluster").agg(blocks.alias("blocks")), "cluster").join(one, "owner").select("key", *more)

    def sets_work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                value, bounds = sets_of(part.column(0), shingle)
                data = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((bounds * 8).astype(np.int32)), pa.py_buffer(value)])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], data], names=[*more, "elements"])

    kinds = "owner long, cluster long, blocks int, grp long, prefix array<long>, zones int, share long, elements binary"
    full = map_arrow(texts.join(who, "key").select("text", *more), sets_work, kinds)
    block = F.pmod(F.xxhash64("owner"), F.col("blocks")).cast("int")
    pair = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.least(F.col("block"), j).cast("long") * F.col("blocks") + F.greatest(F.col("block"), j),
    )
    dealt = full.withColumn("block", block).withColumn("pair", F.explode(pair)).withColumn("task", F.xxhash64("cluster", "pair"))
    dealt = dealt.repartition(shuffle_partitions(texts.sparkSession), "task").sortWithinPartitions("task", "cluster", "pair", "owner")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream_groups(batches, "task"):
            group = np.stack([whole.column(c).to_numpy() for c in ("task", "cluster", "pair")])
            cut = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(0), [True]]))
            owner, block, grp, zones, share = (whole.column(c).to_numpy() for c in ("owner", "block", "grp", "zones", "share"))
            elements, prefix = whole.column("elements").combine_chunks(), whole.column("prefix").combine_chunks()
            out = []
            for a, b in zip(cut[:-1], cut[1:]):
                if b - a < 2:
                    continue
                full_sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in elements.slice(a, b - a)]
                pairs = GroupPairs([x.values.to_numpy() for x in prefix.slice(a, b - a)], np.array([len(x) for x in full_sets]), grp[a:b], zones[a:b], share[a:b], percent)
                own = block[a:b] if (block[a:b] != block[a]).any() else np.arange(b - a)  # pairs within one of two blocks are that block's own
                out.append(owner[a:b][np.stack(linked(full_sets, pairs, own, percent))])
            if out:
                u, v = np.concatenate(out, 1)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["a", "b"])

    return map_arrow(dealt.select("task", "cluster", "pair", "owner", "block", "grp", "prefix", "zones", "share", "elements"), compare, "a long, b long")


class GroupPairs:
    """Which sets may be similar enough: those of one group, and those whose groups fit in size and share an element of
    their prefixes with enough of both zones behind it. The first element that partners share always has, so one that
    has is enough. Partners are looked up one set at a time, as most sets are joined before theirs are needed."""

    def __init__(self, prefixes: list[np.ndarray], size: np.ndarray, grp: np.ndarray, zones: np.ndarray, share: np.ndarray, percent: int) -> None:
        _, head, self.of = np.unique(grp, return_index=True, return_inverse=True)
        self.size, self.share, self.percent = size[head], share[head], percent
        lists = [prefixes[i] for i in head]
        count = np.array([len(x) for x in lists])
        owner = np.repeat(np.arange(len(head)), count)
        behind = zones[head][owner] - (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))  # elements from here on
        _, code = np.unique(np.concatenate(lists), return_inverse=True)
        order = np.argsort(code, kind="stable")
        self.owner, self.behind = owner[order], behind[order]
        self.from_, self.to = np.searchsorted(code[order], code), np.searchsorted(code[order], code, side="right")
        self.own, self.begin = behind, np.concatenate([[0], np.cumsum(count)])

    def near(self, i: int) -> np.ndarray:
        """Which sets set i may be similar to."""
        g = self.of[i]
        mine = slice(self.begin[g], self.begin[g + 1])
        each = self.to[mine] - self.from_[mine]
        at = np.arange(int(each.sum())) + np.repeat(self.from_[mine] - (np.cumsum(each) - each), each)
        enough = np.minimum(self.behind[at], np.repeat(self.own[mine], each)) >= np.minimum(self.share[self.owner[at]], self.share[g])
        near = np.zeros(len(self.size), bool)
        near[self.owner[at[enough]]] = True
        near &= 100 * np.minimum(self.size, self.size[g]) >= self.percent * np.maximum(self.size, self.size[g])
        near[g] = True
        return near[self.of]


def linked(sets: list[np.ndarray], pairs: GroupPairs, block: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the pairs of different blocks that are similar enough on their full sets. Each set in
    turn is verified against the later ones that may be, and are not yet joined to it."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    stop = np.cumsum(size)
    flag = np.zeros(int(code.max()) + 1, np.int32)
    label, u, v = np.arange(n), [], []
    for i in range(n - 1):
        open_ = (label[i + 1 :] != label[i]) & (block[i + 1 :] != block[i])
        if not open_.any():
            continue
        some = np.flatnonzero(open_ & pairs.near(i)[i + 1 :]) + i + 1
        if not len(some):
            continue
        own = code[stop[i] - size[i] : stop[i]]
        flag[own] = 1
        first, last = some[0], some[-1]
        begin = stop[first] - size[first]
        common = np.add.reduceat(flag[code[begin : stop[last]]], (stop - size)[first : last + 1] - begin)[some - first]
        flag[own] = 0
        hit = some[100 * common >= percent * (size[i] + size[some] - common)]
        # one edge to each component that is met joins all of it
        _, one = np.unique(label[hit], return_index=True)
        for j in hit[one].tolist():
            label[label == label[j]] = label[i]
            u.append(i)
            v.append(j)
    return np.array(u, np.int64), np.array(v, np.int64)


def _linked_texts(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, per, named): (doc_id, key) of each document; (class, key, n) of each text, a class being a component's
    smallest set hash; (class, least, key) of each class of texts with words: its smallest doc_id and the text there. A
    text is worked on whole by one task, whatever its length; other columns are not looked at."""
    rows, texts = distinct_texts(docs, "jaccard_texts")
    sets = materialise(_described(texts, shingle), "jaccard_sets")
    chosen = materialise(candidates(texts, sets.where("n > 0"), shingle, percent), "jaccard_chosen")
    joined = components(verified(texts, sets, chosen, shingle, percent), "jaccard_links")
    per = sets.join(joined.withColumnRenamed("node", "owner"), "owner", "left").select("key", "n", F.coalesce("component", "owner").alias("class"))
    firsts = texts.select("key", "first_id")
    least = per.where("n > 0").join(firsts, "key").groupBy("class").agg(F.min(F.struct("first_id", "key")).alias("least"))
    return rows, per, least.select("class", F.col("least.first_id").alias("least"), F.col("least.key").alias("key"))


def classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, key) of each document.

    component_id is the smallest doc_id that links lead to, the document's own included; links join documents whose
    sets have a Jaccard similarity of percent / 100 or more. A text of fewer words than a shingle has one element, all
    its words; null, empty and white texts have none and link with nothing. A null doc_id is never the smallest unless
    all of its component are null. Rows with equal texts are one document here. An empty table gives no rows.
    component_id names a component, but does not tell components apart where ids are null or repeated.
    """
    rows, per, named = _linked_texts(docs, shingle, percent)
    per = per.join(named.select("class", "least"), "class", "left")
    out = rows.join(per, "key")
    least = F.when(F.col("least") < NO_ID, F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(least).alias("component_id"), "key")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs without all but one document of each component, with the columns of docs: the one with the smallest doc_id
    stays, null ids last, and of several texts under that id the one with the smallest key. Components are told apart
    by their sets, so that null and repeated ids lose none. Documents without words all stay."""
    _, _, named = _linked_texts(docs, shingle, percent)
    columns = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    wordy = text.rlike(WORD_CLASS)
    keyed = docs.where(wordy).withColumn("__key", F.unhex(F.md5(text.cast("binary")))).withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    chosen = named.select(F.col("least").alias("__id"), F.col("key").alias("__key"))
    one = keyed.join(chosen, ["__key", "__id"], "left_semi").dropDuplicates(["__key", "__id"])
    return one.select(*[F.col(f"`{c}`") for c in columns]).union(docs.where(~wordy))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
