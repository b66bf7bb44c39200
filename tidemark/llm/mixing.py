"""Mixing sources to target weights by hash-threshold histograms.

Each source has a budget of words. What a source gives in whole passes is taken from each of its documents; the rest of
the budget goes to the documents whose hash is below a threshold. Thresholds come from histograms: words by source and
hash bucket, of which only the bucket that the budget ends in is refined. The mix is then a filter; nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_CLASS, materialise, table

#: Weights of the sources in code-point order, repeating; null is the last source.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MOST_PASSES = 3
#: Bits of the hash that one level of histograms tells apart, and how far each level shifts the 63 bits of it.
BITS = 11
SHIFTS = (52, 41, 30, 19, 8, 0)
#: Up to so many sources the thresholds are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Words wanted of each source: rows (source, source_size, target).

    Sources share 100 % of all words by weight; where that is over `most` times the source's size it stops there, and
    the excess is shared again by weight among the others, until none is above. Sorting sources by size over weight
    gives the stopped ones as a prefix, so one pass of window sums finds where it ends.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    index = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (index + 1).cast("int")))
    ratio = F.col("source_size") / F.col("weight")
    order = Window.orderBy(ratio.asc(), F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("before", F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        # what a unit of weight gets if all sources before this one are stopped and this one is not
        .withColumn("share", (F.col("total") - most * F.col("before")) / F.col("weight_left"))
        .withColumn("stopped", F.col("share") * F.col("weight") > most * F.col("source_size"))
        .withColumn("level", F.min(F.when(~F.col("stopped"), F.struct(ratio.alias("r"), F.col("share").alias("s")))).over(everything)["s"])
    )
    target = F.when(F.col("stopped"), most * F.col("source_size").cast("double")).otherwise(
        F.least(F.col("level") * F.col("weight"), most * F.col("source_size").cast("double"))
    )
    return per.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows (source, passes, threshold): each document is taken `passes` times, and once more if its hash is below
    threshold. The hash is a long from 0 to 2**63 - 1.

    Level by level: buckets of the current hash range that end within the budget are taken, the one in which the budget
    ends is refined. At the last level a bucket is one hash value; it is taken if that comes nearer to the target.
    """
    whole = F.coalesce(F.least(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(MOST_PASSES)).cast("long"), F.lit(0))
    state = targets.select("source", whole.alias("passes"), (F.col("target") - whole * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("low"))
    for level, shift in enumerate(SHIFTS):
        above = SHIFTS[level - 1] if level else 63
        inside = sizes.join(state, sizes["source"].eqNullSafe(state["source"]))
        if level:
            inside = inside.where(F.shiftright(sizes["h"], above) == F.shiftright(state["low"], above))
        histogram = inside.groupBy(
            sizes["source"].alias("source"), F.shiftright(sizes["h"], shift).alias("bucket")
        ).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.first("left").alias("left"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        # the first bucket that would go over the budget
        over = histogram.withColumn("upto", F.sum("words").over(run)).where(F.col("upto") > F.col("left")).groupBy("source").agg(
            F.min(F.struct("bucket", "upto", "words", "n")).alias("b")
        )
        joined = state.join(over.select(F.col("source").alias("s"), "b.*"), F.col("source").eqNullSafe(F.col("s")), "left")
        before = F.col("upto") - F.col("words")
        nearer = F.col("upto") - F.col("left") < F.col("left") - before
        # without such a bucket all that is left fits: the range to its end is taken
        end = F.shiftleft(F.shiftright(F.col("low"), above) + 1, above) if level else F.lit((1 << 63) - 1)
        end = F.when(end < 0, F.lit((1 << 63) - 1)).otherwise(end)
        start = F.shiftleft(F.col("bucket"), shift) + (F.when(nearer, 1).otherwise(0) if not shift else F.lit(0))
        state = materialise(
            joined.select(
                "source",
                "passes",
                (F.col("left") - F.coalesce(before, F.lit(0))).alias("left"),
                F.when(F.col("bucket").isNull(), end).otherwise(start).cast("long").alias("low"),
                F.coalesce(F.col("n"), F.lit(0)).alias("n"),
            ),
            "mix_state",
        )
        if not shift:
            break
        if state.where("n > 1").isEmpty():
            # no boundary bucket has more than one document left: decide those, without finer histograms
            only = sizes.join(state.where("n = 1"), sizes["source"].eqNullSafe(state["source"]))
            only = only.where(F.shiftright(sizes["h"], shift) == F.shiftright(state["low"], shift)).select(
                sizes["source"].alias("s"), sizes["h"].alias("hash"), sizes["size"].alias("one")
            )
            state = state.join(only, state["source"].eqNullSafe(only["s"]), "left").withColumn(
                "low", F.when(F.col("one") - F.col("left") < F.col("left"), F.col("hash") + 1).otherwise(F.col("low"))
            )
            break
        state = state.drop("n")
    return state.select("source", "passes", F.col("low").alias("threshold"))


def sized(docs: DataFrame, name: str) -> DataFrame:
    """doc_id, source, size and hash of each document, written once: the text is read no more."""
    return materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
            hash63(F.col("doc_id"), F.col("text")).alias("h"),
        ),
        name,
    )


def hash63(doc_id: Column, text: Column) -> Column:
    """What a document is picked by: stable over reruns, and free of where the row stands."""
    return F.shiftrightunsigned(F.xxhash64(doc_id.cast("long"), text), 1)


def _with_thresholds(sizes: DataFrame, plan: DataFrame, broadcastable: bool) -> DataFrame:
    plan = plan.withColumnRenamed("source", "plan_source")
    return sizes.join(F.broadcast(plan) if broadcastable else plan, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")


def mix(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, source, size, h, source_size, target, passes, taken), one for each document.

    A null text has size 0 and is taken as 0 words; a null source is a source of its own, the last. Rows with equal
    doc_id and text have equal hashes and are taken or left together. An empty table gives no rows; other columns are
    not looked at.
    """
    sizes = sized(docs, "mix_sizes")
    targets = materialise(source_targets(sizes), "mix_targets")
    few = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    plan = materialise(
        thresholds(sizes, targets).withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("s"),
        "mix_plan",
    )
    out = _with_thresholds(sizes, plan, few)
    passes = F.col("passes") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)
    passes = F.least(passes, F.lit(MOST_PASSES)).cast("long")
    return out.withColumn("passes", passes).withColumn("taken", F.col("passes") * F.col("size"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs.

    A document without words costs nothing and is kept as its hash says.
    """
    sizes = sized(docs, "mix_sizes")
    targets = materialise(source_targets(sizes), "mix_targets")
    few = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    plan = materialise(thresholds(sizes, targets), "mix_plan")
    columns = docs.columns
    plan = plan.select(F.col("source").alias("__source"), F.col("passes").alias("__passes"), F.col("threshold").alias("__threshold"))
    joined = docs.join(F.broadcast(plan) if few else plan, docs["source"].cast("string").eqNullSafe(plan["__source"]))
    passes = F.col("__passes") + F.when(hash63(F.col("doc_id"), F.col("text")) < F.col("__threshold"), 1).otherwise(0)
    joined = joined.withColumn("__n", F.least(passes, F.lit(MOST_PASSES)).cast("int")).where("__n > 0")
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__n")))).select(*[F.col(f"`{c}`") for c in columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken")
