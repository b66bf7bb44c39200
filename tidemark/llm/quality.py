"""Quality rules by weak supervision, in DataFrame operations only.

Each rule looks at the statistics of a text and votes good (1), bad (-1) or abstains (0). Rules are noisy, so no single
vote decides: expectation-maximisation over the votes of all documents estimates how often each rule is right when it
votes, and the share of good documents; a document is kept if its posterior probability of being good is high enough.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CLASS, WORD_CLASS, materialise, table

#: Base rules: fewer words, or a larger share (%) of repeated words than these, always fail.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A document is kept at this posterior probability of good quality or more.
KEEP_AT = 0.5
#: Rounds of expectation-maximisation, the starting values, and the number of made-up votes that hold estimates there.
ROUNDS, PRIOR_GOOD, PRIOR_ON_GOOD, PRIOR_ON_BAD, PRIOR_COUNT = 12, 0.9, 0.98, 0.4, 20.0
#: Bounds of accuracies: rules seldom vote against good documents, and a vote for bad never speaks for good.
LEAST_ON_GOOD, MOST_ACCURACY = 0.9, 0.995


def _windows(words: Column) -> Column:
    """Hash of each 3-word window."""
    n = F.size(words)
    triples = F.arrays_zip(F.slice(words, F.lit(1), n - 2), F.slice(words, F.lit(2), n - 2), F.slice(words, F.lit(3), n - 2))
    return F.when(n >= 3, F.transform(triples, lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>"))


def measured(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, the given columns of docs, and the statistics of each text:

    n_words, word_chars (code points in words), n_symbols (characters of #*$%&|<>), n_lines (lines with a word),
    n_dup_lines (of these, equal to an earlier line), n_repeat_words (words in 3-word windows that occur twice or more),
    n_upper (words with two capitals and no lower-case letter), n_marked (words that end in two symbols).

    Words in repeated windows are found from the sorted hashes of the windows: those whose hash also stands beside
    theirs occur twice or more, and each covers its words up to the end of the one before. Hashes have 64 bits. All
    patterns take time linear in a text's length, whatever it holds; the sort of the windows n log n.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*columns, text.alias("__text"))
    base = base.withColumn("__words", F.array_remove(F.split("__text", SPACE_CLASS), ""))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(WORD_CLASS))
    base = base.withColumn("__lines", lines).withColumn("__hashes", _windows(F.col("__words")))
    # windows that occur more than once, as (hash, start) sorted by hash; most short texts have none
    both = F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.filter(
        both,
        lambda x, k: (F.get(F.col("__both"), k - 1)["h"] == x["h"]) | (F.get(F.col("__both"), k + 1)["h"] == x["h"]),
    )
    some = F.size("__hashes") > F.size(F.array_distinct("__hashes"))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    base = base.withColumn("__both", F.when(some, both).otherwise(none))
    base = base.withColumn("__starts", F.sort_array(F.transform(F.coalesce(repeated, none), lambda x: x["i"])))
    covered = F.aggregate(
        F.col("__starts"),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end")),
        lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n"), (i + 3).alias("end")),
    )["n"]
    return base.select(
        *columns,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size(F.filter("__words", lambda w: w.rlike("[A-Z]{2}") & ~w.rlike("[a-z]"))).cast("long").alias("n_upper"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>!]{2}(?![^\x20\x09-\x0D])")).cast("long").alias("n_marked"),
    )


def votes() -> dict[str, Column]:
    """The rules: 1 good, -1 bad, 0 abstains, from the columns of measured()."""
    n = F.greatest(F.col("n_words"), F.lit(1))

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return {
        "symbols": rule(F.col("n_symbols") > 0.5 * n, F.col("n_symbols") < 0.1 * n),
        "marked": rule(F.col("n_marked") > 0.3 * n, F.col("n_marked") < 0.05 * n),
        "upper": rule(F.col("n_upper") > 0.4 * n, F.col("n_upper") < 0.1 * n),
        "lines": rule(F.col("n_dup_lines") > 0.3 * F.col("n_lines"), F.col("n_dup_lines") < 0.1 * F.col("n_lines")),
        "repeats": rule(100 * F.col("n_repeat_words") > 30 * n, 100 * F.col("n_repeat_words") < 10 * n),
        "length": rule(F.col("n_words") < LEAST_WORDS, F.col("n_words") >= 2 * LEAST_WORDS),
        "word_length": rule((F.col("word_chars") > 12 * n) | (F.col("word_chars") < 2.5 * n), F.col("word_chars").between(3.5 * n, 9 * n)),
    }


def estimate(voted: DataFrame, rules: list[str]) -> tuple[float, dict[str, tuple[float, float]]]:
    """(share of good documents, accuracies of each rule) by expectation-maximisation.

    A rule has two accuracies: how often it votes good on good documents, and bad on bad ones, when it votes at all.
    Documents with the same votes count together, by Spark; the rounds need these counts alone, 3**len(rules) at most,
    whatever the corpus.
    """
    patterns = [(tuple(row[r] for r in rules), float(row["n"])) for row in voted.groupBy(*rules).agg(F.count(F.lit(1)).alias("n")).collect()]
    patterns.sort()
    good, accuracy = PRIOR_GOOD, {r: (PRIOR_ON_GOOD, PRIOR_ON_BAD) for r in rules}
    total = sum(n for _, n in patterns)
    for _ in range(ROUNDS):
        weights = _weights(good, accuracy)
        sums = {r: [0.0] * 4 for r in rules}  # good votes and all votes of good documents; bad and all of bad ones
        all_good = 0.0
        for votes_, n in patterns:
            logit = weights[None] + sum(weights[r][v] for r, v in zip(rules, votes_))
            p = n / (1 + math.exp(-logit))
            all_good += p
            for r, v in zip(rules, votes_):
                if v:
                    sums[r][0] += p * (v > 0)
                    sums[r][1] += p
                    sums[r][2] += (n - p) * (v < 0)
                    sums[r][3] += n - p
        good = (all_good + PRIOR_GOOD * PRIOR_COUNT) / (total + PRIOR_COUNT)
        for r, (up, seen_good, down, seen_bad) in sums.items():
            on_good = (up + PRIOR_ON_GOOD * PRIOR_COUNT) / (seen_good + PRIOR_COUNT)
            on_bad = (down + PRIOR_ON_BAD * PRIOR_COUNT) / (seen_bad + PRIOR_COUNT)
            on_good = min(max(on_good, LEAST_ON_GOOD), MOST_ACCURACY)
            accuracy[r] = (on_good, min(max(on_bad, 1 - on_good), MOST_ACCURACY))
    return good, accuracy


def _weights(good: float, accuracy: dict[str, tuple[float, float]]) -> dict:
    """Log odds of good quality: before any vote (None), and what each rule's votes add."""
    out: dict = {None: math.log(good / (1 - good))}
    for r, (on_good, on_bad) in accuracy.items():
        out[r] = {1: math.log(on_good / (1 - on_bad)), -1: math.log((1 - on_good) / on_bad), 0: 0.0}
    return out


def posterior(good: float, accuracy: dict[str, tuple[float, float]]) -> Column:
    """Probability of good quality, given the votes (naive Bayes with the estimated accuracies)."""
    weights = _weights(good, accuracy)
    logit = F.lit(weights.pop(None))
    for r, w in weights.items():
        logit = logit + F.when(F.col(r) == 1, w[1]).when(F.col(r) == -1, w[-1]).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def _base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, further columns, the statistics, base_failed, p_good and kept of each document.

    Null texts are empty texts, which fail; repeated rows are judged one by one; an empty table gives no rows. Texts
    are read once: the statistics are written to the shared folder.
    """
    columns = tuple(dict.fromkeys(("doc_id", *columns)))
    stats = materialise(measured(docs, *columns), "quality_stats")
    rules = votes()
    voted = stats.withColumns(rules)
    good, accuracy = estimate(voted, list(rules))
    out = voted.withColumn("base_failed", _base_failed()).withColumn("p_good", posterior(good, accuracy))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_AT))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns of docs.

    Texts are measured once: documents go to the shared folder with their votes, and are read from there when the
    accuracies are known. Null texts count as empty and fail; repeated rows are judged one by one; an empty table gives
    no rows; columns of docs may have any names."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.select(F.struct(*columns).alias("__row"), F.col("text"))
    rules = votes()
    voted = measured(whole, "__row").select("__row", _base_failed().alias("__failed"), *[v.cast("byte").alias(r) for r, v in rules.items()])
    voted = materialise(voted, "quality_votes")
    good, accuracy = estimate(voted, list(rules))
    return voted.where(~F.col("__failed") & (posterior(good, accuracy) >= KEEP_AT)).select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )
