"""Mixing sources to target weights: subset sums of document lengths fit each source's budget.

A document's size is its number of words.  The sources, by code point with null last, weigh
``WEIGHTS`` in turn and share ``SHARE`` times all sizes by weight; no target exceeds ``MOST``
times its source's size, the excess goes to the others by weight.  A source is first taken whole
as often as its target allows; the rest of the target is a budget for a part of it.

For that part, documents are counted by exact length.  An even share of every stretch of lengths
fills the budget up to a remainder, and bounded-knapsack dynamic programming over the lengths
still there fits the remainder as closely as it can be.  Where only longer documents are left than that
programming reaches, at most one fits, and the longest such is taken.  The result is a number of documents for
each length; those documents are the first by a seeded hash of doc_id.

The counts are one row per source and length, combined before any shuffle; one source's rows
(as many as it has different lengths) meet in one task, never its documents.  Documents of one
source and length are ranked in buckets of about ``BUCKET`` by hash, so a length that a third
of all documents have is ranked in many tasks.

Null texts have size 0 and are taken 0 words.  A null source is a source of its own.  Rows that
repeat a doc_id are documents of their own.  An empty table gives none.  Columns other than
doc_id, text and source are ignored.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.llm.text import WHITE_RUN, whole, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 2
BUCKET = 256

# Words that dynamic programming may fit; beyond it lengths are taken evenly or by size.
FIT_WORDS = 1 << 16


def sized(docs):
    """doc_id, text_key, source and size."""
    words = F.regexp_count(whole(F.col("text")), F.lit(WHITE_RUN.replace("[", "[^", 1)))
    return docs.select(
        "doc_id", F.xxhash64("text").alias("text_key"), "source",
        words.cast("bigint").alias("size"))


def targets(totals, weights=WEIGHTS, share=SHARE, most=MOST):
    """source, source_size and target from one row per source.

    The common level is the highest of the levels that follow from capping the sources in
    the order in which they reach their caps.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights))
    cap = most * F.col("source_size")
    weighed = totals.select("source", "source_size", weight.alias("weight"), cap.alias("cap"))
    by_cap = Window.orderBy(
        F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (
        share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    levelled = weighed.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return levelled.select(
        "source", "source_size",
        F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def fit_remainder(lengths, counts, budget):
    """How many documents of each length to take so that their sizes come nearest to the
    budget from below; budget is at most FIT_WORDS.

    reached[s] is the item that first made the sum s; an item is some copies of a length
    (1, 2, 4, ... and a rest), used once, so walking back from a sum uses none twice.
    """
    reached = np.full(budget + 1, -1, np.int64)
    open_sums = np.ones(budget + 1, bool)
    open_sums[0] = False
    items = []
    for i in np.argsort(-lengths, kind="stable"):
        length, left, copies = int(lengths[i]), int(min(counts[i], budget // max(lengths[i], 1))), 1
        while length and left > 0 and open_sums[budget]:
            taken = min(copies, left)
            step = taken * length
            fresh = np.flatnonzero(~open_sums[:budget + 1 - step] & open_sums[step:]) + step
            reached[fresh] = len(items)
            open_sums[fresh] = False
            items.append((i, taken))
            left -= taken
            copies *= 2
    taken = np.zeros(len(lengths), np.int64)
    at = int(np.flatnonzero(~open_sums)[-1])
    while at:
        i, copies = items[reached[at]]
        taken[i] += copies
        at -= copies * int(lengths[i])
    return taken


def take_counts(lengths, counts, budget):
    """Documents to take of each length (ascending, above 0) for a budget below the total."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int(lengths @ counts)
    if not total or budget <= 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    # An even share: of the documents in order of length, every so many-th is taken.
    part = max(budget - FIT_WORDS // 2, 0) / total
    upto = np.floor(np.cumsum(counts) * part).astype(np.int64)
    taken = np.minimum(np.diff(upto, prepend=0), counts)
    for i in range(len(lengths) - 1, -1, -1):  # rounding may have gone too far
        over = int(lengths @ taken) - budget
        if over <= 0:
            break
        taken[i] -= min(taken[i], -(-over // int(lengths[i])))
    left = counts - taken
    rest = budget - int(lengths @ taken)
    for i in range(len(lengths) - 1, -1, -1):  # down to what can be fitted, longest first
        if rest <= FIT_WORDS:
            break
        more = min(int(left[i]), max((rest - FIT_WORDS // 2) // int(lengths[i]), 0))
        taken[i] += more
        left[i] -= more
        rest -= more * int(lengths[i])
    if rest <= FIT_WORDS:
        taken += fit_remainder(lengths, left, rest)
    else:
        # Every length still there is above rest - FIT_WORDS / 2, so above half of rest: no two
        # documents fit, and the longest that does comes nearest.
        fits = np.flatnonzero((left > 0) & (lengths <= rest))
        taken[fits[-1:]] += 1
    return taken


def _fit_source(rows):
    """One source's counts by length, with its target, to repeats and further documents."""
    rows = rows.sort_values("size").reset_index(drop=True)
    size, target = int(rows["source_size"][0]), float(rows["target"][0])
    repeats = int(target // size) if size else 0
    budget = round(target) - repeats * size
    used = (rows["size"] > 0).to_numpy()
    extra = np.zeros(len(rows), np.int64)
    extra[used] = take_counts(
        rows["size"].to_numpy()[used], rows["n"].to_numpy()[used], budget)
    return pd.DataFrame({
        "source": rows["source"], "size": rows["size"], "n": rows["n"],
        "source_size": rows["source_size"], "target": rows["target"],
        "repeats": repeats, "extra": extra,
    })


def plan(documents, weights=WEIGHTS, share=SHARE, most=MOST):
    """source, size, n, source_size, target, repeats and extra (documents taken once more)."""
    counts = documents.groupBy("source", "size").agg(F.count("*").alias("n"))
    totals = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = targets(totals, weights, share, most).withColumnRenamed("source", "__source")
    joined = counts.join(goals, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    return joined.groupBy("source").applyInPandas(
        _fit_source,
        "source string, size bigint, n bigint, source_size bigint, target double, "
        "repeats bigint, extra bigint")


def mix(docs, weights=WEIGHTS, share=SHARE, most=MOST, seed=SEED):
    """doc_id, text_key, source, size, source_size, target, copies and taken of every row."""
    documents = written(sized(docs), "sizes")
    lengths = written(plan(documents, weights, share, most), "mix").withColumnsRenamed(
        {"source": "__source", "size": "__size"})
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))
    buckets = F.ceil(F.col("n") / BUCKET)
    unit = F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53))
    drawn = (
        documents.join(
            lengths, F.col("source").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size")))
        .drop("__source", "__size").withColumn("draw", draw)
        .withColumn("bucket", F.floor(unit * buckets).cast("bigint"))
    )
    group = ["source", "size"]
    # Buckets are in the order of the hash: those before the cut are taken whole.
    filled = drawn.where((F.col("extra") > 0) & (F.col("extra") < F.col("n"))).groupBy(
        *group, "bucket", "extra").agg(F.count("*").alias("here"))
    upto = Window.partitionBy(*group).orderBy("bucket")
    cut = written(
        filled.withColumn("upto", F.sum("here").over(upto))
        .where((F.col("upto") >= F.col("extra")) & (F.col("upto") - F.col("here") < F.col("extra")))
        .select(F.col("source").alias("__source"), F.col("size").alias("__size"),
                F.col("bucket").alias("cut"),
                (F.col("extra") - F.col("upto") + F.col("here")).alias("need")),
        "cut",
    )
    rank = F.row_number().over(
        Window.partitionBy(*group, "bucket").orderBy("draw", "doc_id", "text_key"))
    once_more = (
        F.when(F.col("extra") == 0, 0).when(F.col("extra") >= F.col("n"), 1)
        .when(F.col("bucket") < F.col("cut"), 1)
        .when((F.col("bucket") == F.col("cut")) & (rank <= F.col("need")), 1).otherwise(0)
    )
    placed = drawn.join(
        cut, F.col("source").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size")),
        "left")
    return placed.select(
        "doc_id", "text_key", "source", "size", "source_size", "target",
        (F.col("repeats") + once_more).alias("copies"),
    ).withColumn("taken", F.col("size") * F.col("copies"))


def digests(mixed):
    """The contract's columns."""
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def mixed_corpus(docs):
    """docs in the mix, each once, with size, source_size, target, copies and taken.

    Rows alike in doc_id, text and source become one with the sum of their copies.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    keys = ["__id", "__key", "__source"]
    chosen = mix(docs).where(F.col("taken") > 0).groupBy(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"),
        F.col("source").alias("__source"), "size", "source_size", "target",
    ).agg(F.sum("copies").alias("copies"), F.sum("taken").alias("taken"))
    kept = docs.drop(*added)
    joined = kept.join(
        chosen, kept["doc_id"].eqNullSafe(F.col("__id"))
        & (F.xxhash64(kept["text"]) == F.col("__key"))
        & kept["source"].eqNullSafe(F.col("__source")))
    return joined.dropDuplicates(keys).drop(*keys)
