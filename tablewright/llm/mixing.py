"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents, repeated from the start when
it runs dry. A copy's virtual finish time is its source's cumulative words
divided by the source's target; served in that order, the sources keep their
weights at every moment, and all reach their targets at virtual time 1. The
copies are range-sorted by finish time over the whole corpus and cut off at the
total budget, the sum of the targets in whole words. A long document would let
its source overshoot, so a copy is served in packets that end with the slices of
virtual time, and the budget may end inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import WORD, staged

WEIGHTS, SHARE, LIMIT = (3, 1, 2), 1.5, 2

#: A source's documents are shuffled into so many buckets, and virtual time is cut into so many slices.
BUCKETS, SLICES = 4096, 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Per source: source_size, weight, target.

    Sources in code-point order, null last, take ``weights`` in turn and share
    ``share`` times all words by weight; no target exceeds ``limit`` times its
    source's words. Resharing the excess until nobody is above is filling up in
    the order of limit by weight: the first k sources take their limits, and the
    rest share what is left. One row per source; sources are as many as there
    are weights to state, so one window orders them.
    """
    ranked = sizes.withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    stated = F.array(*[F.lit(float(w)) for w in weights])
    own = ranked.withColumn("weight", F.element_at(stated, (F.pmod("_i", F.lit(len(weights))) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") * limit / F.col("weight"), "_i")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = own.select(
        "source",
        "source_size",
        "weight",
        F.row_number().over(order).alias("_rank"),
        (F.col("source_size") * float(limit)).alias("_cap"),
        (
            (F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum(F.col("source_size") * float(limit)).over(before), F.lit(0.0)))
            / F.sum("weight").over(after)
        ).alias("_level"),
    )
    # The level that holds is the first at which its own source is not above its limit.
    fits = F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct("_rank", "_level"))
    final = level.withColumn("_final", F.min(fits).over(everything)["_level"])
    return final.select(
        "source",
        "source_size",
        "weight",
        F.least("_cap", F.coalesce(F.col("_final") * F.col("weight"), F.col("_cap"))).alias("target"),
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, position.

    ``size`` counts words; ``taken`` is how many of them the mix takes, repeats
    counted, between 0 and ``limit`` times the size; ``position`` is the word of
    the mix at which the document first comes (null if it never does). Null
    texts have size 0, null sources are a source of their own, and rows that
    repeat a doc_id are documents of their own. The shuffle is by a digest of
    ``seed`` and doc_id, so reruns agree. Extra columns are ignored; an empty
    table gives an empty mix. A text of any length is one row of numbers.
    """
    sized = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = sized.withColumn("_key", key).withColumn("_bucket", F.conv(F.substring("_key", 1, 3), 16, 10).cast("int"))
    buckets = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("_start", F.coalesce(F.sum("_words").over(earlier), F.lit(0)))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, limit)
    starts = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).select(
        starts["source"].alias("_source"), F.col("_bucket").alias("_b"), "_start", "source_size", "target"
    )
    within = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size")
    queued = (
        rows.withColumn("_n", F.row_number().over(within))
        .withColumn("_upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_before", F.col("_start") + F.col("_upto") - F.col("size"))
        .drop("_source", "_b", "_start", "_upto", "_key")
    )
    queued = staged(queued, "queues")
    # Each round through a source is one more copy of its documents, whole: only the budget cuts.
    rounds = int(-(-limit // 1))
    served = queued.filter("size > 0 and target > 0").select("*", F.explode(F.array(*[F.lit(k) for k in range(rounds)])).alias("_round"))
    slices = F.lit(float(SLICES))
    slice_of = lambda word: F.least(F.floor(word * slices / F.col("target")), F.lit(2 * SLICES)).cast("int")
    word_of = lambda k: F.floor(k * F.col("target") / slices).cast("long")
    # A copy is served in packets that end where a slice of virtual time ends; all past time 2 is one slice.
    packets = (
        served.withColumn("_a", F.col("_before") + F.col("_round") * F.col("source_size"))
        .withColumn("_b", F.col("_a") + F.col("size"))
        .withColumn("_slice", F.explode(F.sequence(F.greatest(slice_of(F.col("_a")) - 1, F.lit(0)), F.least(slice_of(F.col("_b")) + 1, F.lit(2 * SLICES)))))
        .withColumn("_from", F.greatest("_a", word_of(F.col("_slice"))))
        .withColumn("_to", F.when(F.col("_slice") == 2 * SLICES, F.col("_b")).otherwise(F.least("_b", word_of(F.col("_slice") + 1))))
        .filter("_to > _from")
        .select("source", "_bucket", "_n", "_round", "_slice", (F.col("_to") - F.col("_from")).alias("_words"), (F.col("_to") / F.col("target")).alias("_finish"))
    )
    # The global range sort: words before each slice, then finish times inside it. Slices past the budget need no order.
    whole = packets.groupBy("_slice").agg(F.sum("_words").alias("_w"))
    first = whole.select("_slice", F.coalesce(F.sum("_w").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    # One number, read from the written queues: as a subquery it would bring the targets' plan along twice.
    budget = int(queued.select("source", "target").distinct().agg(F.sum(F.floor("target"))).first()[0] or 0)
    within_budget = first.filter(F.col("_base") < budget)
    in_slice = Window.partitionBy("_slice").orderBy("_finish", F.col("source").asc_nulls_last(), "_bucket", "_n", "_round")
    ordered = (
        packets.join(F.broadcast(within_budget), "_slice")  # at most 2 * SLICES + 1 rows
        .withColumn("_upto", F.sum("_words").over(in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("_at", F.col("_base") + F.col("_upto") - F.col("_words"))
        .withColumn("_left", F.greatest(F.lit(budget) - F.col("_at"), F.lit(0)))
    )
    taken = ordered.groupBy("source", "_bucket", "_n").agg(F.sum(F.least("_words", "_left")).alias("_taken"), F.min(F.when(F.col("_left") > 0, F.col("_at"))).alias("position"))
    taken = taken.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.col("_n").alias("_m"), "_taken", "position")
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")) & (F.col("_n") == F.col("_m"))
    return queued.join(taken, same, "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), "position"
    )


def repeat_to_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them whole; a copy cut by the end of the budget is left out.

    Documents without words are not part of a mix and go. Of rows that repeat a
    doc_id, equal ones count as one row that the mix takes for all of them.
    """
    plan = mix(docs, **options).filter("size > 0").withColumn("_llm_copies", F.floor(F.col("taken") / F.col("size")).cast("int"))
    wanted = plan.groupBy(F.col("doc_id").alias("_llm_id"), F.col("source").alias("_llm_s"), F.col("size").alias("_llm_z")).agg(F.max("_llm_copies").alias("_llm_copies")).filter("_llm_copies > 0")
    sized = docs.withColumn("_llm_size", word_count(F.col("text")))
    same = sized["doc_id"].eqNullSafe(wanted["_llm_id"]) & sized["source"].eqNullSafe(wanted["_llm_s"]) & (sized["_llm_size"] == wanted["_llm_z"])
    names = [f"`{c}`" for c in docs.columns]
    return sized.join(wanted, same).select(*names, F.explode(F.sequence(F.lit(1), F.col("_llm_copies"))).alias("_llm_copy")).select(*names)
