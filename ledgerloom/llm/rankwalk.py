"""Problem 5: one order of records from scores of many scales, as the stationary distribution of a walk.

From a record the walk picks one of the record's scores at random and jumps, uniformly, to a record that stands strictly
higher by that score; with the chance 1-damping it jumps anywhere.  Only ranks within one score count, so no unit can
dominate.  What a record receives through a score is a sum over all lower records, a prefix sum over the sorted score:
ties are summed to one row first, sums within a block of the sorted order and of the blocks before it are added.

The plain walk comes closer by about the damping a round, some 100 rounds for a settled order.  Anderson's mixing of the
last few rounds has the same fixed point and takes about a third of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.skew import broadcast_if_small, join_on_hot_key
from ledgerloom.session import BROADCAST_ROWS, cut, free

#: Values that stand for "no score" in any unit.
FILLERS = (-1.0, 999999999.0)
#: Earlier rounds that are mixed.
_MIXED = 3


def score_lists(leads: DataFrame) -> DataFrame:
    """(item, list, score): the best score of each record by each detector, and by each run's own ``rank_score``.

    A record is named by ``source_group::native_id``.  Null, not-a-number, infinite and filler scores are no scores; rows
    that repeat a lead and leads that repeat a detector count once.  ``rank_score`` changed its scale between runs, so
    every run's is a list of its own.
    """
    locator = "array<struct<locators:array<struct<source_group:string,native_id:string>>>>"
    base = leads.select("detector_id", "created_run", "score", "rank_score", F.explode(F.from_json("evidence", locator)).alias("e")).select("*", F.explode("e.locators").alias("l"))
    item = F.concat_ws("::", "l.source_group", "l.native_id")
    by_detector = base.select(item.alias("item"), F.concat(F.lit("score:"), "detector_id").alias("list"), "score")
    by_run = base.select(item.alias("item"), F.concat(F.lit("rank:"), "created_run").alias("list"), F.col("rank_score").alias("score"))
    both = by_detector.unionByName(by_run)
    good = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf")) & ~F.col("score").isin(*FILLERS)
    return both.where(good & F.col("list").isNotNull() & (F.col("item") != "")).groupBy("item", "list").agg(F.max("score").alias("score"))


def rank_walk(scores: DataFrame, damping: float = 0.85, tolerance: float = 1e-9, most_rounds: int = 200) -> DataFrame:
    """(item, mass, position, n_scores) for (item, list, score); position 1 has the largest stationary mass.

    The walk ends when a round changes no record's mass by more than ``tolerance`` of that mass, so the bound holds for
    any number of records; if it is not met within ``most_rounds`` rounds, that is an error.  Masses that agree in the six
    digits after the average's point (a mass of 1 is the average) are equal, and take the order of the item's name: so the
    order does not hang on the last digits of sums.  No input rows, no output rows; items without a score are not ranked.
    """
    ties = scores.groupBy("list", "score").agg(F.count("*").alias("n"))
    ties = cut(ties.repartitionByRange("list", "score").withColumn("block", F.spark_partition_id()).withColumn("g", F.xxhash64("list", "score")))
    # Higher blocks of a list come first; the windows hold one block, or one row per block.
    inner = Window.partitionBy("list", "block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("list").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = ties.groupBy("list", "block").agg(F.sum("n").alias("_n")).withColumn("_above", F.coalesce(F.sum("_n").over(over), F.lit(0))).drop("_n")
    ties = cut(ties.join(broadcast_if_small(blocks), ["list", "block"]).withColumn("higher", F.coalesce(F.sum("n").over(inner), F.lit(0)) + F.col("_above")).drop("_above"))

    entries = scores.join(broadcast_if_small(ties.select("list", "score", "g", "higher")), ["list", "score"])
    state = cut(entries.groupBy("item").agg(F.collect_list(F.struct("g", "higher")).alias("at")).withColumn("k", F.size("at")))
    total = state.count()
    state = cut(state.withColumns({"mass": F.lit(1.0 / max(total, 1)), "past": F.array().cast("array<struct<g:double,f:double>>")}))
    few = ties.count() <= BROADCAST_ROWS
    below_inner = Window.partitionBy("list", "block").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below_over = Window.partitionBy("list").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = state  # the written table that ``state`` reads
    kept = 0  # earlier rounds in ``past``: what each gave (g) and by how much that differed from its start (f)
    for _ in range(most_rounds):
        out = state.select("item", "k", "mass", F.explode("at").alias("x")).select("item", "k", "mass", F.col("x.g").alias("g"), F.col("x.higher").alias("higher"))
        sent = out.where("higher > 0").groupBy("g").agg(F.sum(F.col("mass") / F.col("k") / F.col("higher")).alias("c"))
        got = cut(ties.join(sent, "g", "left").select("list", "block", "score", "g", "n", F.coalesce("c", F.lit(0.0)).alias("c")))
        before = got.groupBy("list", "block").agg(F.sum("c").alias("_c")).withColumn("_below", F.coalesce(F.sum("_c").over(below_over), F.lit(0.0))).drop("_c")
        reach = got.join(F.broadcast(before) if few else broadcast_if_small(before), ["list", "block"]).withColumn("gain", F.coalesce(F.sum("c").over(below_inner), F.lit(0.0)) + F.col("_below")).select("g", "n", "gain")
        joined = out.join(F.broadcast(reach), "g") if few else join_on_hot_key(out, reach, "g", "n", "item")
        gain = F.sum(F.col("gain") + F.when(F.col("higher") == 0, F.col("mass") / F.col("k")).otherwise(0.0))
        gained = joined.groupBy("item").agg(gain.alias("gain"))
        new = cut(state.join(gained, "item").withColumn("g", F.lit((1 - damping) / max(total, 1)) + F.col("gain") * damping).drop("gain").withColumn("f", F.col("g") - F.col("mass")))
        free(got)
        free(base)
        base = new
        steps = [F.col("f") - F.get("past", i)["f"] for i in range(kept)]
        products = [F.sum(x * y * (total or 1) ** 2) for i, x in enumerate(steps) for y in [*steps[: i + 1], F.col("f")]]
        moved, *products = new.agg(F.max(F.abs(F.col("f")) / F.col("g")), *products).first()
        if moved is None or moved < tolerance:
            return _positions(new.select("item", F.col("g").alias("mass"), F.round(F.col("g") * total, 6).alias("_order"), F.col("k").alias("n_scores")))
        mixed = F.col("g")
        for i, part in enumerate(_shares(products, kept)):
            mixed = mixed - F.lit(part) * (F.col("g") - F.get("past", i)["g"])
        past = F.slice(F.concat(F.array(F.struct("g", "f")), "past"), 1, _MIXED)
        state = new.select("item", "at", "k", mixed.alias("mass"), past.alias("past"))
        kept = min(kept + 1, _MIXED)
    raise RuntimeError(f"the order was not settled after {most_rounds} rounds: masses still change by {moved:.1e}")


def _shares(products: list[float], n: int) -> list[float]:
    """The weights of ``n`` steps whose sum comes nearest to the last change, from the products among them and with it."""
    gram, last, at = np.zeros((n, n)), np.zeros(n), iter(products)
    for i in range(n):
        for j in range(i + 1):
            gram[i, j] = gram[j, i] = next(at)
        last[i] = next(at)
    scale = np.trace(gram)
    return [] if not scale > 0 else [float(x) for x in np.linalg.lstsq(gram / scale, last / scale, rcond=1e-12)[0]]


def _positions(ranked: DataFrame) -> DataFrame:
    """A global order by blocks: rows sorted by ranges, numbered within a range, offset by the ranges before it."""
    blocks = cut(ranked.repartitionByRange(F.desc("_order"), F.asc("item")).withColumn("_b", F.spark_partition_id()))
    sizes = blocks.groupBy("_b").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_o", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_b")) - F.col("_n")).drop("_n")
    inner = F.row_number().over(Window.partitionBy("_b").orderBy(F.desc("_order"), "item"))
    return blocks.join(broadcast_if_small(offsets), "_b").withColumn("position", inner + F.col("_o")).select("item", "mass", F.col("position").cast("bigint").alias("position"), "n_scores")
