"""Joins and broadcasts whose cost stays bounded when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import BROADCAST_ROWS


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after a bounded count proved that ``df`` has at most ``max_rows`` rows.

    The count stops at ``max_rows + 1`` rows.  Larger inputs are returned unhinted, so the join is shuffled and AQE's
    skew handling applies.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def join_on_hot_key(big: DataFrame, groups: DataFrame, key: str, count: str, spread: str, hot: int = 100_000, salts: int = 64) -> DataFrame:
    """Inner join of rows with the one-row-per-key ``groups``, salting only the keys that hold more than ``hot`` rows.

    ``groups`` has one row per ``key`` with its number of rows in ``count``; ``spread`` is a column of ``big`` that
    differs between rows.  At most rows/hot keys can be hot, so the set of hot keys is small by construction; it is
    broadcast after its size has been checked.  Rows of a hot key go to ``salts`` tasks, the group row is repeated for
    each of them; all other keys have the single salt 0.
    """
    hot_keys = groups.where(F.col(count) > hot).select(key, F.lit(True).alias("_hot"))
    groups = groups.withColumn("_salt", F.explode(F.when(F.col(count) > hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    marked = big.join(broadcast_if_small(hot_keys), key, "left")
    salted = marked.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    return salted.join(groups, [key, "_salt"]).drop("_salt")


def join_pairs(left: DataFrame, right: DataFrame, keys: list[str], spread: str, work: int = 5_000_000, most: int = 1024) -> DataFrame:
    """Inner equi-join whose keys may be hot on both sides: a key with more than ``work`` pairs is split over tasks.

    Rows of ``left`` under such a key go to one of its salts by ``spread``, a column that differs between rows, and rows of
    ``right`` to all of them; the number of salts is the key's pairs over ``work``, ``most`` at most, so that the rows
    repeated stay few beside the pairs.  All pairs come out.  Null keys join nothing.
    """
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    pairs = F.col("_l").cast("double") * F.col("_r")
    heat = count(left, "_l").join(count(right, "_r"), keys).where(pairs > work).select(*keys, F.least(F.lit(most), F.ceil(pairs / work)).cast("int").alias("_w"))
    heat = broadcast_if_small(heat)
    w = F.coalesce("_w", F.lit(1))
    l = left.join(heat, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), w).cast("int")).drop("_w")
    r = right.join(heat, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), w - 1))).drop("_w")
    return l.join(r, [*keys, "_salt"]).drop("_salt")
