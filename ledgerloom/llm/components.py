"""Problem 4: pairwise matches consolidated into groups by hash-to-min.

Clusters are kept as rows (vertex, member), never as arrays.  In a round every vertex sends its cluster to its smallest
member and that member to all others; the minimum is combined per task before the shuffle, and the rows of a vertex that
stands for a very large group are spread over many tasks.  Rounds grow with the logarithm of the longest chain.  Each
round is written to reliable storage, so the plan stays short and a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.skew import join_on_hot_key
from ledgerloom.session import cut, free


def accepted_pairs(df: DataFrame) -> DataFrame:
    """(a, b) with a < b of rows whose status is confirmed or applied, apart from case and surrounding blanks.

    Rows with a null id, and pairs of an id with itself, link nothing.
    """
    status = F.lower(F.regexp_replace("status", r"^[\s ]+|[\s ]+$", ""))
    rows = df.where(status.isin("confirmed", "applied") & F.col("entity_id_a").isNotNull() & F.col("entity_id_b").isNotNull())
    pairs = rows.select(F.least("entity_id_a", "entity_id_b").alias("a"), F.greatest("entity_id_a", "entity_id_b").alias("b"))
    return pairs.where("a < b").distinct()


def connected(pairs: DataFrame, hot: int = 100_000, most_rounds: int = 60) -> DataFrame:
    """(group_id, id): every id of ``pairs`` (a, b) other than the smallest of its group, with that smallest id."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")), F.struct(F.col("a").alias("v"), F.col("a").alias("u")), F.struct(F.col("b").alias("v"), F.col("b").alias("u")))).alias("p"))
    state = cut(both.select("p.v", "p.u").distinct())
    seen = None
    for _ in range(most_rounds):
        mins = state.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
        sent = join_on_hot_key(state, mins, "v", "n", "u", hot)
        sent = sent.select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("p"))
        last, state = state, cut(sent.select("p.v", "p.u").distinct())
        free(last)
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            return state.where("v < u").select(F.col("v").alias("group_id"), F.col("u").alias("id"))
        seen = tuple(mark)
    raise RuntimeError(f"groups were not stable after {most_rounds} rounds")


def entity_groups(candidates: DataFrame) -> DataFrame:
    """(group_id, entity_id) of every linked entity other than the smallest of its group."""
    return connected(accepted_pairs(candidates)).withColumnRenamed("id", "entity_id")
