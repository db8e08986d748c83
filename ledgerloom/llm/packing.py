"""Problem 8: texts assigned to containers of a fixed number of tokens.

Plain harmonic packing puts lengths into the classes (C/(k+1), C/k] and k texts of class k into a container.  It needs no
talk between workers but leaves about an eighth of the room empty here.  ``pack`` therefore takes every length as a class
of its own (there are at most C of them) and lets a container hold fixed counts of several classes: a plan, made on the
driver from the histogram of lengths, says how many containers of each make-up there are.  Workers number the texts of a
class among themselves and read container and place off the plan, as in the plain method.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.repetition import VOCABULARY, encode_whole, tokenizer
from ledgerloom.session import cut

CAPACITY = 2048


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of whole texts; null and empty texts have 0, rows with a null key are left out."""

    def run(batches):
        encode, _ = tokenizer(path)
        for batch in batches:
            n = [len(encode_whole(encode, t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["k", "n_tokens"])

    rows = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).where("k IS NOT NULL")
    return rows.mapInArrow(run, "k bigint, n_tokens bigint").withColumnRenamed("k", key)


def sizes_by_id(df: DataFrame) -> DataFrame:
    """Token counts with one row per id; of an id that stands twice the longest text counts.  Only counts are shuffled."""
    return token_counts(df).groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def pieces(counts: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """(key, piece, start, size): one piece per text, or full pieces and a rest if it is longer than the capacity."""
    k = F.ceil(F.col("n_tokens") / capacity).cast("int")
    cut_up = counts.where("n_tokens > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), k - 1)))
    start = F.col("piece").cast("bigint") * capacity
    return cut_up.select(key, "piece", start.alias("start"), F.least(F.lit(capacity), F.col("n_tokens") - start).cast("int").alias("size"))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(containers, [(size, count), ...])]: make-ups that use up the histogram.

    A make-up takes the longest size left and then, again and again, as many as fit of the longest size that fits; it is
    used until one of its sizes runs out, so there are at most as many make-ups as a few times the sizes.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    out = []
    sizes = sorted(left)
    while sizes:
        room, makeup, top = capacity, [], len(sizes)
        while room > 0:
            i = bisect.bisect_right(sizes, room, 0, top) - 1
            if i < 0:
                break
            s = sizes[i]
            j = min(room // s, left[s])
            makeup.append((s, j))
            room -= s * j
            top = i
        times = min(left[s] // j for s, j in makeup)
        out.append((times, makeup))
        for s, j in makeup:
            left[s] -= j * times
        sizes = [s for s in sizes if left[s] > 0]
    return out


def number_within(items: DataFrame, cls: str, order: list[str], rows_per_slot: int = 200_000) -> DataFrame:
    """``items`` with ``nth``, their number from 0 within ``cls``, without gathering a class in one task.

    Rows are spread over slots by a hash of ``order``; they are numbered within (class, slot), and the slots' counts,
    a small table, give each slot its offset.
    """
    slots = max(16, -(-items.count() // rows_per_slot))
    spread = cut(items.withColumn("_slot", F.pmod(F.xxhash64(*order), F.lit(slots)).cast("int")))
    per_slot = spread.groupBy(cls, "_slot").agg(F.count("*").alias("_n"))
    offset = F.sum("_n").over(Window.partitionBy(cls).orderBy("_slot")) - F.col("_n")
    inner = spread.withColumn("_r", F.row_number().over(Window.partitionBy(cls, "_slot").orderBy(*order)) - 1)
    numbered = inner.join(per_slot.withColumn("_o", offset).drop("_n"), [cls, "_slot"])
    return numbered.withColumn("nth", F.col("_o") + F.col("_r")).drop("_slot", "_o", "_r")


def place(numbered: DataFrame, makeups: list[tuple[int, list[tuple[int, int]]]], key: str = "doc_id") -> DataFrame:
    """Container and place of every numbered piece, read off the plan (a few thousand entries, bounded by the capacity)."""
    entries, base, used = [], 0, {}
    for times, makeup in makeups:
        at = 0
        for s, j in makeup:
            first = used.get(s, 0)
            entries.append((s, first, j, base, at))
            used[s] = first + j * times
            at += s * j
        base += times
    entries.sort()
    size, first, per, base_, at = (np.array([e[i] for e in entries], dtype=np.int64) for i in range(5))
    keys = (size << 44) + first

    def run(batches):
        for batch in batches:
            s, n = (np.asarray(batch.column(i)).astype(np.int64) for i in (3, 4))
            e = np.searchsorted(keys, (s << 44) + n, side="right") - 1
            inside = n - first[e]
            container, offset = base_[e] + inside // per[e], at[e] + (inside % per[e]) * s
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(container), pa.array(offset)], ["k", "piece", "start", "size", "container_id", "at"])

    rows = numbered.select(F.col(key).alias("k"), "piece", "start", "size", F.col("nth").cast("bigint"))
    return rows.mapInArrow(run, "k bigint, piece int, start bigint, size int, container_id bigint, at bigint").withColumnRenamed("k", key)


def pack(df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, size, container_id, at): every text of at least one token in its container.

    ``start`` is the piece's first token in the text, ``at`` its first in the container.  Ids that stand twice are packed
    once, with their longest text.  Texts without tokens need no container and give no row; empty input gives none.
    """
    items = cut(pieces(sizes_by_id(df), capacity))
    histogram = {r[0]: r[1] for r in items.groupBy("size").count().toLocalIterator()}  # at most ``capacity`` rows
    return place(number_within(items, "size", ["doc_id", "piece"]), plan(histogram, capacity))


def pack_harmonic(df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, size, class_k, container_id): plain harmonic packing, k texts of class k per container."""
    items = pieces(sizes_by_id(df), capacity).withColumn("class_k", F.floor(F.lit(capacity) / F.col("size")).cast("int"))
    numbered = number_within(items, "class_k", ["doc_id", "piece"])
    container = F.col("class_k").cast("bigint") * F.lit(1 << 44) + F.floor(F.col("nth") / F.col("class_k"))
    return numbered.select("doc_id", "piece", "start", "size", "class_k", container.alias("container_id"))


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, fill) of a packing."""
    per = packed.groupBy("container_id").agg(F.sum("size").alias("tokens"))
    return per.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / (F.count("*") * capacity), 4).alias("fill"))
