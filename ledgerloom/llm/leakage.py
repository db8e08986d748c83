"""Problem 9: evaluation texts inside training texts, by winnowing.

Both sides keep the smallest k-gram hash of every window of w consecutive k-grams, so any shared run of k+w-1 words
shares a fingerprint.  k and w follow, for each length of item, from the shortest run that a case can leave unreplaced
(``guaranteed_run``, ``RUN`` at most), so no case is missed and a short item does not make others dearer.  Fingerprints are equi-joined;
every hit is then extended along its alignment and kept if the longest admissible stretch is long enough.

Both texts stay where they are: a document gives out the fingerprints that a filter over the items' fingerprints lets
through, and, only if it shares enough of them with an item, its word codes in a second scan.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.texts import Codes, words
from ledgerloom.llm.texts import grams as _grams
from ledgerloom.operators.skew import broadcast_if_small, join_pairs
from ledgerloom.session import cut

SPAN = 20  # words in a row that make a case
ONE_IN = 8  # at most one word in so many is replaced
OPENING = 8  # least words of an opening instruction
SHARED_BY = 3  # items that must share it
#: Longest run that fingerprints are made for: items of longer runs share one k and w, shorter ones have their own.
RUN = 5
#: Bits of a filter per entry, and the most bits it may have; a filter that is too small lets more through, never less.
_BITS, _MOST_BITS = 1024, 1 << 27


def guaranteed_run(n: int) -> int:
    """The longest run of unreplaced words that a leaked stretch of an item of n words has at least."""
    runs = []
    for size in range(min(n, SPAN), max(min(n, SPAN), n) + 1):
        gaps = size // ONE_IN
        runs.append(-(-(size - gaps) // (gaps + 1)))
    return min(runs)


@lru_cache(maxsize=10_000)
def least_hits(n: int, k: int, w: int) -> int:
    """Fingerprints that a leaked stretch of an item of n words shares with the document at least, on one alignment.

    A clean run of r words holds r-k-w+2 windows, and one fingerprint serves at most w of them.  The minimum is taken over
    all lengths of a stretch and all ways its replaced words can split it.
    """
    shared = lambda r: -(-max(0, r - k - w + 2) // w)
    fewest = None
    for size in range(min(n, SPAN), max(min(n, SPAN), min(n, 2 * SPAN)) + 1):
        gaps = size // ONE_IN
        clean = size - gaps
        best = [shared(r) for r in range(clean + 1)]
        for _ in range(gaps):
            best = [min(best[r - x] + shared(x) for x in range(r + 1)) for r in range(clean + 1)]
        fewest = best[clean] if fewest is None else min(fewest, best[clean])
    return max(1, fewest or 0)


def grams(w: list[str], k: int) -> np.ndarray:
    """A 64-bit hash of every k words in a row."""
    return _grams(Codes().of(w), k)


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest (rightmost of equal) hash of every window of ``w``; of all, if there are fewer."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64)
    w = min(w, n)
    turned = hashes[::-1]
    least = sliding_window_view(turned, w).argmin(axis=1) if w > 1 else np.zeros(n, np.int64)
    return np.unique(n - 1 - (np.arange(n - w + 1) + least))


def _extends(doc: np.ndarray, item: np.ndarray, shift: int) -> bool:
    """Whether, with item word q beside document word q+shift, a stretch is long enough and clean enough.

    With +1 for an equal word and 1-ONE_IN for another, a stretch is clean enough if its sum is not negative.
    """
    least = min(SPAN, len(item))
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if hi - lo < least:
        return False
    sums = np.concatenate(([0], np.cumsum(np.where(item[lo:hi] == doc[lo + shift : hi + shift], 1, 1 - ONE_IN))))
    return bool((sums[least:] >= np.minimum.accumulate(sums)[: len(sums) - least]).any())


class _Filter:
    """A set of 64-bit numbers that may hold more than was put in, never less; its size is bounded."""

    def __init__(self, entries: int) -> None:
        self.bits = min(_MOST_BITS, 1 << max(10, (entries * _BITS - 1).bit_length() if entries else 10))
        self.shift = np.uint64(64 - self.bits.bit_length() + 1)
        self.held = np.zeros(self.bits >> 3, np.uint8)

    def _slots(self, numbers: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (numbers.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def add(self, numbers: np.ndarray) -> None:
        s = self._slots(numbers)
        np.bitwise_or.at(self.held, (s >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (s & np.uint64(7)).astype(np.uint8)))

    def has(self, numbers: np.ndarray) -> np.ndarray:
        s = self._slots(numbers)
        return (self.held[(s >> np.uint64(3)).astype(np.int64)] >> (s & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _filter_of(df: DataFrame, column: str, entries: int) -> _Filter:
    """The filter over an array column, built by a few tasks and joined on the driver: its size is bounded, whatever the
    number of entries."""

    def run(batches):
        own = _Filter(entries)
        for batch in batches:
            flat = batch.column(0).flatten()
            if len(flat):
                own.add(np.asarray(flat).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([own.held.tobytes()], pa.binary())], ["held"])

    out = _Filter(entries)
    for r in df.select(column).coalesce(4).mapInArrow(run, "held binary").toLocalIterator():
        out.held |= np.frombuffer(r[0], np.uint8)
    return out


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, variant, w): the words of every different text of an item, without the opening it shares with others.

    An opening is the longest start that at least ``SHARED_BY`` texts have, and most of those that begin alike; starts are
    counted by their hashes.  Null ids and texts without words of their own give no row.
    """

    def read(batches):
        for batch in batches:
            ids, ws = batch.column(0).to_pylist(), [words(t) for t in batch.column(1).to_pylist()]
            keep = [i for i, w in enumerate(ws) if w and ids[i] is not None]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.int64()), pa.array([ws[i] for i in keep], pa.list_(pa.string()))], ["item_id", "w"])

    def starts(batches):
        codes = Codes()
        for batch in batches:
            vs, ks, hs = [], [], []
            for v, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with np.errstate(over="ignore"):
                    c = codes.of(w)
                    h = np.cumsum(c * np.cumprod(np.full(len(c), 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64), dtype=np.uint64)
                own = range(OPENING, len(w) + 1)
                vs += [v] * len(own)
                ks += own
                hs += h[OPENING - 1 :].view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(vs, pa.int64()), pa.array(ks, pa.int32()), pa.array(hs, pa.int64())], ["variant", "k", "h"])

    texts = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    own = cut(texts.mapInArrow(read, "item_id bigint, w array<string>").withColumn("variant", F.xxhash64("item_id", "w")).dropDuplicates(["item_id", "variant"]))
    heads = cut(own.select("variant", "w").mapInArrow(starts, "variant bigint, k int, h bigint"))
    often = heads.groupBy("k", "h").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED_BY)
    shared = heads.join(often, ["k", "h"])
    alike = shared.where(F.col("k") == OPENING).select("variant", F.col("n").alias("alike"))
    opening = shared.join(alike, "variant").where(F.col("n") >= F.col("alike") * 0.6).join(own.select("variant", F.size("w").alias("size")), "variant").where("k < size").groupBy("variant").agg(F.max("k").alias("cut_at"))
    at = F.coalesce("cut_at", F.lit(0))
    return own.join(opening, "variant", "left").select("item_id", "variant", F.slice("w", at + 1, F.size("w")).alias("w")).where(F.size("w") > 0)


def item_prints(own: DataFrame) -> DataFrame:
    """(item_id, variant, k, w, least, codes, at, hs): each item's fingerprints, for its own k and w, and its word codes."""

    def run(batches):
        codes = Codes()
        for batch in batches:
            rows = []
            for i, v, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                n = len(text)
                span = min(guaranteed_run(n), RUN)
                k = max(1, min(4, span))
                w = span - k + 1
                c = codes.of(text)
                h = _grams(c, k)
                at = winnow(h, w)
                rows.append((i, v, k, w, least_hits(n, k, w), c.tobytes(), at.tolist(), h[at].tolist()))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], ["item_id", "variant", "k", "w", "least", "codes", "at", "hs"])

    return own.mapInArrow(run, "item_id bigint, variant bigint, k int, w int, least int, codes binary, at array<int>, hs array<bigint>")


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every document that holds an item, whole or in part.

    Documents with null id or text, and items without words of their own, give no rows; equal documents and repeated rows
    each count by their id, once; of an id that has several texts each is searched.  Whole texts are read.
    """
    spark = documents.sparkSession
    bodies = cut(item_prints(item_words(items)))
    groups = [(r["k"], r["w"], r["n"]) for r in bodies.groupBy("k", "w").agg(F.sum(F.size("hs")).alias("n")).orderBy("k", "w").collect()]  # a few: by length of run
    filters = [(k, w, spark.sparkContext.broadcast(_filter_of(bodies.where((F.col("k") == k) & (F.col("w") == w)), "hs", n))) for k, w, n in groups]

    def fingerprint(batches):
        codes = Codes()
        for batch in batches:
            ids, ks, ws, ps, hs = [], [], [], [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = codes.of(words(t))
                for k, w, held in filters:
                    h = _grams(c, k)
                    at = winnow(h, w)
                    at = at[held.value.has(h[at])]
                    if len(at):
                        ids.append(d), ks.append(k), ws.append(w), ps.append(at), hs.append(h[at])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ks, pa.int32()), pa.array(ws, pa.int32()), pa.array(ps, pa.list_(pa.int32())), pa.array(hs, pa.list_(pa.int64()))], ["doc_id", "k", "w", "at", "hs"])

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    of_docs = cut(docs.mapInArrow(fingerprint, "doc_id bigint, k int, w int, at array<int>, hs array<bigint>"))
    pair = lambda df, p, *cols: df.select(*cols, "k", "w", F.explode(F.arrays_zip("at", "hs")).alias("x")).select(*cols, "k", "w", F.col("x.at").alias(p), F.col("x.hs").alias("h"))
    both = join_pairs(pair(of_docs, "p", "doc_id"), pair(bodies, "q", "item_id", "variant", "least"), ["k", "w", "h"], "doc_id")
    # A pair of texts is looked at only on alignments with as many shared fingerprints as a case must leave.
    aligned = both.groupBy("doc_id", "item_id", "variant", (F.col("p") - F.col("q")).alias("shift")).agg(F.count("*").alias("n"), F.max("least").alias("least")).where("n >= least")
    hits = cut(aligned.groupBy("doc_id", "item_id", "variant").agg(F.collect_set("shift").alias("shifts")))
    asked = hits.select("doc_id").distinct().select(F.array("doc_id").alias("d"))
    wanted = spark.sparkContext.broadcast(_filter_of(asked, "d", asked.count()))

    def read(batches):
        codes = Codes()
        for batch in batches:
            keep = wanted.value.has(np.asarray(batch.column(0)).astype(np.int64)) if len(batch) else np.zeros(0, bool)
            some = batch.filter(pa.array(keep, pa.bool_()))
            found = [codes.of(words(t)).tobytes() for t in some.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found, pa.binary())], ["doc_id", "words"])

    def check(batches):
        for batch in batches:
            keep, last = [], (None, None)
            for w, body, shifts in zip(*(batch.column(c).to_pylist() for c in range(2, 5))):
                last = last if last[0] is w or last[0] == w else (w, np.frombuffer(w, np.uint64))
                item = np.frombuffer(body, np.uint64)
                keep.append(any(_extends(last[1], item, s) for s in shifts))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    read_again = docs.mapInArrow(read, "doc_id bigint, words binary")
    pairs = read_again.join(broadcast_if_small(hits), "doc_id").join(broadcast_if_small(bodies.select("item_id", "variant", "codes")), ["item_id", "variant"])
    return pairs.select("doc_id", "item_id", "words", "codes", "shifts").mapInArrow(check, "doc_id bigint, item_id bigint").distinct()
