"""Which of many names stand anywhere in texts: one pass over the texts, whatever the number of names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Lengths in bytes at which places that no name begins at are left out; places of a text looked at in one go, and
#: pairs held at most before they are given out.
_STEPS, _BLOCK, _HELD = (5, 8, 12, 18, 27), 1 << 18, 1 << 17
#: Bits of the filter per name, and the most bits it may have; a filter that is too small lets more through, never less.
_BITS, _MOST_BITS = 64, 1 << 28
_BASE, _ODD = 0xD6E8FEB86659FD93, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LETTER = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


class _Hashes:
    """Hashes of any stretch of some bytes, each from two sums over what stands before its ends."""

    def __init__(self, most: int) -> None:
        power = lambda base: np.cumprod(np.append(np.ones(1, np.uint64), np.full(most, base, np.uint64)), dtype=np.uint64)
        self.power, self.inverse = power(_BASE), power(pow(_BASE, -1, 1 << 64))

    def over(self, data: np.ndarray) -> None:
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * self.power[: len(data)], dtype=np.uint64)))

    def at(self, place: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[place + length] - self.sums[place]) * self.inverse[place]


class _Filter:
    """A set of 64-bit numbers that may hold more than was put in, never less; its size is bounded.

    A whole name and the beginning of a longer one are different numbers.
    """

    def __init__(self, names: int) -> None:
        self.bits = min(_MOST_BITS, 1 << max(10, (names * _BITS - 1).bit_length() if names else 10))
        self.shift = np.uint64(64 - self.bits.bit_length() + 1)
        self.held = np.zeros(self.bits >> 3, np.uint8)

    def _slots(self, numbers: np.ndarray, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for odd in _ODD:
            s = ((numbers ^ (numbers >> np.uint64(29)) ^ np.uint64(_BASE if whole else 0)) * np.uint64(odd)) >> self.shift
            yield (s >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (s & np.uint64(7)).astype(np.uint8))

    def add(self, numbers: np.ndarray, whole: bool) -> None:
        for at, bit in self._slots(numbers, whole):
            np.bitwise_or.at(self.held, at, bit)

    def has(self, numbers: np.ndarray, whole: bool) -> np.ndarray:
        (at, bit), (other, its) = self._slots(numbers, whole)
        return (self.held[at] & bit != 0) & (self.held[other] & its != 0)


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an array, and where each text begins and ends among them."""
    texts = texts.cast(pa.large_binary())
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8))[at[0] : at[-1]], at - at[0]


def _filter_of(names: DataFrame, entries: int) -> _Filter:
    """The filter over the names and their beginnings, built by a few tasks and joined on the driver."""

    def run(batches):
        own = _Filter(entries)
        for batch in batches:
            data, at = _letters(batch.column(0))
            length = np.diff(at)
            hashes = _Hashes(len(data))
            hashes.over(data)
            own.add(hashes.at(at[:-1], length), True)
            for step in _STEPS:
                own.add(np.unique(hashes.at(at[:-1][length >= step], step)), False)
        yield pa.RecordBatch.from_arrays([pa.array([own.held.tobytes()], pa.binary())], ["held"])

    out = _Filter(entries)
    for r in names.coalesce(4).mapInArrow(run, "held binary").toLocalIterator():
        out.held |= np.frombuffer(r[0], np.uint8)
    return out


def names_held(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(key, name) of texts (key, text) and names (name): names that are part of a text, and possibly a few stretches of
    texts that are no names, so join them with the names; null texts hold nothing, rows may repeat. ``name`` is binary.

    A place of a text is left as soon as no name begins with what stands there; each stretch left that is as long as some
    name is looked up whole. Both go by hashes in a filter of bounded size, so what is given out grows with the texts and
    with what they name, not with texts times names that begin alike.
    """
    counted = names.groupBy(F.octet_length("name").alias("length")).count().collect()
    lengths, entries = {r["length"] for r in counted}, sum(r["count"] for r in counted)
    longest = max(lengths, default=0)
    turns = sorted(lengths | {s for s in _STEPS if s <= longest})
    shared = texts.sparkSession.sparkContext.broadcast(_filter_of(names, entries) if entries else None)

    def run(batches):
        held, hashes, found = shared.value, _Hashes(_BLOCK + longest), set()

        def given(keys):
            rows, names = zip(*found)
            found.clear()
            return pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array(names, pa.binary())], ["key", "name"])

        for batch in batches:
            data, at = _letters(batch.column(1))
            for lo in range(0, len(data), _BLOCK):
                size = min(_BLOCK, len(data) - lo)
                part = data[lo : lo + size + longest]
                hashes.over(part)
                starts = np.append(part & 0xC0 != 0x80, True)  # a letter begins here, or the last text ends
                place = np.flatnonzero(starts[:size])
                row = np.searchsorted(at, place + lo, "right") - 1
                room = np.minimum(at[row + 1] - lo, len(part)) - place
                text = part.tobytes()
                for length in turns:
                    left = room >= length
                    place, row, room = place[left], row[left], room[left]
                    if not len(place):
                        break
                    code = hashes.at(place, length)
                    if length in _STEPS:
                        left = held.has(code, False)
                        place, row, room, code = place[left], row[left], room[left], code[left]
                    if length in lengths:
                        hit = held.has(code, True) & starts[place + length]
                        found.update((r, text[p : p + length]) for r, p in zip(row[hit].tolist(), place[hit].tolist()))
                        if len(found) > _HELD:
                            yield given(batch.column(0))
            if found:
                yield given(batch.column(0))

    rows = texts.where("text IS NOT NULL").select("key", "text")
    out = StructType([StructField("key", rows.schema["key"].dataType), StructField("name", BinaryType())])
    return rows.mapInArrow(run, out) if entries else rows.sparkSession.createDataFrame([], out)
