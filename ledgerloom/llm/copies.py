"""Problem 6: records that differ only in how they are written, one row per record with its number of copies.

A record's canonical text has its fields in one order and its values without case, whitespace, punctuation and Unicode
variants; a text that is a number as a whole stands for its value.  Only a 128-bit hash and an independent 64-bit check
of it are kept: both together are the group key, so two records that collide in one of them stay apart.  Counts are
combined per task before the shuffle, so a group with a third of all rows costs one row per task.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from decimal import Decimal

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import deep
from ledgerloom.operators.skew import join_on_hot_key
from ledgerloom.session import cut

_DROP_ASCII = {c: None for c in range(128) if not chr(c).isalnum()}
_DROP = regex.compile(r"[\p{P}\p{S}\p{Z}\p{C}]+")
_QUOTES = " \t\r\n  \"'`“”‘’«»"
_NUMBER = re.compile(r"([+-]?)\s?(?:[$€£¥]|usd|eur|gbp)?\s?([+-]?)(\d{1,3}(?:,\d{3})+|\d+)?(\.\d*)?(e[+-]?\d{1,9})?")


def canonical_text(value: str) -> str:
    """A text without case, whitespace, punctuation and Unicode form, or the value it has as a number."""
    bare = value.strip(_QUOTES)
    if bare and (bare[0] in "+-−$€£¥.uUeEgG" or bare[0].isdigit()):
        match = _NUMBER.fullmatch(bare.rstrip(",;:").replace("−", "-").lower())
        if match and (match[3] or (match[4] and match[4] != ".")) and not (match[1] and match[2]):
            return _number(Decimal((match[1] or match[2]) + (match[3] or "0").replace(",", "") + (match[4] or "") + (match[5] or "")))
    if value.isascii():
        return value.lower().translate(_DROP_ASCII)
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", value).casefold())
    return unicodedata.normalize("NFC", _DROP.sub("", folded))


def _number(value: Decimal) -> str:
    """One text per value, with all its digits: plain up to 400 places, else digits and exponent."""
    if not value.is_finite():
        return str(value).lower()
    if value == 0:
        return "0"
    if abs(value.adjusted()) > 400:
        sign, digits, exponent = value.as_tuple()
        bare = "".join(map(str, digits)).rstrip("0")
        return f"{'-' * sign}{bare}E{exponent + len(digits) - len(bare)}"
    text = format(value, "f")
    return text.rstrip("0").rstrip(".") if "." in text else text.lstrip("0") if value > 0 else "-" + text[1:].lstrip("0")


def _scalar(value) -> str:
    if isinstance(value, str):
        return "'" + canonical_text(value)
    if value is None or isinstance(value, bool):
        return {None: "~", True: "!t", False: "!f"}[value]
    return "'" + _number(value if isinstance(value, Decimal) else Decimal(repr(value)))


def canonical(value) -> str:
    """Canonical text of a parsed record: names sorted, values canonical, lists in their order; at any depth."""
    out, stack = [], [(False, value)]  # (text already, what)
    while stack:
        done, v = stack.pop()
        if done:
            out.append(v)
        elif isinstance(v, dict):
            parts = [x for i, k in enumerate(sorted(v)) for x in ((True, "," * bool(i) + json.dumps(k) + ":"), (False, v[k]))]
            stack += [(True, "}"), *reversed(parts), (True, "{")]
        elif isinstance(v, list):
            parts = [x for i, y in enumerate(v) for x in ((True, "," * bool(i)), (False, y))]
            stack += [(True, "]"), *reversed(parts), (True, "[")]
        else:
            out.append(_scalar(v))
    return "".join(out)


def hash_records(df: DataFrame, key: str = "ord", text: str = "raw_json") -> DataFrame:
    """(key, h binary(16), c bigint) of every record whose text is complete JSON; others and null keys give no row."""

    def run(batches):
        for batch in batches:
            keys, hashes, checks = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not t:
                    continue
                try:
                    form = canonical(deep.loads(t, Decimal)).encode("utf-8", "surrogatepass")
                except ValueError:
                    continue
                keys.append(k)
                hashes.append(hashlib.md5(form, usedforsecurity=False).digest())
                checks.append(int.from_bytes(hashlib.blake2b(form, digest_size=8).digest(), "big", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hashes, pa.binary()), pa.array(checks, pa.int64())], ["k", "h", "c"])

    rows = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    return rows.mapInArrow(run, "k bigint, h binary, c bigint").withColumnRenamed("k", key)


def count_copies(hashed: DataFrame, key: str = "ord") -> DataFrame:
    """(h, c, keep, copies): one row per distinct record, the smallest key and the number of rows that hold it."""
    return hashed.groupBy("h", "c").agg(F.min(key).alias("keep"), F.count("*").alias("copies"))


def further_copies(df: DataFrame, key: str = "ord") -> DataFrame:
    """(keep_<key>, copy_<key>) for every copy beyond the first; unique records give no row."""
    hashed = cut(hash_records(df, key).select(key, F.concat("h", F.to_binary(F.lpad(F.hex("c"), 16, "0"), F.lit("hex"))).alias("id")))
    groups = hashed.groupBy("id").agg(F.min(key).alias("keep"), F.count("*").alias("n")).where("n > 1")
    pairs = join_on_hot_key(hashed, groups, "id", "n", key).where(F.col(key) > F.col("keep"))
    return pairs.select(F.col("keep").alias(f"keep_{key}"), F.col(key).alias(f"copy_{key}"))
