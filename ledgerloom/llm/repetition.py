"""Problem 10: repetition inside a document, by the fertility of a public tokenizer.

Characters per token, the share of byte-fallback tokens (pieces that are no complete characters) and the entropy of the
token distribution are measured for each document; bands per language tell which documents are out of the usual.  What
share of a document repeats earlier stretches cannot be read off these figures alone.  They do bound it: every repeated
word repeats its tokens, so a document with a repeated share s has at most N - s*W different tokens (N tokens, W words)
and an entropy of at most the logarithm of that.  Documents that the bound leaves in question get the exact count.
"""

from __future__ import annotations

import base64
import math
import os
import re
from collections import Counter
from functools import lru_cache
from itertools import chain
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.texts import Codes, grams, words
from ledgerloom.operators.skew import broadcast_if_small
from ledgerloom.session import cut

STRETCH = 8
SHARE = 0.3
VOCABULARY = os.environ.get("LEDGERLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the usual split of text before byte-level merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """(encode, partial): the encoder of a rank file and the set of its tokens that are no complete characters."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    partial = set()
    for piece, rank in ranks.items():
        try:
            piece.decode("utf-8")
        except UnicodeDecodeError:
            partial.add(rank)
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, partial


_BREAK = re.compile(r"(?<=\S) (?=\S)")


def encode_whole(encode, text: str, step: int = 100_000) -> list[int]:
    """Tokens of a whole text, exactly those of one call: a long text is taken in parts that end where the tokenizer's own
    split ends a piece, before a single blank between two words."""
    text = text.encode("utf-8", "replace").decode("utf-8")
    out, at = [], 0
    while len(text) - at > step:
        cut_at = _BREAK.search(text, at + step)
        if not cut_at:
            break
        out += encode(text[at : cut_at.start()])
        at = cut_at.start()
    return out + encode(text[at:])


def repeated_share(w: list[str], stretch: int = STRETCH, codes: Codes | None = None) -> float:
    """Share of words that lie in a stretch of ``stretch`` or more words that occurred earlier in the document."""
    if len(w) <= stretch:
        return 0.0
    h = grams((codes if codes is not None else Codes()).of(w), stretch)
    if len(set(h.tolist())) == len(h):
        return 0.0
    _, first, of = np.unique(h, return_index=True, return_inverse=True)
    again = np.flatnonzero(first[of] != np.arange(len(h)))
    if not len(again):
        return 0.0
    return float(np.minimum(np.diff(again), stretch).sum() + stretch) / len(w)


def _entropy(ids: np.ndarray, times: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Entropy of tokens that each stand so many times, the different tokens, and how often each stands; 0 for none."""
    kinds, of = np.unique(ids, return_inverse=True)
    c = np.bincount(of, times, len(kinds)) if len(ids) else np.zeros(0)
    n = c.sum()
    return (float(math.log2(n) - (c * np.log2(c)).sum() / n) if n else 0.0), kinds, c


def measure(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, plain_words: bool = False, least: float = SHARE, all_shares: bool = False) -> DataFrame:
    """(key, n_chars, n_tokens, chars_per_token, fallback_share, entropy, n_words, in_question, repeated).

    With ``plain_words`` the figures are those of the document's bare words (no case, punctuation, markup, line numbers),
    as the bound needs; otherwise of the text as it stands, and ``in_question`` and ``repeated`` are null.  ``repeated``
    is null where the bound rules out that the share reaches ``least``, and so is ``entropy`` where the number of different
    tokens alone does, unless ``all_shares`` are asked for.  Null and
    empty texts have no tokens, null ratios and an entropy of 0.
    """
    schema = "k bigint, n_chars bigint, n_tokens bigint, chars_per_token double, fallback_share double, entropy double, n_words bigint, in_question boolean, repeated double"

    def run(batches):
        encode, partial = tokenizer(path)
        broken = np.zeros(max(partial, default=0) + 1, bool)
        broken[list(partial)] = True
        memo: dict[str, tuple[list[int], int]] = {}
        codes = Codes()
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = t or ""
                w: list[str] = words(t) if plain_words else []
                open_ = share = entropy = None
                if plain_words:
                    # Tokens of each different word once, as often as the word stands.
                    times = Counter(w)
                    if len(memo) > 200_000:
                        memo.clear()
                    for x in times:
                        if x not in memo:
                            ids = encode(" " + x)
                            memo[x] = ids, sum(y in partial for y in ids)
                    own = [memo[x][0] for x in times]
                    n, different = sum(map(mul, map(len, own), times.values())), len(set(chain.from_iterable(own)))
                    most, chars = n - least * len(w), sum(map(len, w)) + len(w)
                    open_ = n > 0 and different <= most + 1e-9
                    if open_ or all_shares:
                        ids = np.fromiter(chain.from_iterable(own), np.int64)
                        each = np.repeat(np.fromiter(times.values(), np.int64, len(times)), [len(x) for x in own])
                        entropy = _entropy(ids, each)[0]
                        open_ = open_ and entropy <= math.log2(max(most, 1)) + 1e-9
                        share = repeated_share(w, codes=codes) if open_ or all_shares else None
                    fallback = sum(memo[x][1] * y for x, y in times.items())
                else:
                    ids, chars = np.array(encode_whole(encode, t), np.int64), len(t)
                    n = len(ids)
                    entropy, kinds, c = _entropy(ids, np.ones(n, np.int64))
                    fallback = int(c[broken[np.minimum(kinds, len(broken) - 1)] & (kinds < len(broken))].sum())
                rows.append((k, chars, n, chars / n if n else None, fallback / n if n else None, entropy, len(w), open_, share))
            kinds_ = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds_[i]) for i in range(9)], ["k", "n_chars", "n_tokens", "chars_per_token", "fallback_share", "entropy", "n_words", "in_question", "repeated"])

    rows = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).where("k IS NOT NULL")
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def shares(df: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_tokens, entropy, repeated): every document with the share of its words that repeat earlier
    stretches; of an id that stands several times the largest share.  Texts without words have the share 0."""
    all_ = measure(df, plain_words=True, all_shares=True)
    return all_.groupBy("doc_id").agg(F.max_by(F.struct("n_words", "n_tokens", "entropy", "repeated"), F.struct("repeated", "n_words", "n_tokens")).alias("m")).select("doc_id", "m.*")


def repetitive(df: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id) of documents of whose words at least ``share`` repeat earlier stretches of ``STRETCH`` or more words."""
    return measure(df, plain_words=True, least=share).where(F.col("in_question") & (F.col("repeated") >= share)).select("doc_id").distinct()


def fertility_bands(df: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Each document's fertility with the band of its language and whether it falls outside.

    Bands are quantiles over all documents of a language (mergeable sketches, so a dominant language is no hot spot);
    ``lang`` is compared without case, null as its own group.  Languages with few documents have wide bands and so
    reject little.
    """
    figures = cut(measure(df)).join(df.select("doc_id", F.lower(F.coalesce("lang", F.lit(""))).alias("lang_key")).dropDuplicates(["doc_id"]), "doc_id")
    q = lambda c: F.percentile_approx(c, [low, high], 10_000)
    bands = figures.groupBy("lang_key").agg(q("chars_per_token").alias("b_chars"), q("entropy").alias("b_entropy"), q("fallback_share").alias("b_fallback"))
    out = figures.join(broadcast_if_small(bands), "lang_key")
    outside = (F.col("chars_per_token") < F.col("b_chars")[0]) | (F.col("chars_per_token") > F.col("b_chars")[1]) | (F.col("entropy") < F.col("b_entropy")[0]) | (F.col("fallback_share") > F.col("b_fallback")[1])
    return out.select("doc_id", "lang_key", "n_tokens", "chars_per_token", "fallback_share", "entropy", F.coalesce(outside, F.lit(True)).alias("rejected"))
