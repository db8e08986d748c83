"""Exact phrase mentions of entity names in texts: one pass over the texts for all names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import phrase_of_name, words_of_text
from ledgerloom.operators.skew import broadcast_if_small


def scannable(names: DataFrame, column: str, least_length: int = 10, stop: list[str] | None = None) -> DataFrame:
    """(entity_name, matched_phrase, first, n_words): names worth searching, by their first two words and length."""
    phrase = phrase_of_name(F.col(column))
    out = names.select(F.col(column).alias("entity_name"), phrase.alias("matched_phrase")).distinct().where(F.length("matched_phrase") >= least_length)
    if stop:
        out = out.where(~F.lower("matched_phrase").isin([s.lower() for s in stop]))
    return out.withColumn("w", words_of_text(F.col("matched_phrase"))).where(F.size("w") > 0)


def mentions(docs: DataFrame, text: str, keys: list[str], names: DataFrame) -> DataFrame:
    """(entity_name, matched_phrase, *keys): one row per text and name, however often the name stands in it.

    Each place of a text goes with the words that stand there, as many as the longest phrase has, not with the whole
    text; phrases of one word and of more are looked up in the same pass by the hash of their first one or two words and
    then compared in full.  The lookup side is the name list, broadcast if it is small and shuffled if it is not.
    Null texts, and names and texts without words, give no rows; repeated rows count once.
    """
    head = lambda w, n: F.xxhash64(F.lit(n), F.array_join(F.slice(w, 1, n), " "))
    lookup = names.select("entity_name", "matched_phrase", "w", F.when(F.size("w") > 1, head(F.col("w"), 2)).otherwise(head(F.col("w"), 1)).alias("h"))
    longest = names.agg(F.coalesce(F.max(F.size("w")), F.lit(1))).first()[0]
    words = docs.where(F.col(text).isNotNull()).select(*keys, words_of_text(F.col(text)).alias("t")).where(F.size("t") > 0)
    at = words.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.size("t")), lambda i: F.slice("t", i, longest))).alias("here"))
    starts = at.select(*keys, "here", F.explode(F.array(head(F.col("here"), 1), F.when(F.size("here") > 1, head(F.col("here"), 2)))).alias("h")).where("h IS NOT NULL")
    hit = F.slice("here", F.lit(1), F.size("w")) == F.col("w")
    return starts.join(broadcast_if_small(lookup), "h").where(hit).select("entity_name", "matched_phrase", *keys).distinct()


def write_mentions(spark: SparkSession, pack: dict, tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Run a mention pack and write its table anew: (entity_name, matched_phrase, carried columns, source_group, native_id).

    The pack's query names the entities in its first column; ``tables`` are known to it by their names.
    """
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    asked = spark.sql(pack["names"])
    names = scannable(asked.select(F.col(asked.columns[0]).alias("name")).where("name IS NOT NULL"), "name", pack["least_length"], pack["stop"])
    keys = list(dict.fromkeys([*pack["carry"], "source_group", "native_id"]))
    target = f"{folder}/{pack['out']}"
    mentions(tables[pack["table"]], pack["text"], keys, names).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
