"""Entity resolution: exact normal forms merge, everything fuzzy becomes a candidate for review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import WORD_EDGE, name_tokens, norm_aggressive, norm_light
from ledgerloom.operators.skew import broadcast_if_small
from ledgerloom.session import cut, free

# Wordings that mark two entities in one field.
COMPOSITE_PATTERNS = [r"\bon behalf of\b", r"\bas fiscal sponsor for\b"]


def mention_counts(columns: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """(entity_type, raw_name, n_mentions, src_table, src_column) over [(table, table name, column, type)].

    Counts of one spelling are added up within its type; the source named is the last configured one that has it.
    """
    parts = []
    for i, (df, table, column, kind) in enumerate(columns):
        name = F.nullif(F.trim(F.col(f"`{column}`").cast("string")), F.lit(""))
        parts.append(df.select(name.alias("raw_name")).where("raw_name IS NOT NULL").groupBy("raw_name").agg(F.count("*").alias("n")).select(F.lit(kind).alias("entity_type"), "raw_name", "n", F.lit(i).alias("i"), F.lit(table).alias("src_table"), F.lit(column).alias("src_column")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    out = both.groupBy("entity_type", "raw_name").agg(F.sum("n").alias("n_mentions"), F.max_by(F.struct("src_table", "src_column"), "i").alias("s"))
    return out.select("entity_type", "raw_name", "n_mentions", "s.src_table", "s.src_column")


def cluster(mentions: DataFrame, least_length: int = 5, composites: list[str] | None = None) -> DataFrame:
    """(entity_type, canonical_name, norm_key, n_mentions, is_intermediary_composite) of every entity.

    Spellings with one normal form are one entity, named by its commonest spelling (ties: the first by text).  Composites
    and very short normal forms stay alone, without key.
    """
    marked = _keyed(mentions, least_length, composites)
    grouped = marked.where("norm_key IS NOT NULL").groupBy("entity_type", "norm_key").agg(F.min_by("raw_name", F.struct(-F.col("n_mentions"), F.col("raw_name"))).alias("canonical_name"), F.sum("n_mentions").alias("n_mentions"))
    alone = marked.where("norm_key IS NULL").select("entity_type", F.lit(None).cast("string").alias("norm_key"), F.col("raw_name").alias("canonical_name"), "n_mentions", "is_intermediary_composite")
    return grouped.withColumn("is_intermediary_composite", F.lit(0)).unionByName(alone)


def _keyed(mentions: DataFrame, least_length: int, composites: list[str] | None) -> DataFrame:
    pattern = "(?iu)" + "|".join(composites or COMPOSITE_PATTERNS).replace(r"\b", WORD_EDGE)
    norm = norm_aggressive(F.col("raw_name"))
    is_composite = F.col("raw_name").rlike(pattern)
    return mentions.withColumns({"is_intermediary_composite": is_composite.cast("int"), "norm_key": F.when(~is_composite & (F.length(norm) >= least_length), norm)})


def with_ids(entities: DataFrame) -> DataFrame:
    """Dense surrogate ids in a defined order: per type, entities without key first, then by key and name.

    Numbering by sorted ranges and offsets, not by one global window.
    """
    order = ["entity_type", F.col("norm_key").isNotNull(), "norm_key", "canonical_name"]
    spread = cut(entities.repartitionByRange(*order).withColumn("_b", F.spark_partition_id()))
    sizes = spread.groupBy("_b").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_o", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_b")) - F.col("_n")).drop("_n")
    inner = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return spread.join(broadcast_if_small(offsets), "_b").withColumn("entity_id", (inner + F.col("_o")).cast("bigint")).drop("_b", "_o")


def aliases(mentions: DataFrame, entities: DataFrame, least_length: int = 5, composites: list[str] | None = None) -> DataFrame:
    """(entity_id, raw_name, entity_type, n_mentions, src_table, src_column): every spelling filed under its entity."""
    marked = _keyed(mentions, least_length, composites)
    keyed = marked.where("norm_key IS NOT NULL").join(entities.where("norm_key IS NOT NULL").select("entity_id", "entity_type", "norm_key"), ["entity_type", "norm_key"])
    alone = marked.where("norm_key IS NULL").join(entities.where("norm_key IS NULL").select("entity_id", "entity_type", F.col("canonical_name").alias("raw_name")), ["entity_type", "raw_name"])
    cols = ["entity_id", "raw_name", "entity_type", "n_mentions", "src_table", "src_column"]
    return keyed.select(*cols).unionByName(alone.select(*cols))


def light_candidates(alias_rows: DataFrame) -> DataFrame:
    """(entity_id_a, entity_id_b, reason, score): neighbours by id among entities that share a light normal form."""
    light = alias_rows.select("entity_type", norm_light(F.col("raw_name")).alias("light"), "entity_id").where("light <> ''").distinct()
    nxt = F.lead("entity_id").over(Window.partitionBy("entity_type", "light").orderBy("entity_id"))
    return light.withColumn("entity_id_b", nxt).where("entity_id_b IS NOT NULL").select(F.col("entity_id").alias("entity_id_a"), "entity_id_b", F.lit("light_norm_match").alias("reason"), F.lit(0.9).alias("score")).distinct()


def token_candidates(entities: DataFrame, least_mentions: int = 3, longest_posting: int = 30, least: float = 0.6) -> DataFrame:
    """(entity_id_a, entity_id_b, reason, score): pairs whose name tokens overlap by Jaccard ``least`` or more.

    As in the documented rule only tokens of at most ``longest_posting`` entities propose pairs: commoner tokens do not
    tell entities apart.  That bound also keeps every token's pairs few.
    """
    named = entities.where(F.col("norm_key").isNotNull() & (F.col("n_mentions") >= least_mentions)).select("entity_id", "entity_type", name_tokens(F.col("canonical_name")).alias("tokens"))
    posting = named.select("entity_id", "entity_type", "tokens", F.explode("tokens").alias("token"))
    rare = posting.groupBy("entity_type", "token").agg(F.count("*").alias("n")).where(F.col("n").between(2, longest_posting)).select("entity_type", "token")
    posting = posting.join(rare, ["entity_type", "token"])
    a, b = posting.select("entity_type", "token", F.col("entity_id").alias("entity_id_a"), F.col("tokens").alias("ta")), posting.select("entity_type", "token", F.col("entity_id").alias("entity_id_b"), F.col("tokens").alias("tb"))
    jaccard = F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))
    pairs = a.join(b, ["entity_type", "token"]).where("entity_id_a < entity_id_b").withColumn("score", F.round(jaccard, 3)).where(jaccard >= least)
    return pairs.select("entity_id_a", "entity_id_b", F.lit("token_overlap").alias("reason"), "score").distinct()


def all_token_candidates(entities: DataFrame, least_mentions: int = 3, least: float = 0.6, hot: int = 1_000, salts: int = 32) -> DataFrame:
    """``token_candidates`` without the bound on postings: every pair whose name tokens overlap by ``least`` or more.

    Sets of tokens that are equal are compared once.  Of two sets that overlap so far, each has one of its
    size - least * size + 1 rarest tokens in the other's (one global order of tokens), so only those propose pairs;
    tokens that propose for more than ``hot`` sets are spread over ``salts`` tasks.
    """
    named = entities.where(F.col("norm_key").isNotNull() & (F.col("n_mentions") >= least_mentions)).select("entity_id", "entity_type", F.array_sort(name_tokens(F.col("canonical_name"))).alias("tokens")).where(F.size("tokens") > 0)
    sets = cut(named.groupBy("entity_type", "tokens").agg(F.count("*").alias("k")).withColumn("s", F.xxhash64("entity_type", F.array_join("tokens", " "))))
    each = sets.select("s", "entity_type", F.size("tokens").alias("m"), F.explode("tokens").alias("token"))
    often = each.groupBy("entity_type", "token").agg(F.count("*").alias("n"))
    ranked = each.join(often, ["entity_type", "token"]).groupBy("s", "entity_type", "m").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
    head = F.slice("t", F.lit(1), (F.col("m") - F.ceil(F.col("m") * least - 1e-9) + 1).cast("int"))
    posting = cut(ranked.select("s", "entity_type", "m", F.explode(head).alias("x")).select("s", "entity_type", "m", "x.token"))
    heat = posting.groupBy("entity_type", "token").agg(F.when(F.count("*") > hot, salts).otherwise(1).alias("w")).where("w > 1")
    posting = posting.join(broadcast_if_small(heat), ["entity_type", "token"], "left").withColumn("w", F.coalesce("w", F.lit(1)))
    a = posting.select("entity_type", "token", F.col("s").alias("s_a"), F.col("m").alias("m_a"), F.pmod("s", "w").cast("int").alias("salt"))
    b = posting.select("entity_type", "token", F.col("s").alias("s_b"), F.col("m").alias("m_b"), F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("salt"))
    near = a.join(b, ["entity_type", "token", "salt"]).where((F.col("s_a") < F.col("s_b")) & (F.least("m_a", "m_b") >= F.greatest("m_a", "m_b") * least - 1e-9)).select("s_a", "s_b").distinct()
    jaccard = F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))
    of = lambda x: sets.select(F.col("s").alias(f"s_{x}"), F.col("tokens").alias(f"t{x}"), "entity_type")
    alike = near.join(of("a").drop("entity_type"), "s_a").join(of("b"), "s_b").where(jaccard >= least).select("entity_type", "ta", "tb", F.round(jaccard, 3).alias("score"))
    same = sets.where("k > 1").select("entity_type", F.col("tokens").alias("ta"), F.col("tokens").alias("tb"), F.lit(1.0).alias("score"))
    member = lambda x: named.select(F.col("entity_id").alias(f"_{x}"), "entity_type", F.col("tokens").alias(f"t{x}"))
    pairs = alike.unionByName(same).join(member("a"), ["entity_type", "ta"]).join(member("b"), ["entity_type", "tb"]).where((F.col("ta") != F.col("tb")) | (F.col("_a") < F.col("_b")))
    return pairs.select(F.least("_a", "_b").alias("entity_id_a"), F.greatest("_a", "_b").alias("entity_id_b"), F.lit("token_overlap").alias("reason"), "score").where("entity_id_a < entity_id_b").distinct()


def survivors(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(entity_id, survivor): the smallest id each linked id is tied to, by label passing with pointer jumping.

    Each round every id takes the smallest label among its neighbours and then its label's own label; labels are combined
    per task before the shuffle.
    """
    edges = pairs.where("a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("e")).select("e.v", "e.u").distinct()
    edges = cut(edges)
    label = cut(edges.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("l")))
    for _ in range(most_rounds):
        near = edges.join(label.select(F.col("v").alias("u"), F.col("l").alias("m")), "u").groupBy("v").agg(F.min("m").alias("m"))
        step = label.join(near, "v").select("v", F.least("l", "m").alias("l"), F.col("l").alias("was"))
        jumped = step.join(step.select(F.col("v").alias("l"), F.col("l").alias("ll")), "l", "left").select("v", F.least("l", F.coalesce("ll", "l")).alias("l"), "was")
        new = cut(jumped)
        free(label)
        label = new
        if new.where("l <> was").isEmpty():  # what a label was stands beside it, so no join is needed to tell
            return label.select(F.col("v").alias("entity_id"), F.col("l").alias("survivor")).where("entity_id <> survivor")
    raise RuntimeError(f"labels were not stable after {most_rounds} rounds")


def apply_confirmed(entities: DataFrame, alias_rows: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, aliases and candidates after confirmed merges: lowest id survives, mentions add up, chains included.

    Pairs that name an id no longer present merge nothing, but are marked applied as the documented step does.
    """
    known = entities.select("entity_id")
    pairs = candidates.where("status = 'confirmed'").select(F.col("entity_id_a").alias("a"), F.col("entity_id_b").alias("b"))
    pairs = pairs.join(known.withColumnRenamed("entity_id", "a"), "a", "left_semi").join(known.withColumnRenamed("entity_id", "b"), "b", "left_semi")
    to = cut(survivors(pairs))
    folded = entities.join(to, "entity_id").groupBy("survivor").agg(F.sum("n_mentions").alias("_more")).withColumnRenamed("survivor", "entity_id")
    kept = entities.join(to, "entity_id", "left_anti").join(folded, "entity_id", "left").withColumn("n_mentions", F.col("n_mentions") + F.coalesce("_more", F.lit(0))).drop("_more")
    moved = alias_rows.join(to, "entity_id", "left").withColumn("entity_id", F.coalesce("survivor", "entity_id")).drop("survivor")
    return kept, moved, candidates.withColumn("status", F.when(F.col("status") == "confirmed", "applied").otherwise(F.col("status")))
