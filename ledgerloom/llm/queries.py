"""Queries of problems 4 to 10, and the SQL that DuckDB can run beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import components, copies, leakage, names, packing, rankwalk, repetition
from ledgerloom.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.entity_groups(table(spark, sf_dir, "entity_merge_candidates"))


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted pairs that the groups are built from."""
    return components.accepted_pairs(table(spark, sf_dir, "entity_merge_candidates"))


def p5_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records in their order, with their stationary mass."""
    return _p5(spark, sf_dir).withColumn("mass", F.round("mass", 9))


def _p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankwalk.rank_walk(rankwalk.score_lists(table(spark, sf_dir, "leads")))


def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records each list of scores ranks."""
    lists = rankwalk.score_lists(table(spark, sf_dir, "leads"))
    return lists.groupBy("list").agg(F.count("*").alias("items"), F.min("score").alias("least"), F.max("score").alias("most"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.further_copies(table(spark, sf_dir, "raw_records"))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct record with its number of copies."""
    counted = copies.count_copies(copies.hash_records(table(spark, sf_dir, "raw_records")))
    return counted.select(F.col("keep").alias("keep_ord"), "copies")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.party_pairs(table(spark, sf_dir, "entities"), table(spark, sf_dir, "aliases"))


def p7_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.weighed_links(table(spark, sf_dir, "entities"), table(spark, sf_dir, "aliases"))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(packing.pack(table(spark, sf_dir, "documents")))


def p8_harmonic_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(packing.pack_harmonic(table(spark, sf_dir, "documents")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetitive(table(spark, sf_dir, "documents"))


def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the share of it that is repeated."""
    return repetition.shares(table(spark, sf_dir, "documents")).select("doc_id", "n_words", F.round("repeated", 6).alias("repeated"))


def p10_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.fertility_bands(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p4_found, p4_pairs, p5_rank, p5_scores, p6_found, p6_counts, p7_found, p7_links, p8_pack, p8_fill, p8_harmonic_fill, p9_found, p10_found, p10_share, p10_fertility)
}

_ACCEPTED = """
    SELECT DISTINCT least(entity_id_a, entity_id_b) AS a, greatest(entity_id_a, entity_id_b) AS b
    FROM entity_merge_candidates
    WHERE regexp_replace(lower(status), '^\\s+|\\s+$', '', 'g') IN ('confirmed', 'applied') AND entity_id_a <> entity_id_b"""

# A record is the sorted list of its places and canonical values; a value is its number, or its text without case,
# punctuation, blanks and Unicode form.
_COPIES = r"""
    r AS (SELECT ord, raw_json FROM raw_records WHERE ord IS NOT NULL AND json_valid(raw_json)),
    t AS (SELECT r.ord, j.fullkey, j.type, json_extract_string(j.atom, '$') AS s FROM r, json_tree(r.raw_json) j),
    b AS (SELECT *, lower(replace(rtrim(regexp_replace(s, '^[\s\x{a0}"''`“”‘’«»]+|[\s\x{a0}"''`“”‘’«»]+$', '', 'g'), ',;:'), '−', '-')) AS bare FROM t),
    n AS (SELECT *, regexp_extract(bare, '^([+-]?)\s?(?:[$€£¥]|usd|eur|gbp)?\s?([+-]?)(\d{1,3}(?:,\d{3})+|\d+)?(\.\d*)?(e[+-]?\d{1,9})?$', ['a', 'b', 'i', 'f', 'e']) AS m,
        regexp_full_match(bare, '([+-]?)\s?(?:[$€£¥]|usd|eur|gbp)?\s?([+-]?)(\d{1,3}(?:,\d{3})+|\d+)?(\.\d*)?(e[+-]?\d{1,9})?') AS fits FROM b),
    v AS (SELECT *, CASE WHEN type NOT IN ('OBJECT', 'ARRAY', 'NULL', 'BOOLEAN') AND fits AND (m.i <> '' OR length(m.f) > 1) AND NOT (m.a <> '' AND m.b <> '') THEN TRY_CAST(m.a || m.b || coalesce(nullif(replace(m.i, ',', ''), ''), '0') || m.f || m.e AS DOUBLE) END AS num FROM n),
    c AS (SELECT ord, fullkey || chr(2) || CASE WHEN type IN ('OBJECT', 'ARRAY') THEN type WHEN type = 'NULL' THEN '~' WHEN type = 'BOOLEAN' THEN '!' || s WHEN num = 0 THEN '0' WHEN num IS NOT NULL THEN '#' || num
        ELSE '''' || nfc_normalize(regexp_replace(replace(lower(nfc_normalize(s)), 'ß', 'ss'), '[\p{P}\p{S}\p{Z}\p{C}]+', '', 'g')) END AS x FROM v),
    h AS (SELECT ord, md5(string_agg(x, chr(1) ORDER BY x)) AS h FROM c GROUP BY ord),
    g AS (SELECT h, min(ord) AS keep, count(*) AS copies FROM h GROUP BY h)"""

_LISTS = """
        base AS (
            SELECT detector_id, created_run, score, rank_score, unnest(CAST(json_extract(evidence, '$[*].locators[*]') AS JSON[])) AS l FROM leads),
        named AS (SELECT *, concat_ws('::', json_extract_string(l, '$.source_group'), json_extract_string(l, '$.native_id')) AS item FROM base),
        lists AS (
            SELECT item, 'score:' || detector_id AS list, score FROM named
            UNION ALL SELECT item, 'rank:' || created_run, rank_score FROM named),
        best AS (
            SELECT item, list, max(score) AS score FROM lists
            WHERE score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score) AND score NOT IN (-1.0, 999999999.0) AND list IS NOT NULL AND item <> ''
            GROUP BY item, list)
"""

ORACLE = {
    "p6_found": f"WITH {_COPIES} SELECT keep AS keep_ord, ord AS copy_ord FROM h JOIN g USING (h) WHERE ord > keep",
    "p6_counts": f"WITH {_COPIES} SELECT keep AS keep_ord, copies FROM g",
    "p4_pairs": _ACCEPTED,
    "p4_found": f"""
        WITH RECURSIVE pairs AS ({_ACCEPTED}),
        edges AS (SELECT a AS v, b AS u FROM pairs UNION SELECT b, a FROM pairs),
        reach(v, u) AS (SELECT v, u FROM edges UNION SELECT r.v, e.u FROM reach r JOIN edges e ON r.u = e.v)
        SELECT min(u) AS group_id, v AS entity_id FROM reach GROUP BY v HAVING min(u) < v""",
    "p5_scores": f"WITH {_LISTS} SELECT list, count(*) AS items, min(score) AS least, max(score) AS most FROM best GROUP BY list",
    # The chain in full: every jump from a record to a higher one by one of its scores, walked 130 rounds.
    "p5_rank": f"""
        WITH RECURSIVE {_LISTS},
        k AS (SELECT item, count(*) AS k FROM best GROUP BY item), size AS (SELECT count(*) AS n FROM k),
        up AS (SELECT a.item AS a, a.list, b.item AS b FROM best a JOIN best b ON a.list = b.list AND b.score > a.score),
        n_up AS (SELECT a, list, count(*) AS n FROM up GROUP BY a, list),
        jump AS (
            SELECT up.a, up.b, 1.0::DOUBLE / k.k / n_up.n AS p FROM up JOIN n_up ON up.a = n_up.a AND up.list = n_up.list JOIN k ON k.item = up.a
            UNION ALL SELECT best.item, best.item, 1.0::DOUBLE / k.k FROM best JOIN k ON best.item = k.item ANTI JOIN n_up ON best.item = n_up.a AND best.list = n_up.list
            UNION ALL SELECT item, item, 0.0::DOUBLE FROM k),
        one AS MATERIALIZED (SELECT a, b, sum(p) AS p FROM jump GROUP BY a, b),
        walk(r, item, mass) AS (
            SELECT 0, item, 1.0::DOUBLE / n FROM k, size
            UNION ALL SELECT w.r + 1, one.b, 0.85 * sum(w.mass * one.p) + 0.15::DOUBLE / max(n) FROM walk w JOIN one ON w.item = one.a, size WHERE w.r < 130 GROUP BY w.r, one.b),
        kept AS (SELECT item, mass FROM walk WHERE r = 130), whole AS (SELECT k.item, coalesce(mass, 0.15::DOUBLE / n) AS mass, k, n FROM k LEFT JOIN kept ON k.item = kept.item, size)
        SELECT item, round(mass, 9) AS mass, CAST(row_number() OVER (ORDER BY round(mass * n, 6) DESC, item) AS BIGINT) AS position, CAST(k AS INTEGER) AS n_scores FROM whole""",
}
