"""Queries of problems 1 to 3 (general data preparation) over the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import drift, instants, shred
from ledgerloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instants.found_instants(table(spark, sf_dir, "norm_press_releases"), table(spark, sf_dir, "press_feeds"))


def p1_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many releases of each feed ended in each status."""
    rows = instants.release_instants(table(spark, sf_dir, "norm_press_releases"), table(spark, sf_dir, "press_feeds"))
    return rows.groupBy("feed_id", "instant_status").agg(F.count_distinct("release_id").alias("releases"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.child_objects(table(spark, sf_dir, "raw_records"))


def p2_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of all flat tables, with their parent links and fields."""
    return shred.shred(table(spark, sf_dir, "raw_records")).withColumn("fields", F.to_json("fields"))


def p2_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the flat tables, pivoted to columns."""
    return shred.flat_table(shred.shred(table(spark, sf_dir, "raw_records"), root=False), "recipient.contacts[]", ["name", "role", "position", "email"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "raw_records"))


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scalar values of all files under their last names, with generated casts."""
    return drift.unified(table(spark, sf_dir, "raw_records"))


def p3_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record of all files, with one typed column per field under its last name."""
    return drift.unified_table(table(spark, sf_dir, "raw_records"))


def p3_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue itself: in how many files of a directory each top-level field stands with each type."""
    raw = table(spark, sf_dir, "raw_records")
    life = drift.catalogue(raw, shred.find_repeating(raw))
    top = life.where("path <> '' AND NOT contains(path, '.') AND NOT contains(path, '[]')")
    return top.groupBy("source_group", F.col("path").alias("field"), "kind").agg(F.count("*").alias("files"), F.sum("n").alias("records"))


QUERIES = {f.__name__: f for f in (p1_found, p1_status, p2_found, p2_tables, p2_contacts, p3_found, p3_types, p3_unified, p3_table)}

# Records walked twice in SQL: once for the paths that repeat in a group, however carried, once for the objects there.
_OPEN = lambda v: f"CASE WHEN json_type({v}) = 'VARCHAR' AND regexp_matches(json_extract_string({v}, '$'), '^\\s*[\\[{{]') AND json_valid(json_extract_string({v}, '$')) THEN CAST(json_extract_string({v}, '$') AS JSON) ELSE {v} END"
_AT = lambda v, k: f"""json_extract({v}, '$."' || {k} || '"')"""
_MAP = lambda v: f"""(json_type({v}) = 'OBJECT' AND len(json_keys({v})) > 0 AND list_bool_and(list_transform(json_keys({v}), lambda x: regexp_full_match(x, '[0-9]+'))) AND list_sort(list_transform(json_keys({v}), lambda x: TRY_CAST(x AS BIGINT))) = range(len(json_keys({v}))) AND list_bool_or(list_transform(json_keys({v}), lambda x: json_type({_AT(v, 'x')}) = 'OBJECT')))"""
_OBJECTS = f"""
    base AS (SELECT ord, source_group AS g, CAST(raw_json AS JSON) AS v FROM raw_records WHERE ord IS NOT NULL AND source_group IS NOT NULL AND json_valid(raw_json) AND json_type(raw_json) = 'OBJECT'),
    walk(g, p, v) AS (
        SELECT g, '', v FROM base
        UNION ALL SELECT g, x.p, x.v FROM (
            SELECT g, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN list_transform(CAST(v AS JSON[]), lambda e: {{'p': p, 'v': e}})
                WHEN p <> '' AND {_MAP('v')} THEN list_transform(json_keys(v), lambda k: {{'p': p, 'v': {_AT('v', 'k')}}})
                ELSE list_transform(json_keys(v), lambda k: {{'p': CASE WHEN p = '' THEN k ELSE p || '.' || k END, 'v': {_OPEN(_AT('v', 'k'))}}}) END) AS x FROM walk)
        WHERE json_type(x.v) IN ('OBJECT', 'ARRAY')),
    rep AS (SELECT DISTINCT g, p FROM walk WHERE p <> '' AND (CASE WHEN json_type(v) = 'ARRAY' THEN list_bool_or(list_transform(CAST(v AS JSON[]), lambda e: json_type(e) = 'OBJECT')) ELSE {_MAP('v')} END)),
    obj(ord, g, p, m, pos, own, v) AS (
        SELECT ord, g, '', '', '', false, v FROM base
        UNION ALL SELECT ord, g, p, m, z.i, own, z.e FROM (
            SELECT y.ord, y.g, y.p, CASE WHEN rep.p IS NULL THEN y.m ELSE y.m || '[]' END AS m, rep.p IS NOT NULL AS own,
                unnest(CASE WHEN rep.p IS NULL THEN [{{'i': y.pos, 'e': y.v}}]
                    WHEN json_type(y.v) = 'ARRAY' THEN list_transform(range(CAST(json_array_length(y.v) AS BIGINT)), lambda i: {{'i': CASE WHEN y.pos = '' THEN '' ELSE y.pos || '.' END || i, 'e': json_extract(y.v, '$[' || i || ']')}})
                    WHEN {_MAP('y.v')} THEN list_transform(json_keys(y.v), lambda k: {{'i': CASE WHEN y.pos = '' THEN '' ELSE y.pos || '.' END || TRY_CAST(k AS BIGINT), 'e': {_AT('y.v', 'k')}}})
                    ELSE [{{'i': CASE WHEN y.pos = '' THEN '' ELSE y.pos || '.' END || '0', 'e': y.v}}] END) AS z
            FROM (SELECT ord, g, x.p AS p, x.m AS m, pos, x.v AS v FROM (
                SELECT ord, g, pos, unnest(list_transform(json_keys(v), lambda k: {{'p': CASE WHEN p = '' THEN k ELSE p || '.' || k END, 'm': CASE WHEN m = '' THEN k ELSE m || '.' || k END, 'v': {_OPEN(_AT('v', 'k'))}}})) AS x FROM obj)
                WHERE json_type(x.v) IN ('OBJECT', 'ARRAY')) y LEFT JOIN rep ON rep.g = y.g AND rep.p = y.p)
        WHERE json_type(z.e) = 'OBJECT')"""


ORACLE = {
    "p2_found": f"WITH RECURSIVE {_OBJECTS} SELECT ord, m AS child_path, pos AS elem_pos FROM obj WHERE own",
    "p2_contacts": r"""
        WITH r AS (SELECT ord, json_extract(raw_json, '$.recipient') AS r FROM raw_records WHERE json_valid(raw_json)),
        v AS (SELECT ord, CASE WHEN json_type(r, '$.contacts') = 'VARCHAR' AND json_valid(json_extract_string(r, '$.contacts')) THEN CAST(json_extract_string(r, '$.contacts') AS JSON) ELSE json_extract(r, '$.contacts') END AS v FROM r),
        k AS (SELECT ord, v, json_type(v) AS t, CASE WHEN json_type(v) = 'OBJECT' THEN json_keys(v) END AS ks FROM v),
        e AS (SELECT ord, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS pos, unnest(CAST(v AS JSON[])) AS el FROM k WHERE t = 'ARRAY'
            UNION ALL SELECT ord, CAST(x AS BIGINT), json_extract(v, '$."' || x || '"') FROM (SELECT ord, v, unnest(ks) AS x FROM k WHERE t = 'OBJECT' AND list_bool_and(list_transform(ks, lambda x: regexp_full_match(x, '[0-9]+'))))
            UNION ALL SELECT ord, 0, v FROM k WHERE t = 'OBJECT' AND NOT list_bool_and(list_transform(ks, lambda x: regexp_full_match(x, '[0-9]+'))))
        SELECT ord, CAST(pos AS VARCHAR) AS elem_pos, '' AS parent_path, '' AS parent_pos, json_extract_string(el, '$.name') AS name, json_extract_string(el, '$.role') AS role, json_extract_string(el, '$.position') AS position, json_extract_string(el, '$.email') AS email
        FROM e WHERE json_type(el) = 'OBJECT'""",
    "p3_types": r"""
        WITH f AS (SELECT source_group, source_file, raw_json FROM raw_records WHERE json_valid(raw_json) AND json_type(raw_json) = 'OBJECT' AND source_group IS NOT NULL AND source_file IS NOT NULL AND NOT regexp_matches(source_file, '(?i)\.xml$')),
        c AS (SELECT source_group, source_file, k AS field, json_type(raw_json, '$."' || k || '"') AS t, json_extract_string(raw_json, '$."' || k || '"') AS s FROM (SELECT *, unnest(json_keys(raw_json)) AS k FROM f)),
        m AS (SELECT source_group, source_file, field, CASE WHEN t = 'BOOLEAN' THEN 'boolean' WHEN t IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE') THEN 'number' WHEN t = 'OBJECT' THEN 'object' WHEN t = 'ARRAY' THEN 'list' ELSE 'text' END AS kind
            FROM c WHERE t <> 'NULL' AND NOT (t = 'VARCHAR' AND trim(s) = '') AND field NOT IN ('amendments', 'changes', 'splits', 'subawards')),
        n AS (SELECT source_group, field, kind, source_file, count(*) AS n FROM m GROUP BY ALL)
        SELECT source_group, field, kind, count(*) AS files, CAST(sum(n) AS BIGINT) AS records FROM n GROUP BY ALL""",
}
