"""One query per operator over the tables of a data directory, with the SQL that computes the same."""

from __future__ import annotations

import csv
import io
import json
import re
import tempfile
import uuid
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import coerce, text
from ledgerloom.operators import detectors, dossier, entities, mentions, normalise, profile, semantic
from ledgerloom.session import shared_folder, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _marked(column: str) -> str:
    """SQL of a text in lower or mixed case in which RE2's word ends stand where the JVM's patterns put them: letters and
    digits beyond ASCII become ``_``, which RE2 takes as part of a word, spaces a blank, and all other characters ``~``."""
    blank = rf"regexp_replace({column}, '[\p{{Z}}\x{{85}}]', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({blank}, '[^\x00-\x7F\p{{L}}\p{{N}}]', '~', 'g'), '[^\x00-\x7F]', '_', 'g')"


# Legal forms, as in functions.text, between the word ends of RE2 on a text from ``_marked``.
_SUFFIX = r"\b(l\.?l\.?c|l\.?l\.?p|inc|incorporated|corp|corporation|co|company|ltd|limited|lp|pllc|pc|the)\b"
_BARE = lambda c: f"regexp_replace({_marked(f'lower({c})')}, '{_SUFFIX}', ' ', 'g')"


def _money_of_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(detectors.exact_sum(F.col("l_extendedprice")).alias("line_total"))
    return lines


# --- detectors ----------------------------------------------------------------------------------------------------


@_query("""
    WITH lines AS (SELECT l_orderkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS line_total FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey AS order_key, o_totalprice AS left_value, line_total AS right_value, round(abs(o_totalprice - line_total), 2) AS diff
    FROM orders JOIN lines ON o_orderkey = l_orderkey WHERE abs(o_totalprice - line_total) > 100000""")
def contradiction(spark: SparkSession, d: str) -> DataFrame:
    """An order's total against the sum of its lines, beyond a tolerance of 100,000."""
    hits = detectors.contradiction(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), _money_of_lines(spark, d), [("o_orderkey", "l_orderkey")], "o_totalprice", "line_total", 100_000)
    return hits.select(F.col("l_o_orderkey").alias("order_key"), F.col("l_o_totalprice").alias("left_value"), F.col("r_line_total").alias("right_value"), F.round("diff", 2).alias("diff"))


@_query("""
    SELECT o_orderkey AS order_key, l_linenumber AS line_number, o_totalprice AS left_value, l_extendedprice AS right_value
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    WHERE abs(o_totalprice - l_extendedprice) > 100000 AND (o_orderstatus IS NULL OR l_linestatus IS NULL OR lower(trim(o_orderstatus)) = lower(trim(l_linestatus)))""")
def contradiction_guard(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    right = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_linestatus")
    hits = detectors.contradiction(left, right, [("o_orderkey", "l_orderkey")], "o_totalprice", "l_extendedprice", 100_000, [("o_orderstatus", "l_linestatus")])
    return hits.select(F.col("l_o_orderkey").alias("order_key"), F.col("r_l_linenumber").alias("line_number"), F.col("l_o_totalprice").alias("left_value"), F.col("r_l_extendedprice").alias("right_value"))


@_query("""
    SELECT CAST(count(*) AS BIGINT) AS pairs, CAST(count(*) FILTER (WHERE (o_totalprice IS NULL) <> (l_extendedprice IS NULL)) AS BIGINT) AS one_side_null,
        CAST(count(*) FILTER (WHERE NOT (o_orderstatus IS NULL OR l_linestatus IS NULL OR lower(trim(o_orderstatus)) = lower(trim(l_linestatus)))) AS BIGINT) AS guard_excluded
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def contradiction_report(spark: SparkSession, d: str) -> DataFrame:
    return detectors.contradiction_report(table(spark, d, "orders"), table(spark, d, "lineitem"), [("o_orderkey", "l_orderkey")], "o_totalprice", "l_extendedprice", [("o_orderstatus", "l_linestatus")])


@_query("SELECT o_orderkey AS order_key, o_totalprice AS score FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice >= 50000")
def gap(spark: SparkSession, d: str) -> DataFrame:
    out = detectors.gap(table(spark, d, "orders").where("o_totalprice >= 50000"), table(spark, d, "lineitem"), [("o_orderkey", "l_orderkey")], score="o_totalprice")
    return out.select(F.col("o_orderkey").alias("order_key"), F.col("gap_score").alias("score"))


@_query("""
    SELECT o_orderkey AS order_key FROM orders o WHERE NOT EXISTS (
        SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND (o.o_orderstatus IS NULL OR l.l_linestatus IS NULL OR lower(trim(o.o_orderstatus)) = lower(trim(l.l_linestatus))))""")
def gap_guard(spark: SparkSession, d: str) -> DataFrame:
    out = detectors.gap(table(spark, d, "orders"), table(spark, d, "lineitem"), [("o_orderkey", "l_orderkey")], [("o_orderstatus", "l_linestatus")])
    return out.select(F.col("o_orderkey").alias("order_key"))


@_query("""
    SELECT l_suppkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n_rows
    FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY l_suppkey ORDER BY total DESC, l_suppkey LIMIT 25""")
def outlier(spark: SparkSession, d: str) -> DataFrame:
    return detectors.outlier_top(table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice"), "l_extendedprice", ["l_suppkey"])


@_query("""
    WITH s AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS dev FROM events WHERE value IS NOT NULL GROUP BY event_type)
    SELECT event_id, e.event_type, value FROM events e JOIN s ON e.event_type = s.event_type WHERE dev > 0 AND abs(value - mean) > 3 * dev""")
def outlier_sigma(spark: SparkSession, d: str) -> DataFrame:
    return detectors.outlier_sigma(table(spark, d, "events").select("event_id", "event_type", "value"), "value", ["event_type"]).select("event_id", "event_type", "value")


@_query("SELECT count(*) AS rows_in, count(DISTINCT (l_suppkey, l_returnflag)) AS n_groups, count(*) / count(DISTINCT (l_suppkey, l_returnflag)) AS rows_per_group FROM lineitem")
def grain(spark: SparkSession, d: str) -> DataFrame:
    return detectors.grain(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"])


COMPOSITES = [r"^(?P<intermediary>.+?)\s+on behalf of\s+(?P<principal>.+)$", r"^(?P<intermediary>.+?)\s+as fiscal sponsor for\s+(?P<principal>.+)$"]


@_query("""
    WITH n AS (SELECT canonical_name AS name, count(*) AS n_records FROM entities WHERE canonical_name IS NOT NULL GROUP BY canonical_name),
    m AS (SELECT *, trim(regexp_extract(name, '(?i)^(.+?)\\s+on behalf of\\s+(.+)$', 2)) AS p1, regexp_extract(name, '(?i)^(.+?)\\s+on behalf of\\s+(.+)$', 1) AS i1,
        trim(regexp_extract(name, '(?i)^(.+?)\\s+as fiscal sponsor for\\s+(.+)$', 2)) AS p2, regexp_extract(name, '(?i)^(.+?)\\s+as fiscal sponsor for\\s+(.+)$', 1) AS i2 FROM n)
    SELECT name, n_records, CASE WHEN p1 <> '' THEN i1 ELSE i2 END AS intermediary, CASE WHEN p1 <> '' THEN p1 ELSE p2 END AS principal FROM m WHERE p1 <> '' OR p2 <> ''""")
def intermediary(spark: SparkSession, d: str) -> DataFrame:
    return detectors.intermediary(table(spark, d, "entities"), "canonical_name", COMPOSITES).select("name", "n_records", "intermediary", "principal")


@_query("""
    SELECT o_orderkey AS order_key, l_linenumber AS line_number, abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS days_apart
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) <= 30""")
def overlap(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("on"))
    right = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("on"))
    out = detectors.overlap(left, right, [("o_orderkey", "l_orderkey")], "on", "on", 30)
    return out.select(F.col("l_o_orderkey").alias("order_key"), F.col("r_l_linenumber").alias("line_number"), F.col("days_apart").cast("bigint").alias("days_apart"))


# --- detectors as a pack names them -------------------------------------------------------------------------------


def _with_provenance(df: DataFrame, group: str, key: str) -> DataFrame:
    return df.withColumns({"source_group": F.lit(group), "native_id": F.col(key).cast("string")})


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Typed tables with locators, as detector packs expect them."""
    lines = table(spark, d, "lineitem").withColumn("line", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    totals = lines.groupBy("l_orderkey").agg(detectors.exact_sum(F.col("l_extendedprice")).alias("line_total"), F.max("l_linestatus").alias("l_linestatus"))
    return {
        "orders": _with_provenance(table(spark, d, "orders"), "orders", "o_orderkey"), "lines": _with_provenance(lines, "lines", "line"),
        "totals": _with_provenance(totals, "totals", "l_orderkey"), "events": _with_provenance(table(spark, d, "events"), "events", "event_id"),
        "entities": _with_provenance(table(spark, d, "entities"), "entities", "entity_id"),
    }


def _pack(id_: str, template: str, **params) -> detectors.Detector:
    return detectors.Detector(id_, template, params, ["a lawful cause"], template == "gap")


def _shown(spark: SparkSession, d: str, detector: detectors.Detector) -> DataFrame:
    """A detector's leads: what they are, their score, and the ids their evidence names."""
    tables = _tables(spark, d)
    stopped = detectors.preflight(detector, tables)
    if stopped:
        raise ValueError("; ".join(stopped))
    ids = F.transform(F.from_json("evidence", "array<struct<locators:array<struct<native_id:string>>>>"), lambda e: e["locators"][0]["native_id"])
    leads = detectors.run_detector(detector, tables, "run-1")
    return leads.select("detector_id", "signal_type", "legal_flag", F.round("score", 4).alias("score"), F.array_join(ids, "|").alias("ids"))


@_query("""
    WITH t AS (SELECT l_orderkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS line_total, max(l_linestatus) AS st FROM lineitem GROUP BY l_orderkey)
    SELECT 'totals_differ' AS detector_id, 'contradiction' AS signal_type, 0 AS legal_flag, round(abs(o_totalprice - line_total), 4) AS score, o_orderkey || '|' || l_orderkey AS ids
    FROM orders JOIN t ON o_orderkey = l_orderkey WHERE abs(o_totalprice - line_total) > 50000 AND o_orderpriority <> '1.URGENT' AND line_total > 1000 AND (o_orderstatus IS NULL OR st IS NULL OR lower(trim(o_orderstatus)) = lower(trim(st)))""")
def pack_contradiction(spark: SparkSession, d: str) -> DataFrame:
    """A contradiction with guard, tolerance and a fragment for each side, in the documented form of a pack."""
    return _shown(spark, d, _pack("totals_differ", "contradiction", left={"table": "orders", "value_col": "o_totalprice"}, right={"table": "totals", "value_col": "line_total"}, join_on=[["o_orderkey", "l_orderkey"]], tolerance=50_000, guard_cols=[["o_orderstatus", "l_linestatus"]], left_where="AND l.o_orderpriority <> '1.URGENT'", right_where='AND r."line_total" > 1000', label_cols=["o_custkey"]))


@_query("""
    SELECT 'no_lines' AS detector_id, 'gap' AS signal_type, 1 AS legal_flag, round(coalesce(nullif(o_totalprice, 0), 1), 4) AS score, CAST(o_orderkey AS VARCHAR) AS ids
    FROM orders o WHERE o_totalprice >= 50000 AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND (o.o_orderstatus IS NULL OR l.l_linestatus IS NULL OR lower(trim(o.o_orderstatus)) = lower(trim(l.l_linestatus))))""")
def pack_gap(spark: SparkSession, d: str) -> DataFrame:
    return _shown(spark, d, _pack("no_lines", "gap", left={"table": "orders"}, right={"table": "lines"}, join_on=[["o_orderkey", "l_orderkey"]], guard_cols=[["o_orderstatus", "l_linestatus"]], left_where="AND l.o_totalprice >= 50000", expectation="a line", score_col="o_totalprice", label_cols=["o_orderkey"]))


@_query("""
    WITH g AS (SELECT l_suppkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, min(l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey) AS id FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY l_suppkey)
    SELECT 'top_suppliers' AS detector_id, 'outlier' AS signal_type, 0 AS legal_flag, round(total, 4) AS score, id AS ids FROM g ORDER BY total DESC, l_suppkey LIMIT 25""")
def pack_outlier(spark: SparkSession, d: str) -> DataFrame:
    return _shown(spark, d, _pack("top_suppliers", "outlier", table="lines", value_col="l_extendedprice", group_cols=["l_suppkey"], method="top_n", n=25))


@_query("""
    WITH s AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS dev FROM events WHERE value IS NOT NULL GROUP BY event_type)
    SELECT 'far_events' AS detector_id, 'outlier' AS signal_type, 0 AS legal_flag, round(abs(value - mean) / dev, 4) AS score, CAST(event_id AS VARCHAR) AS ids
    FROM events e JOIN s ON e.event_type IS NOT DISTINCT FROM s.event_type WHERE dev > 0 AND abs(value - mean) > 2.5 * dev""")
def pack_sigma(spark: SparkSession, d: str) -> DataFrame:
    return _shown(spark, d, _pack("far_events", "outlier", table="events", value_col="value", group_cols=["event_type"], method="sigma", threshold=2.5))


@_query("""
    WITH n AS (SELECT canonical_name AS name, count(*) AS n_records, min(CAST(entity_id AS VARCHAR)) AS id FROM entities WHERE canonical_name IS NOT NULL GROUP BY canonical_name)
    SELECT 'hidden' AS detector_id, 'hidden_principal' AS signal_type, 0 AS legal_flag, CAST(n_records AS DOUBLE) AS score, id AS ids FROM n
    WHERE trim(regexp_extract(name, '(?i)^(.+?)\\s+on behalf of\\s+(.+)$', 2)) <> '' OR trim(regexp_extract(name, '(?i)^(.+?)\\s+as fiscal sponsor for\\s+(.+)$', 2)) <> ''""")
def pack_intermediary(spark: SparkSession, d: str) -> DataFrame:
    return _shown(spark, d, _pack("hidden", "intermediary", table="entities", name_col="canonical_name", patterns=COMPOSITES))


@_query("""
    SELECT 'ordered_and_shipped' AS detector_id, 'timing_overlap' AS signal_type, 0 AS legal_flag, round(coalesce(nullif(o_totalprice, 0), 1), 4) AS score, o_orderkey || '|' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS ids
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE abs(epoch_us(o_orderdate) - epoch_us(l_shipdate)) <= 45 * 86400000000::BIGINT AND o_totalprice >= 1000""")
def pack_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _shown(spark, d, _pack("ordered_and_shipped", "overlap", left={"table": "orders", "entity_col": "o_orderkey", "date_col": "o_orderdate", "amount_col": "o_totalprice"}, right={"table": "lines", "entity_col": "l_orderkey", "date_col": "l_shipdate"}, window_days=45, min_amount=1000))


@_query("""
    SELECT 'totals_differ' AS detector_id, unnest(['one_side_null', 'guard_excluded']) AS measure,
        unnest([CAST(count(*) FILTER (WHERE same AND ((o_totalprice IS NULL) <> (l_extendedprice IS NULL))) AS DOUBLE), CAST(count(*) FILTER (WHERE NOT same AND abs(o_totalprice - l_extendedprice) > 100000) AS DOUBLE)]) AS value
    FROM (SELECT *, (o_orderstatus IS NULL OR l_linestatus IS NULL OR lower(trim(o_orderstatus)) = lower(trim(l_linestatus))) AS same FROM orders JOIN lineitem ON o_orderkey = l_orderkey)""")
def pack_report(spark: SparkSession, d: str) -> DataFrame:
    """What a contradiction leaves out, as its report counts it."""
    p = _pack("totals_differ", "contradiction", left={"table": "orders", "value_col": "o_totalprice"}, right={"table": "lines", "value_col": "l_extendedprice"}, join_on=[["o_orderkey", "l_orderkey"]], tolerance=100_000, guard_cols=[["o_orderstatus", "l_linestatus"]])
    return detectors.detector_report(p, _tables(spark, d))


@_query("""
    WITH g AS (SELECT count(*) AS n FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice >= 50000),
    s AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS dev FROM events WHERE value IS NOT NULL GROUP BY event_type),
    f AS (SELECT count(*) AS n FROM events e JOIN s ON e.event_type IS NOT DISTINCT FROM s.event_type WHERE dev > 0 AND abs(value - mean) > 3 * dev)
    SELECT 'no_lines' AS detector_id, n AS leads, n AS different FROM g UNION ALL SELECT 'far_events', n, n FROM f""")
def leads_once(spark: SparkSession, d: str) -> DataFrame:
    """A pack run twice leaves each lead once: leads per detector, and how many of them differ."""
    found = [
        _pack("no_lines", "gap", left={"table": "orders"}, right={"table": "lines"}, join_on=[["o_orderkey", "l_orderkey"]], left_where="AND l.o_totalprice >= 50000"),
        _pack("far_events", "outlier", table="events", value_col="value", group_cols=["event_type"], method="sigma"),
        _pack("cannot_run", "gap", left={"table": "absent"}, right={"table": "lines"}, join_on=[]),
    ]
    store, tables = f"{shared_folder(spark)}/leads-{uuid.uuid4().hex}", _tables(spark, d)
    for _ in range(2):
        skipped = detectors.run_pack(spark, found, tables, "run-1", store)
        if [x.split(":")[0] for x in skipped] != ["cannot_run"]:
            raise RuntimeError("; ".join(skipped))
    return spark.read.parquet(store).groupBy("detector_id").agg(F.count("*").alias("leads"), F.count_distinct("lead_key").alias("different"))


@_query("""
    WITH c AS (SELECT lead_id, detector_id, CASE WHEN isnan(score) THEN NULL ELSE score END AS score, CASE WHEN isnan(rank_score) THEN NULL ELSE rank_score END AS rank_score FROM leads),
    m AS (SELECT detector_id, max(score) AS most FROM c GROUP BY detector_id)
    SELECT c.lead_id, c.detector_id, round(max(coalesce(rank_score, CASE WHEN most > 0 THEN score / most END)), 9) AS rank_score
    FROM c LEFT JOIN m ON c.detector_id = m.detector_id GROUP BY c.lead_id, c.detector_id""")
def rank_leads(spark: SparkSession, d: str) -> DataFrame:
    """All leads; those whose score is not a number have no rank of their own."""
    return detectors.rank_leads(table(spark, d, "leads")).groupBy("lead_id", "detector_id").agg(F.round(F.max("rank_score"), 9).alias("rank_score"))


# --- sources and records ------------------------------------------------------------------------------------------


@_query("SELECT source_file, regexp_replace(source_file, '[0-9]+', '#', 'g') AS template, lower(regexp_extract(source_file, '(\\.[^./]+)$', 1)) || '::' || regexp_replace(source_file, '[0-9]+', '#', 'g') AS grp FROM (SELECT DISTINCT source_file FROM raw_records)")
def path_template(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_records").select("source_file").distinct().select("source_file", text.path_template(F.col("source_file")).alias("template"), text.source_group(F.col("source_file")).alias("grp"))


@_query("SELECT ord, content_hash FROM raw_records WHERE json_valid(raw_json)")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """The canonical hash of every complete record, against the hash it was stored under."""
    from ledgerloom.sources.corpus import hash_of_records

    return hash_of_records(table(spark, d, "raw_records"))


@_query("""
    WITH f AS (SELECT source_group, source_file, ord, raw_json FROM raw_records WHERE json_valid(raw_json) AND json_type(raw_json) = 'OBJECT' AND source_file NOT LIKE '%.xml' AND source_file NOT LIKE '%.csv')
    SELECT source_group, source_file, content_hash, count(*) AS n FROM (SELECT source_group, source_file, content_hash FROM raw_records WHERE ord IN (SELECT ord FROM f)) GROUP BY ALL""")
def corpus_read(spark: SparkSession, d: str) -> DataFrame:
    """The JSON and JSON Lines files written out and read again: groups, files and hashes are as they were."""
    from ledgerloom.sources.corpus import read_corpus

    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    good = table(spark, d, "raw_records").where(F.col("source_file").rlike(r"\.jsonl?$") & F.try_parse_json("raw_json").isNotNull())
    write_files(good, folder)
    return read_corpus(spark, folder).groupBy("source_group", "source_file", "content_hash").agg(F.count("*").alias("n"))


def write_files(records: DataFrame, folder: str) -> None:
    """Each file's records as one file, a JSON list or JSON Lines, in the order of the records, streamed out by file."""

    def run(frames):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        out, name = None, None
        for f in frames:
            for file, text in zip(f["source_file"], f["raw_json"]):
                lines = file.endswith("l")
                if file != name:
                    if out:
                        out.write(b"" if name.endswith("l") else b"]"), out.close()
                    system.create_dir(f"{base}/{file}".rpartition("/")[0])
                    out, name = system.open_output_stream(f"{base}/{file}"), file
                    out.write(b"" if lines else b"[")
                else:
                    out.write(b"\n" if lines else b",")
                out.write(re.sub(r"[\r\n]", " ", text).encode("utf-8"))  # layout: texts hold no bare line ends
        if out:
            out.write(b"" if name.endswith("l") else b"]"), out.close()
        yield pd.DataFrame({"done": [1]})

    spread = records.select("source_file", "ord", "raw_json").repartition("source_file").sortWithinPartitions("source_file", "ord")
    spread.mapInPandas(run, "done int").count()


@_query("""
    WITH f AS (SELECT source_file, arg_min(ord, ord) AS ord FROM raw_records WHERE source_file LIKE '%.xml' AND json_valid(raw_json) AND json_type(raw_json, '$.VENDOR') = 'OBJECT' GROUP BY source_file)
    SELECT r.source_group, r.source_file, regexp_extract(r.source_file, '([^/]+)\\.xml$', 1) AS native_id,
        trim(json_extract_string(raw_json, '$.VENDOR.legal_name'), ' \t\n\r') AS legal_name, json_extract_string(raw_json, '$.VENDOR."@rev"') AS rev,
        CASE json_type(raw_json, '$.VENDOR.officers.officer') WHEN 'ARRAY' THEN CAST(json_array_length(raw_json, '$.VENDOR.officers.officer') AS INTEGER) WHEN 'OBJECT' THEN 1 ELSE 0 END AS officers
    FROM raw_records r SEMI JOIN f ON r.ord = f.ord""")
def corpus_xml(spark: SparkSession, d: str) -> DataFrame:
    """The XML files, one record each, written out and read again: attributes, texts (stripped) and lists are as they were."""
    from ledgerloom.sources.corpus import read_corpus

    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    good = table(spark, d, "raw_records").where(F.col("source_file").endswith(".xml") & F.get_json_object("raw_json", "$.VENDOR").startswith("{") & F.try_parse_json("raw_json").isNotNull())
    write_xml(good.groupBy("source_file").agg(F.min_by("raw_json", "ord").alias("raw_json")), folder)
    read, at = read_corpus(spark, folder), lambda p: normalise.json_at(F.col("raw_json"), f"VENDOR.{p}")
    return read.select("source_group", "source_file", "native_id", at("legal_name").alias("legal_name"), at("@rev").alias("rev"), F.size(normalise.elements_at(F.col("raw_json"), "VENDOR.officers.officer[]")).alias("officers"))


def write_xml(records: DataFrame, folder: str) -> None:
    """Each record as an XML file of its own, the inverse of how they are read."""

    def fill(node, value) -> None:
        for k, v in value.items() if isinstance(value, dict) else ():
            if k.startswith("@"):
                node.set(k[1:], v)
            elif k == "#text":
                node.text = v
            else:
                for x in v if isinstance(v, list) else [v]:
                    fill(ET.SubElement(node, k), x)
        if isinstance(value, str):
            node.text = value

    def run(frames):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        n = 0
        for f in frames:
            for file, text in zip(f["source_file"], f["raw_json"]):
                root = ET.Element("VENDOR")
                fill(root, json.loads(text)["VENDOR"])
                system.create_dir(f"{base}/{file}".rpartition("/")[0])
                with system.open_output_stream(f"{base}/{file}") as out:
                    out.write(ET.tostring(root, encoding="utf-8"))
                n += 1
        yield pd.DataFrame({"n": [n]})

    records.mapInPandas(run, "n int").count()


@_query("""
    WITH p AS (SELECT source_group, source_file, ord, raw_json, row_number() OVER (PARTITION BY source_file ORDER BY ord) AS record_no FROM raw_records WHERE source_file LIKE '%.csv' AND json_valid(raw_json))
    SELECT source_group, source_file, record_no, coalesce(nullif(json_extract_string(raw_json, '$.id'), ''), source_file || ':row=' || record_no) AS native_id, json_extract_string(raw_json, '$.invoice') AS invoice, coalesce(json_extract_string(raw_json, '$.memo'), '') AS memo FROM p""")
def corpus_csv(spark: SparkSession, d: str) -> DataFrame:
    """The CSV files written out and read again, row by row: ids or locators, and two columns, one of which files may lack."""
    from ledgerloom.sources.corpus import read_corpus

    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    write_csv_files(table(spark, d, "raw_records").where(F.col("source_file").endswith(".csv") & F.try_parse_json("raw_json").isNotNull()), folder)
    at = lambda c: F.coalesce(F.get_json_object("raw_json", f"$.{c}"), F.lit(""))
    return read_corpus(spark, folder).select("source_group", "source_file", "record_no", "native_id", at("invoice").alias("invoice"), at("memo").alias("memo"))


def write_csv_files(records: DataFrame, folder: str) -> None:
    """Each file's records as one CSV file, with all columns that any of them has (a file of these tables fits a task)."""

    def one(key, f):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        rows = [json.loads(t) for t in f.sort_values("ord")["raw_json"]]
        system.create_dir(f"{base}/{key[0]}".rpartition("/")[0])
        with system.open_output_stream(f"{base}/{key[0]}") as out:
            text = io.TextIOWrapper(out, encoding="utf-8", newline="")
            sheet = csv.DictWriter(text, list(dict.fromkeys(k for r in rows for k in r)), restval="")
            sheet.writeheader()
            sheet.writerows(rows)
            text.flush()
            text.detach()
        return pd.DataFrame({"n": [len(rows)]})

    records.select("source_file", "ord", "raw_json").groupBy("source_file").applyInPandas(one, "n int").count()


@_query("SELECT source_group, count(*) AS n_records FROM raw_records GROUP BY source_group")
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    from ledgerloom.sources.corpus import reconcile as count

    return count(table(spark, d, "raw_records"))


@_query("""
    SELECT source_group, native_id, content_hash, min(source_file) AS source_file, count(*) AS n FROM raw_records GROUP BY source_group, native_id, content_hash""")
def first_of_each(spark: SparkSession, d: str) -> DataFrame:
    """The record that an idempotent load keeps of each key, and how many rows it stands for."""
    from ledgerloom.sources.corpus import first_of_each as first

    raw = table(spark, d, "raw_records").withColumnRenamed("ord", "record_no")
    n = raw.groupBy("source_group", "native_id", "content_hash").agg(F.count("*").alias("n"))
    return first(raw).join(n, ["source_group", "native_id", "content_hash"]).select("source_group", "native_id", "content_hash", "source_file", "n")


@_query("""
    SELECT ord, source_group, content_hash FROM raw_records WHERE native_id = (SELECT min(native_id) FROM raw_records WHERE source_group = '.csv::payments/#/#-#.csv') AND source_group = '.csv::payments/#/#-#.csv'""")
def show_source(spark: SparkSession, d: str) -> DataFrame:
    from ledgerloom.sources.corpus import show_locator

    raw = table(spark, d, "raw_records")
    group = ".csv::payments/#/#-#.csv"
    first = raw.where(F.col("source_group") == group).agg(F.min("native_id")).first()[0]
    return show_locator(raw, f"{group}::{first}").select("ord", "source_group", "content_hash")


# --- profiles -----------------------------------------------------------------------------------------------------


@_query("""
    WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS rk, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_id, event_type FROM r WHERE rk % greatest(1, n // 300) = 0 AND rk // greatest(1, n // 300) < 300""")
def spread_sample(spark: SparkSession, d: str) -> DataFrame:
    return profile.spread_sample(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 300)


@_query("""
    WITH f AS (SELECT 'lang' AS field, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'text', text FROM documents)
    SELECT field, count(*) AS n_leaves, count(*) FILTER (WHERE value IS NOT NULL AND value <> '') AS nonempty,
        least(count(DISTINCT value) FILTER (WHERE value <> ''), 20000) AS n_distinct, round(count(*) FILTER (WHERE value IS NOT NULL AND value <> '') / (SELECT count(*) FROM documents), 3) AS fill
    FROM f GROUP BY field""")
def field_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    leaves = docs.select(F.lit("documents").alias("source_group"), F.explode(F.array(*[F.struct(F.lit(c).alias("path"), F.col(c).alias("value")) for c in ("lang", "source", "text")])).alias("x"))
    leaves = leaves.select("source_group", "x.path", F.when(F.col("x.value").isNull(), "null").otherwise("text").alias("kind"), "x.value")
    stats = profile.field_stats(leaves, docs.select(F.lit("documents").alias("source_group")))
    shown = F.least("n_distinct", F.lit(20_000))  # as the SQL reports it; the statistic itself has no bound
    return stats.select(F.col("path").alias("field"), "n_leaves", "nonempty", shown.cast("bigint").alias("n_distinct"), "fill")


# A record's leaves in SQL, with paths, kinds and texts as the profile has them.
_LEAVES = """leaves AS (SELECT source_group, regexp_replace(regexp_replace(replace(fullkey, '"', ''), '^\\$\\.?', ''), '\\[[0-9]+\\]', '[]', 'g') AS path,
        CASE WHEN type = 'NULL' THEN 'null' WHEN type IN ('UBIGINT', 'BIGINT', 'HUGEINT') THEN 'integer' WHEN type = 'DOUBLE' THEN 'real' WHEN type = 'BOOLEAN' THEN CAST(atom AS VARCHAR) ELSE 'text' END AS kind,
        CASE WHEN type = 'NULL' THEN NULL ELSE json_extract_string(atom, '$') END AS value
        FROM (SELECT source_group, unnest(list_zip(k, t, a)) AS x, x[1] AS fullkey, x[2] AS type, x[3] AS atom FROM (
            SELECT source_group, ord, list(j.fullkey) AS k, list(j.type) AS t, list(j.atom) AS a FROM (SELECT source_group, ord, raw_json FROM raw_records WHERE json_valid(raw_json)) r, json_tree(r.raw_json) j WHERE j.type NOT IN ('OBJECT', 'ARRAY') GROUP BY source_group, ord)))"""


@_query(f"""
    WITH {_LEAVES}, total AS (SELECT source_group, count(*) AS n_records FROM raw_records GROUP BY source_group),
    v AS (SELECT source_group, path, value, count(*) AS n FROM leaves WHERE value <> '' GROUP BY ALL),
    p AS (SELECT source_group, path, sum(n) AS nonempty, count(*) AS n_distinct, avg(length(value)) AS avg_len, min(substr(value, 1, 80)) AS example FROM v GROUP BY ALL),
    n AS (SELECT source_group, path, count(*) AS n_leaves FROM leaves GROUP BY ALL),
    s AS (SELECT n.source_group, n.path, n_leaves, coalesce(nonempty, 0) AS nonempty, coalesce(n_distinct, 0) AS n_distinct, avg_len, example, round(coalesce(nonempty, 0) / n_records, 3) AS fill FROM n LEFT JOIN p USING (source_group, path) JOIN total USING (source_group))
    SELECT source_group, path, n_leaves, CAST(nonempty AS BIGINT) AS nonempty, CAST(n_distinct AS BIGINT) AS n_distinct, round(avg_len, 6) AS avg_len, example, fill,
        NOT regexp_matches(path, '{profile.JUNK_HINT}') AND nonempty >= 25 AND ((regexp_matches(path, '{profile.ID_HINT}') AND n_distinct / nonempty > 0.001) OR (n_distinct / nonempty > 0.95 AND avg_len <= 40)) AS id_candidate,
        regexp_matches(path, '{profile.NAME_HINT}') AND NOT regexp_matches(path, '{profile.JUNK_HINT}') AND fill > 0.3 AS name_candidate FROM s""")
def field_profile(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of every field of every group of raw records, with identifier and name candidates marked."""
    raw = table(spark, d, "raw_records")
    stats = profile.field_stats(profile.flatten(raw), raw)
    marked = stats.withColumns({"id_candidate": F.coalesce(profile.is_id_candidate(), F.lit(False)), "name_candidate": profile.is_name_candidate()})
    return marked.select("source_group", "path", "n_leaves", "nonempty", "n_distinct", F.round("avg_len", 6).alias("avg_len"), "example", "fill", "id_candidate", "name_candidate")


@_query("""
    SELECT 'orders' AS group_a, 'custkey' AS field_a, 'customer' AS group_b, 'custkey' AS field_b, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_a, count(*) AS n_common,
        count(*) / (SELECT count(DISTINCT o_custkey) FROM orders) AS containment
    FROM (SELECT DISTINCT o_custkey FROM orders) JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT 'customer', 'custkey', 'orders', 'custkey', (SELECT count(DISTINCT c_custkey) FROM customer), count(*), count(*) / (SELECT count(DISTINCT c_custkey) FROM customer)
    FROM (SELECT DISTINCT o_custkey FROM orders) JOIN customer ON o_custkey = c_custkey""")
def containment(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "orders").select(F.lit("orders").alias("grp"), F.lit("custkey").alias("field"), F.col("o_custkey").cast("string").alias("value"))
    values = values.unionByName(table(spark, d, "customer").select(F.lit("customer").alias("grp"), F.lit("custkey").alias("field"), F.col("c_custkey").cast("string").alias("value")))
    return profile.containment(values).select("group_a", "field_a", "group_b", "field_b", "n_a", "n_common", "containment")


@_query(rf"""
    WITH n AS (SELECT DISTINCT 'entities' AS g, regexp_replace({_BARE('canonical_name')}, '[^a-z0-9]+', '', 'g') AS k FROM entities UNION SELECT 'aliases', regexp_replace({_BARE('raw_name')}, '[^a-z0-9]+', '', 'g') FROM aliases),
    v AS (SELECT * FROM n WHERE k <> ''), c AS (SELECT count(*) AS n FROM v a JOIN v b ON a.k = b.k AND a.g = 'entities' AND b.g = 'aliases')
    SELECT g AS group_a, 'name' AS field_a, CASE g WHEN 'entities' THEN 'aliases' ELSE 'entities' END AS group_b, 'name' AS field_b, count(*) AS n_a, max(c.n) AS n_common, max(c.n) / count(*) AS containment FROM v, c GROUP BY g HAVING max(c.n) / count(*) >= 0.3""")
def name_joins(spark: SparkSession, d: str) -> DataFrame:
    """Where identifiers join nothing, names do: in normal form, the best partner of each field."""
    own = table(spark, d, "entities").select(F.lit("entities").alias("grp"), F.lit("name").alias("field"), F.col("canonical_name").alias("value"))
    return profile.name_joins(own.unionByName(table(spark, d, "aliases").select(F.lit("aliases").alias("grp"), F.lit("name").alias("field"), F.col("raw_name").alias("value"))))


@_query("""
    WITH v AS (SELECT source_group, f.field || '[]' AS path, CAST(json_array_length(raw_json, '$.' || f.field) AS BIGINT) AS n FROM raw_records, (VALUES ('tags'), ('amendments'), ('subawards')) f(field) WHERE json_valid(raw_json) AND json_type(raw_json, '$.' || f.field) = 'ARRAY')
    SELECT source_group, path, count(*) AS lists, CAST(sum(n) AS BIGINT) AS elements, max(n) AS longest FROM v GROUP BY ALL""")
def list_lengths(spark: SparkSession, d: str) -> DataFrame:
    """A first look that walks five elements of each list still knows how long the lists are."""
    flat = profile.flatten(table(spark, d, "raw_records"), max_list=5).where("kind = 'list'").where(F.col("path").isin("tags[]", "amendments[]", "subawards[]"))
    n = F.col("value").cast("bigint")
    return flat.groupBy("source_group", "path").agg(F.count("*").alias("lists"), F.sum(n).alias("elements"), F.max(n).alias("longest"))


@_query("""
    WITH k AS (SELECT DISTINCT o_custkey AS v FROM orders)
    SELECT 'orders' AS group_a, 'custkey-orderkey#left' AS field_a, 'customer' AS group_b, 'custkey' AS field_b, (SELECT count(*) FROM k) AS n_a, count(*) AS n_common, 'HIGH' AS reliability
    FROM k JOIN customer ON v = c_custkey""")
def composite_key(spark: SparkSession, d: str) -> DataFrame:
    """The left half of ``custkey-orderkey`` is found to be a customer key."""
    values = table(spark, d, "orders").select(F.lit("orders").alias("grp"), F.lit("custkey-orderkey").alias("field"), F.concat_ws("-", "o_custkey", "o_orderkey").alias("value"))
    values = values.unionByName(table(spark, d, "customer").select(F.lit("customer").alias("grp"), F.lit("custkey").alias("field"), F.col("c_custkey").cast("string").alias("value")))
    out = profile.composite_containment(values, profile.composite_delimiter(values)).where("group_b = 'customer' AND field_a LIKE '%#left'")
    return out.select("group_a", "field_a", "group_b", "field_b", "n_a", "n_common", "reliability")


@_query("""
    SELECT DISTINCT source_group AS grp, f.field AS field, trim(json_extract_string(raw_json, f.p)) AS value
    FROM raw_records, (VALUES ('id', '$.id'), ('recipient.vendor_ref', '$.recipient.vendor_ref'), ('vendor_ref', '$.vendor_ref')) f(field, p)
    WHERE json_valid(raw_json) AND json_type(raw_json, f.p) = 'VARCHAR' AND trim(json_extract_string(raw_json, f.p)) <> ''""")
def exact_values(spark: SparkSession, d: str) -> DataFrame:
    """All distinct values of three identifier fields over whole groups."""
    raw = table(spark, d, "raw_records").where(F.try_parse_json("raw_json").isNotNull())
    return profile.exact_values(raw, ["id", "recipient.vendor_ref", "vendor_ref"])


@_query("""
    WITH v AS (SELECT DISTINCT source_group AS g, trim(json_extract_string(raw_json, '$.id')) AS value FROM raw_records WHERE json_valid(raw_json) AND json_type(raw_json, '$.id') = 'VARCHAR'),
    k AS (SELECT * FROM v WHERE value <> ''), n AS (SELECT g, count(*) AS n_a FROM k GROUP BY g HAVING count(*) >= 25)
    SELECT a.g AS group_a, b.g AS group_b, max(n.n_a) AS n_a, count(*) AS n_common FROM k a JOIN k b ON a.value = b.value AND a.g <> b.g JOIN n ON n.g = a.g JOIN n m ON m.g = b.g
    GROUP BY a.g, b.g""")
def record_containment(spark: SparkSession, d: str) -> DataFrame:
    """How many identifiers of one group of records stand in another, whatever the share."""
    raw = table(spark, d, "raw_records").where(F.try_parse_json("raw_json").isNotNull())
    return profile.containment(profile.exact_values(raw, ["id"]), least=0.0).select("group_a", "group_b", "n_a", "n_common")


@_query(f"""
    WITH {_LEAVES}
    SELECT source_group, path, CASE WHEN value IS NULL OR value = '' THEN 'empty' WHEN kind IN ('true', 'false') THEN 'bool' WHEN kind = 'integer' THEN 'int' WHEN kind = 'real' THEN 'float' WHEN regexp_full_match(value, '-?[0-9]+') THEN 'int_str' ELSE 'str' END AS kind, count(*) AS n
    FROM leaves GROUP BY ALL""")
def loose_types(spark: SparkSession, d: str) -> DataFrame:
    """Loose type labels of all fields, as a first look gives them."""
    return profile.loose_types(profile.flatten(table(spark, d, "raw_records")))


# --- normalisation ------------------------------------------------------------------------------------------------


@_query("""
    SELECT ord, CAST(i AS INTEGER) AS elem_index, trim(json_extract_string(e, '$.on')) AS amended_on, trim(json_extract_string(e, '$.reason')) AS reason
    FROM (SELECT ord, unnest(range(CAST(json_array_length(raw_json, '$.amendments') AS BIGINT))) AS i, unnest(CAST(json_extract(raw_json, '$.amendments[*]') AS JSON[])) AS e
        FROM raw_records WHERE json_valid(raw_json) AND json_type(raw_json, '$.amendments') = 'ARRAY')""")
def explode(spark: SparkSession, d: str) -> DataFrame:
    """A list of objects exploded with positions, each element's fields read by path."""
    raw = table(spark, d, "raw_records").where(F.try_parse_json("raw_json").isNotNull())
    rows = raw.select("ord", F.posexplode(normalise.elements_at(F.col("raw_json"), "amendments[]")).alias("elem_index", "el"))
    return rows.select("ord", "elem_index", coerce.to_text(normalise.json_at(F.col("el"), "on")).alias("amended_on"), coerce.to_text(normalise.json_at(F.col("el"), "reason")).alias("reason"))


@_query("""
    SELECT 'customers' AS origin, CAST(c_custkey AS BIGINT) AS party_key, c_name AS party_name, c_mktsegment AS segment, round(c_acctbal, 2) AS balance, CAST(c_custkey AS VARCHAR) AS native_id, CAST(c_custkey % 2 AS BIGINT) AS odd FROM customer
    UNION ALL SELECT 'suppliers', s_suppkey, s_name, NULL, NULL, CAST(s_suppkey AS VARCHAR), s_suppkey % 2 FROM supplier""")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    """Two groups of records mapped to one table, with a constant, a column one of them lacks, types and a derived column."""
    from ledgerloom.plans.packs import Source, TableMapping

    record = lambda name, group, key: table(spark, d, name).select(F.lit(group).alias("source_group"), F.col(key).cast("string").alias("native_id"), F.lit("h").alias("content_hash"), F.to_json(F.struct("*")).alias("raw_json"))
    raw = record("customer", "c", "c_custkey").unionByName(record("supplier", "s", "s_suppkey"))
    sources = [Source("c", {"party_key": "c_custkey", "party_name": "c_name", "segment": "c_mktsegment", "balance": "c_acctbal"}, {"origin": "customers"}), Source("s", {"party_key": "s_suppkey", "party_name": "s_name"}, {"origin": "suppliers"})]
    mapping = TableMapping("parties", sources, {"party_key": "int", "balance": "money"}, [("odd", "party_key % 2")])
    return normalise.normalise_table(raw, mapping).select("origin", "party_key", "party_name", "segment", "balance", "native_id", "odd")


_AMOUNT = "replace(replace(trim(json_extract_string(raw_json, '$.amount')), '$', ''), ',', '')"


@_query(rf"""
    SELECT ord, json_extract_string(raw_json, '$.id') AS payment_id, CASE WHEN regexp_full_match({_AMOUNT}, '\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*') THEN round(TRY_CAST({_AMOUNT} AS DOUBLE), 2) END AS amount
    FROM raw_records WHERE source_group = '.csv::payments/#/#-#.csv' AND json_valid(raw_json) AND nullif(trim(json_extract_string(raw_json, '$.id')), '') IS NOT NULL""")
def to_money(spark: SparkSession, d: str) -> DataFrame:
    """All payment amounts as money: dollar signs and commas dropped; what cannot be read is null."""
    raw = table(spark, d, "raw_records").where("source_group = '.csv::payments/#/#-#.csv'").where(F.try_parse_json("raw_json").isNotNull())
    rows = raw.select("ord", normalise.json_at(F.col("raw_json"), "id").alias("payment_id"), coerce.to_money(normalise.json_at(F.col("raw_json"), "amount")).alias("amount"))
    return rows.where(coerce.to_text(F.col("payment_id")).isNotNull())


@_query("SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS price FROM part")
def to_int(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", coerce.to_int(F.format_number("p_retailprice", 2)).alias("price"))


@_query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date FROM orders")
def to_date(spark: SparkSession, d: str) -> DataFrame:
    """US, ISO and slashed forms of a date read back to the date."""
    on = F.col("o_orderdate")
    written = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(on, "M/d/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format(on, "yyyy-MM-dd'T'HH:mm")).otherwise(F.date_format(on, "yyyy/MM/dd"))
    return table(spark, d, "orders").select("o_orderkey", coerce.to_date(written).alias("order_date"))


_AT = lambda p: f"nullif(trim(CASE WHEN json_type(raw_json, '$.{p}') NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(raw_json, '$.{p}') END), '')"
_PAID = f"replace(replace({_AT('award.amount_usd')}, '$', ''), ',', '')"


@_query(rf"""
    WITH g AS (SELECT *, CASE WHEN source_group = '.jsonl::grants/archive.jsonl' THEN 'archive' ELSE 'city_portal' END AS source FROM raw_records WHERE source_group IN ('.jsonl::grants/#/#-#.jsonl', '.jsonl::grants/archive.jsonl') AND json_valid(raw_json)),
    v AS (SELECT {_AT('id')} AS grant_id, {_AT('recipient.legal_name')} AS recipient_name, {_AT('recipient.vendor_ref')} AS vendor_ref, {_AT('program.title')} AS program,
        CASE WHEN regexp_full_match({_PAID}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN round(TRY_CAST({_PAID} AS DOUBLE), 2) END AS amount,
        CASE WHEN regexp_full_match(substr({_AT('award.date')}, 1, 10), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST(substr({_AT('award.date')}, 1, 10) AS DATE) END AS awarded_date,
        {_AT('narrative')} AS description, source, source_group, native_id, content_hash FROM g)
    SELECT *, CAST(year(awarded_date) AS INTEGER) AS award_year FROM v""")
def normalised_grants(spark: SparkSession, d: str) -> DataFrame:
    """The grants of the raw records as one typed table, from two groups, by a mapping."""
    from ledgerloom.plans.packs import Source, TableMapping

    paths = {"grant_id": "id", "recipient_name": "recipient.legal_name", "vendor_ref": "recipient.vendor_ref", "program": "program.title", "amount": "award.amount_usd", "awarded_date": "award.date", "description": "narrative"}
    mapping = TableMapping("grants", [Source(".jsonl::grants/#/#-#.jsonl", paths, {"source": "city_portal"}), Source(".jsonl::grants/archive.jsonl", paths, {"source": "archive"})], {"amount": "money", "awarded_date": "date"}, [("award_year", "year(awarded_date)")])
    return normalise.normalise_table(table(spark, d, "raw_records"), mapping).drop("elem_index")  # null, as nothing is exploded


@_query("""
    SELECT json_extract_string(e, '$.on') AS amended_on, CAST(round(TRY_CAST(replace(replace(json_extract_string(e, '$.delta'), '$', ''), ',', '') AS DOUBLE), 2) AS DOUBLE) AS delta, nullif(trim(json_extract_string(raw_json, '$.id')), '') AS grant_id, 'amendment' AS kind,
        source_group, native_id, content_hash, CAST(i AS INTEGER) AS elem_index
    FROM (SELECT *, unnest(range(CAST(json_array_length(raw_json, '$.amendments') AS BIGINT))) AS i, unnest(CAST(json_extract(raw_json, '$.amendments') AS JSON[])) AS e
        FROM raw_records WHERE source_group = '.jsonl::grants/archive.jsonl' AND json_valid(raw_json) AND json_type(raw_json, '$.amendments') = 'ARRAY')
    UNION ALL SELECT json_extract_string(v, '$.on'), CAST(round(TRY_CAST(replace(replace(json_extract_string(v, '$.delta'), '$', ''), ',', '') AS DOUBLE), 2) AS DOUBLE), nullif(trim(json_extract_string(raw_json, '$.id')), ''), 'amendment', source_group, native_id, content_hash, 0
    FROM (SELECT *, json_extract(raw_json, '$.amendments') AS v FROM raw_records WHERE source_group = '.jsonl::grants/archive.jsonl' AND json_valid(raw_json) AND json_type(raw_json, '$.amendments') = 'OBJECT')""")
def normalised_amendments(spark: SparkSession, d: str) -> DataFrame:
    """A list exploded by a mapping: elements with their positions, a column of the enclosing record, a constant, provenance."""
    from ledgerloom.plans.packs import Source, TableMapping

    source = Source(".jsonl::grants/archive.jsonl", {"amended_on": "on", "delta": "delta", "grant_id": "^.id"}, {"kind": "amendment"}, "amendments[]")
    return normalise.normalise_table(table(spark, d, "raw_records"), TableMapping("amendments", [source], {"delta": "money"}))


@_query("""
    SELECT origin, count(*) AS n FROM (SELECT 'customers' AS origin FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'suppliers' FROM supplier WHERE s_acctbal >= 0) GROUP BY origin""")
def written_tables(spark: SparkSession, d: str) -> DataFrame:
    """A pack's tables written anew with its statements: a derived column, a deletion and a view over the table."""
    from ledgerloom.plans.packs import Source, TableMapping

    record = lambda name, group, key: table(spark, d, name).select(F.lit(group).alias("source_group"), F.col(key).cast("string").alias("native_id"), F.lit("h").alias("content_hash"), F.to_json(F.struct("*")).alias("raw_json"))
    raw = record("customer", "c", "c_custkey").unionByName(record("supplier", "s", "s_suppkey"))
    mapping = TableMapping("parties", [Source("c", {"balance": "c_acctbal"}, {"origin": "c"}), Source("s", {"balance": "s_acctbal"}, {"origin": "s"})], {"balance": "money"})
    views: list[tuple[str, str]] = []
    for sql in ("UPDATE norm_parties SET origin = 'customers' WHERE origin = 'c'", "UPDATE norm_parties SET origin = 'suppliers' WHERE origin = 's'", "DELETE FROM norm_parties WHERE balance < 0", "CREATE VIEW v_parties AS SELECT origin, count(*) AS n FROM norm_parties GROUP BY origin"):
        normalise.derive_from_sql(sql, {"norm_parties": mapping}, views)
    folder = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    normalise.write_tables(raw, [mapping], folder, views=views)
    return spark.read.parquet(f"{folder}/v_parties")


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 4 = 1 THEN '+00:00' ELSE '' END END AS ordered FROM orders")
def to_datetime(spark: SparkSession, d: str) -> DataFrame:
    """US dates stay dates; date and time come out in one form, with the zone they were written with."""
    on = F.col("o_orderdate")
    written = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(on, "M/d/yyyy")).when(F.col("o_orderkey") % 4 == 1, F.date_format(on, "yyyy-MM-dd HH:mm:ss'Z'")).otherwise(F.date_format(on, "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, d, "orders").select("o_orderkey", coerce.to_datetime(written).alias("ordered"))


# --- entities -----------------------------------------------------------------------------------------------------


def _mentioned(spark: SparkSession, d: str) -> DataFrame:
    return entities.mention_counts([(table(spark, d, "norm_press_releases"), "norm_press_releases", "member_name", "person"), (table(spark, d, "customer"), "customer", "c_mktsegment", "org"), (table(spark, d, "part"), "part", "p_brand", "org")])


@_query("""
    WITH m AS (SELECT 'person' AS entity_type, trim(member_name) AS raw_name, 0 AS i, 'norm_press_releases' AS t, 'member_name' AS c FROM norm_press_releases
        UNION ALL SELECT 'org', trim(c_mktsegment), 1, 'customer', 'c_mktsegment' FROM customer UNION ALL SELECT 'org', trim(p_brand), 2, 'part', 'p_brand' FROM part)
    SELECT entity_type, raw_name, count(*) AS n_mentions, max_by(t, i) AS src_table, max_by(c, i) AS src_column FROM m WHERE raw_name <> '' GROUP BY entity_type, raw_name""")
def mention_counts(spark: SparkSession, d: str) -> DataFrame:
    return _mentioned(spark, d)


@_query(rf"""
    SELECT entity_id, raw_name, regexp_replace({_BARE('raw_name')}, '[^a-z0-9]+', '', 'g') AS norm_key, regexp_replace(lower(raw_name), '[^a-z0-9]+', '', 'g') AS light
    FROM (SELECT DISTINCT entity_id, raw_name FROM aliases)""")
def norm_key(spark: SparkSession, d: str) -> DataFrame:
    """Normal forms of all names."""
    names = table(spark, d, "aliases").select("entity_id", "raw_name").distinct()
    return names.select("entity_id", "raw_name", text.norm_aggressive(F.col("raw_name")).alias("norm_key"), text.norm_light(F.col("raw_name")).alias("light"))


@_query(rf"""
    WITH m AS (SELECT entity_type, raw_name, sum(n_mentions) AS n, regexp_replace({_BARE('raw_name')}, '[^a-z0-9]+', '', 'g') AS k, regexp_matches({_marked('raw_name')}, '(?i)\bon behalf of\b|\bas fiscal sponsor for\b') AS two
        FROM aliases WHERE entity_type IN ('org', 'person') GROUP BY entity_type, raw_name)
    SELECT entity_type, k AS norm_key, arg_min(raw_name, (-n, raw_name)) AS canonical_name, CAST(sum(n) AS BIGINT) AS n_mentions, 0 AS is_intermediary_composite FROM m WHERE length(k) >= 5 AND NOT two GROUP BY entity_type, k
    UNION ALL SELECT entity_type, NULL, raw_name, CAST(n AS BIGINT), CAST(two AS INTEGER) FROM m WHERE length(k) < 5 OR two""")
def entity_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Entities of all names: clusters of one normal form, and what the guards keep alone."""
    names = table(spark, d, "aliases").where(F.col("entity_type").isin("org", "person")).groupBy("entity_type", "raw_name").agg(F.sum("n_mentions").alias("n_mentions"))
    return entities.cluster(names).select("entity_type", "norm_key", "canonical_name", F.col("n_mentions").cast("bigint").alias("n_mentions"), "is_intermediary_composite")


@_query(rf"""
    WITH m AS (SELECT entity_type, raw_name, sum(n_mentions) AS n, regexp_replace({_BARE('raw_name')}, '[^a-z0-9]+', '', 'g') AS k, regexp_matches({_marked('raw_name')}, '(?i)\bon behalf of\b|\bas fiscal sponsor for\b') AS two
        FROM aliases WHERE entity_type IN ('org', 'person') GROUP BY entity_type, raw_name),
    e AS (SELECT entity_type, k AS norm_key, arg_min(raw_name, (-n, raw_name)) AS canonical_name FROM m WHERE length(k) >= 5 AND NOT two GROUP BY entity_type, k UNION ALL SELECT entity_type, NULL, raw_name FROM m WHERE length(k) < 5 OR two),
    i AS (SELECT *, row_number() OVER (ORDER BY entity_type, norm_key IS NOT NULL, norm_key, canonical_name) AS entity_id FROM e)
    SELECT i.entity_id, m.raw_name FROM m JOIN i ON i.entity_type = m.entity_type AND CASE WHEN length(k) >= 5 AND NOT two THEN i.norm_key = m.k ELSE i.norm_key IS NULL AND i.canonical_name = m.raw_name END""")
def entity_ids(spark: SparkSession, d: str) -> DataFrame:
    """Surrogate ids in their defined order, and every spelling filed under one."""
    names = table(spark, d, "aliases").where(F.col("entity_type").isin("org", "person")).groupBy("entity_type", "raw_name").agg(F.sum("n_mentions").alias("n_mentions"))
    names = names.withColumns({"src_table": F.lit("aliases"), "src_column": F.lit("raw_name")})
    return entities.aliases(names, entities.with_ids(entities.cluster(names))).select("entity_id", "raw_name")


@_query("""
    WITH n AS (SELECT 2 * p_partkey AS entity_id, p_name || '.co ' || p_size AS raw_name FROM part UNION ALL SELECT 2 * p_partkey + 1, p_name || 'co ' || p_size FROM part),
    l AS (SELECT DISTINCT regexp_replace(lower(raw_name), '[^a-z0-9]+', '', 'g') AS light, entity_id FROM n),
    x AS (SELECT entity_id AS entity_id_a, lead(entity_id) OVER (PARTITION BY light ORDER BY entity_id) AS entity_id_b FROM l WHERE light <> '')
    SELECT DISTINCT entity_id_a, entity_id_b, 'light_norm_match' AS reason, CAST(0.9 AS DOUBLE) AS score FROM x WHERE entity_id_b IS NOT NULL""")
def light_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Part names written in two ways, which the light form joins and the aggressive one does not."""
    part = table(spark, d, "part")
    written = lambda i, between: part.select((F.col("p_partkey") * 2 + i).alias("entity_id"), F.lit("org").alias("entity_type"), F.concat("p_name", F.lit(between), F.col("p_size").cast("string")).alias("raw_name"))
    return entities.light_candidates(written(0, ".co ").unionByName(written(1, "co ")))


_TOKENS = f"list_distinct(list_filter(regexp_split_to_array({_BARE('canonical_name')}, '[^a-z0-9]+'), lambda t: length(t) > 2))"


@_query(rf"""
    WITH e AS (SELECT entity_id, entity_type, {_TOKENS} AS tokens FROM entities WHERE norm_key IS NOT NULL AND n_mentions >= 3),
    p AS (SELECT entity_id, entity_type, tokens, unnest(tokens) AS token FROM e),
    r AS (SELECT entity_type, token FROM p GROUP BY entity_type, token HAVING count(*) BETWEEN 2 AND 30),
    q AS (SELECT p.* FROM p JOIN r USING (entity_type, token)),
    j AS (SELECT DISTINCT a.entity_id AS entity_id_a, b.entity_id AS entity_id_b, len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))) AS s
        FROM q a JOIN q b ON a.entity_type = b.entity_type AND a.token = b.token AND a.entity_id < b.entity_id)
    SELECT entity_id_a, entity_id_b, round(s, 3) AS score FROM j WHERE s >= 0.6""")
def jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Token candidates among all entities, by the documented rule."""
    return entities.token_candidates(table(spark, d, "entities")).select("entity_id_a", "entity_id_b", "score")


@_query(rf"""
    WITH e AS (SELECT entity_id, entity_type, {_TOKENS} AS tokens FROM entities WHERE norm_key IS NOT NULL AND n_mentions >= 3), p AS (SELECT entity_id, entity_type, tokens, unnest(tokens) AS token FROM e),
    j AS (SELECT DISTINCT a.entity_id AS entity_id_a, b.entity_id AS entity_id_b, len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))) AS s
        FROM p a JOIN p b ON a.entity_type = b.entity_type AND a.token = b.token AND a.entity_id < b.entity_id)
    SELECT entity_id_a, entity_id_b, round(s, 3) AS score FROM j WHERE s >= 0.6""")
def jaccard_exact(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of entities alike by tokens, those with common tokens included, which the documented rule leaves out."""
    return entities.all_token_candidates(table(spark, d, "entities")).select("entity_id_a", "entity_id_b", "score")


@_query("""
    WITH RECURSIVE known AS (SELECT entity_id FROM entities),
    pairs AS (SELECT entity_id_a AS a, entity_id_b AS b FROM entity_merge_candidates WHERE status = 'confirmed' AND entity_id_a IN (FROM known) AND entity_id_b IN (FROM known) AND entity_id_a <> entity_id_b),
    edges AS (SELECT a AS v, b AS u FROM pairs UNION SELECT b, a FROM pairs),
    reach(v, u) AS (SELECT v, u FROM edges UNION SELECT r.v, e.u FROM reach r JOIN edges e ON r.u = e.v),
    s AS (SELECT v AS entity_id, min(u) AS survivor FROM reach GROUP BY v HAVING min(u) < v),
    m AS (SELECT survivor, sum(n_mentions) AS more FROM s JOIN entities USING (entity_id) GROUP BY survivor)
    SELECT e.entity_id, e.canonical_name, CAST(e.n_mentions + coalesce(more, 0) AS BIGINT) AS n_mentions FROM entities e LEFT JOIN m ON e.entity_id = m.survivor WHERE e.entity_id NOT IN (SELECT entity_id FROM s)""")
def apply_merges(spark: SparkSession, d: str) -> DataFrame:
    """Entities after all confirmed merges, chains included."""
    kept, _, _ = entities.apply_confirmed(table(spark, d, "entities"), table(spark, d, "aliases"), table(spark, d, "entity_merge_candidates"))
    return kept.select("entity_id", "canonical_name", F.col("n_mentions").cast("bigint").alias("n_mentions"))


# --- mentions and meaning -----------------------------------------------------------------------------------------

# Words dropped from the end of a searched name, as in functions.text.
_FORMS = "[" + ", ".join(f"'{x}'" for x in dict.fromkeys(x.rstrip(".,") for x in text.TRAILING_FORMS)) + "]"
_INDEXED = lambda c: f"list_filter(regexp_split_to_array(strip_accents(lower({c})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@_query(rf"""
    WITH n AS (SELECT DISTINCT canonical_name AS entity_name, regexp_extract_all(canonical_name, '[A-Za-z0-9][A-Za-z0-9&.-]*') AS w FROM entities WHERE entity_type = 'person' AND is_intermediary_composite = 0),
    c AS (SELECT entity_name, w[1 : list_max(list_transform(range(len(w) + 1), lambda i: CASE WHEN i = 0 OR list_contains({_FORMS}, rtrim(lower(w[i]), '.,')) THEN 0 ELSE i END))] AS w FROM n),
    p AS (SELECT entity_name, regexp_replace(array_to_string(w, ' '), '(?i)^(the )+', '') AS matched_phrase FROM c),
    s AS (SELECT entity_name, matched_phrase, ' ' || array_to_string({_INDEXED('matched_phrase')}, ' ') || ' ' AS needle FROM p WHERE length(matched_phrase) >= 10),
    d AS (SELECT doc_id, ' ' || array_to_string({_INDEXED('text')}, ' ') || ' ' AS hay FROM documents WHERE text IS NOT NULL)
    SELECT DISTINCT entity_name, matched_phrase, doc_id FROM d JOIN s ON contains(hay, needle)""")
def mention(spark: SparkSession, d: str) -> DataFrame:
    """Every person of the entities found by exact phrase in the documents."""
    names = table(spark, d, "entities").where("entity_type = 'person' AND is_intermediary_composite = 0")
    return mentions.mentions(table(spark, d, "documents"), "text", ["doc_id"], mentions.scannable(names, "canonical_name"))


# All that Python's ``split`` takes as white space, for RE2.
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@_query(rf"""
    WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, unnest(range(CASE WHEN len(ws) <= 170 THEN 1 ELSE CAST(ceil((len(ws) - 170) / 130.0) AS BIGINT) + 1 END)) AS i, text, ws FROM w)
    SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CASE WHEN len(ws) <= 170 THEN text ELSE array_to_string(ws[i * 130 + 1 : i * 130 + 170], ' ') END AS chunk FROM c""")
def chunker(spark: SparkSession, d: str) -> DataFrame:
    """Word windows of all texts."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(semantic.chunks(F.col("text"))).alias("chunk_index", "chunk"))


@_query("""
    SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE trim(text) IS NOT NULL AND trim(text) <> '' GROUP BY trim(text)""")
def space_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each distinct text, as a search space keeps it."""
    docs = table(spark, d, "documents")
    kept = semantic.space(docs, "text", ["doc_id"], size=1 << 30).select("doc_id")
    copies = docs.groupBy(F.trim("text").alias("t")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    return kept.join(copies, "doc_id").select("doc_id", "copies")


@_query("""
    WITH f AS (SELECT min(doc_id) AS doc_id, trim(text) AS t FROM documents WHERE trim(text) IS NOT NULL AND trim(text) <> '' GROUP BY trim(text))
    SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id, round(length(t) / sqrt(length(t)::DOUBLE * length(t) + 9), 5) AS x, CAST(2 AS INTEGER) AS dims FROM f""")
def written_space(spark: SparkSession, d: str) -> DataFrame:
    """A space written and read again: distinct texts numbered by key, vectors of an encoder of one's own in unit length."""
    folder, length = f"{shared_folder(spark)}/spaces-{uuid.uuid4().hex}", lambda c: F.array(F.length(c).cast("double"), F.lit(3.0))
    semantic.write_space(semantic.space(table(spark, d, "documents"), "text", ["doc_id"], chunk=False), ["doc_id"], folder, "texts", length)
    rows, meta = semantic.read_space(spark, folder, "texts")
    return rows.select("doc_id", "row_id", F.round(F.col("embedding")[0].cast("double"), 5).alias("x"), F.lit(meta["dims"]).alias("dims"))


def _queries_of(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))


_SCORES = """SELECT q.vec_id AS query_id, v.vec_id AS row_id, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0"""


@_query(f"""
    WITH s AS ({_SCORES}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM s)
    SELECT query_id, row_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def cos_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    v = table(spark, d, "embeddings")
    return semantic.top_k(semantic.query_scores(v, "vec_id", "embedding", _queries_of(v), "q", "qv", k=10), 10).select("query_id", "row_id", F.round("score", 6).alias("score"), "rank")


@_query(f"WITH s AS ({_SCORES}) SELECT row_id, round(max(score), 6) AS score, arg_max(query_id, (score, -query_id)) AS query_id FROM s GROUP BY row_id")
def seeds_max(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return semantic.best_seed(semantic.query_scores(v, "vec_id", "embedding", _queries_of(v), "q", "qv")).select("row_id", F.round("score", 6).alias("score"), "query_id")


@_query(rf"""
    WITH t AS (SELECT doc_id, {_marked(r"regexp_replace(text, '[\x{1c}-\x{1f}]', ' ', 'g')")} AS t FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, regexp_matches(t, '\b[HS]\.?\s?[RJ]?\.?\s?[0-9]{{1,5}}\b') OR len(list_filter(regexp_extract_all(t, '\b[A-Z][A-Za-z0-9&.\-]{{2,}}\b'), lambda w: w NOT IN
        ('The', 'This', 'Act', 'Bill', 'Issues', 'House', 'Senate', 'Congress', 'Federal', 'United', 'States', 'General', 'All'))) > 0 AS specific
    FROM t""")
def specificity(spark: SparkSession, d: str) -> DataFrame:
    """Whether a text is specific, for all texts."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", semantic.is_specific(F.col("text")).alias("specific"))


@_query("""
    SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year, CASE quarter(o_orderdate) WHEN 1 THEN 'first_quarter' WHEN 2 THEN 'second_quarter' WHEN 3 THEN 'third_quarter' ELSE 'fourth_quarter' END AS quarter FROM orders""")
def quarter(spark: SparkSession, d: str) -> DataFrame:
    return semantic.with_quarter(table(spark, d, "orders"), "o_orderdate").select("o_orderkey", "year", "quarter")


@_query("""
    WITH a AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 2 = 1)
    SELECT round(quantile_cont(list_inner_product(a.e, b.e), 0.995), 9) AS floor FROM a JOIN b ON a.i = b.i""")
def noise_floor(spark: SparkSession, d: str) -> DataFrame:
    """The likeness that unrelated pairs hardly exceed, over the pairs of two spaces in their order."""
    v = table(spark, d, "embeddings")
    floor = semantic.noise_floor(v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1"), "embedding", "vec_id")
    return spark.createDataFrame([(round(floor, 9),)], "floor double")


def _bridge(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    v = table(spark, d, "embeddings").withColumns({"year": F.lit("2024"), "quarter": F.concat(F.lit("q"), (F.floor(F.col("vec_id") / 2) % 4).cast("string"))})
    press = v.where("vec_id % 2 = 0").select(F.col("label").cast("string").alias("member"), "year", "quarter", F.col("vec_id").alias("chunk"), F.col("embedding").alias("vec"))
    descriptions = v.where("vec_id % 2 = 1").select(F.concat(F.lit("C"), F.col("label")).alias("client"), "year", "quarter", F.col("vec_id").alias("chunk"), F.col("embedding").alias("vec"))
    ties = semantic.anchors([v.select(F.col("label").alias("member"), F.concat(F.lit("c"), F.col("label")).alias("client"), F.lit(1.0).alias("strength"))])
    return ties, press, descriptions


_ANCHORED = """
    v AS (SELECT vec_id, label, 'q' || CAST((vec_id // 2) % 4 AS VARCHAR) AS q, embedding::DOUBLE[] AS e FROM embeddings),
    p AS (SELECT * FROM v WHERE vec_id % 2 = 0), d AS (SELECT * FROM v WHERE vec_id % 2 = 1),
    m AS (SELECT label, q, i, avg(x) AS m FROM (SELECT label, q, unnest(range(len(e))) AS i, unnest(e) AS x FROM d) GROUP BY label, q, i),
    c AS (SELECT label, q, list(m ORDER BY i) AS mean FROM m GROUP BY label, q),
    s AS (SELECT p.label, p.q, p.vec_id AS pc, d.vec_id AS dc, list_inner_product(p.e, d.e) AS sim, p.e AS pe FROM p JOIN d ON p.label = d.label AND p.q = d.q),
    b AS (SELECT label, q, pc, max(sim) AS sim, arg_max(dc, (sim, -dc)) AS dc, any_value(pe) AS pe FROM s GROUP BY label, q, pc),
    g AS (SELECT b.*, sim - list_inner_product(pe, mean) / (sqrt(list_inner_product(mean, mean)) + 1e-9) AS margin FROM b JOIN c ON b.label = c.label AND b.q = c.q),
    t AS (SELECT *, row_number() OVER (PARTITION BY label, q ORDER BY sim DESC, pc) AS r FROM g),
    scored AS (SELECT CAST(label AS VARCHAR) AS member, 'C' || label AS client, q AS quarter, pc, dc, sim, margin FROM t WHERE r = 1 AND margin >= 0.08),
    income AS (SELECT 'C' || (c_custkey % 10) AS client, sum(c_acctbal) AS income FROM customer GROUP BY 1),
    ranked AS (SELECT s.*, (sim + margin) * log10(greatest(10, coalesce(income, 0))) * 1.5 AS rank FROM scored s LEFT JOIN income i ON s.client = i.client),
    chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client ORDER BY rank DESC, member, pc) AS n FROM ranked) WHERE n <= 3 ORDER BY rank DESC, member, pc LIMIT 60)"""


@_query(f"WITH {_ANCHORED} SELECT member, client, quarter, pc AS press_chunk, dc AS description_chunk, round(sim, 5) AS sim, round(margin, 5) AS margin FROM scored")
def anchored_score(spark: SparkSession, d: str) -> DataFrame:
    ties, press, descriptions = _bridge(spark, d)
    out = semantic.anchored_scores(ties, press, descriptions, float("-inf"))
    return out.select("member", "client", "quarter", "press_chunk", "description_chunk", F.round("sim", 5).alias("sim"), F.round("margin", 5).alias("margin"))


def _chosen(spark: SparkSession, d: str) -> DataFrame:
    ties, press, descriptions = _bridge(spark, d)
    income = table(spark, d, "customer").select(F.concat(F.lit("c"), (F.col("c_custkey") % 10).cast("string")).alias("client"), F.col("c_acctbal").alias("income"))
    return semantic.rank_and_cap(semantic.anchored_scores(ties, press, descriptions, float("-inf")), income)


@_query(f"WITH {_ANCHORED} SELECT member, client, quarter, pc AS press_chunk, round(rank, 5) AS rank FROM chosen")
def rank_and_cap(spark: SparkSession, d: str) -> DataFrame:
    """Anchored pairs ranked with the income of their clients, three of each client at most, the first sixty."""
    return _chosen(spark, d).select("member", "client", "quarter", "press_chunk", F.round("rank", 5).alias("rank"))


@_query(f"""
    WITH {_ANCHORED}, docs AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS chunk, doc_id, text FROM documents)
    SELECT 'semantic_say_do_anchored' AS detector_id, 'named_person' AS defamation_tier, round(rank, 5) AS score, CAST(a.doc_id AS VARCHAR) || '|' || CAST(b.doc_id AS VARCHAR) AS ids, coalesce(substr(a.text, 1, 240), '') AS quoted
    FROM chosen JOIN docs a ON a.chunk = pc JOIN docs b ON b.chunk = dc""")
def bridge_leads(spark: SparkSession, d: str) -> DataFrame:
    """Leads of the ranked pairs, with texts of the documents standing at the chunks' numbers and their locators."""
    docs = profile.rank_within(table(spark, d, "documents").select("doc_id", "text", F.lit(0).alias("_one")), "_one", "doc_id")
    texts = docs.select(F.col("_rank").alias("chunk"), "text", F.lit("documents").alias("source_group"), F.col("doc_id").cast("string").alias("native_id"))
    leads = semantic.semantic_leads(_chosen(spark, d), texts, texts, "run-1")
    e = F.from_json("evidence", "array<struct<locators:array<struct<native_id:string>>,values:struct<value:string>>>")
    ids = F.array_join(F.transform(e, lambda x: x["locators"][0]["native_id"]), "|")
    return leads.select("detector_id", "defamation_tier", F.round("score", 5).alias("score"), ids.alias("ids"), F.coalesce(e[0]["values"]["value"], F.lit("")).alias("quoted"))


# --- dossiers -----------------------------------------------------------------------------------------------------

_LOCATORS = """SELECT DISTINCT lead_id, json_extract_string(l, '$.source_group') AS source_group, json_extract_string(l, '$.native_id') AS native_id
    FROM (SELECT lead_id, unnest(CAST(json_extract(evidence, '$[*].locators[*]') AS JSON[])) AS l FROM leads)"""


@_query(_LOCATORS)
def evidence_explode(spark: SparkSession, d: str) -> DataFrame:
    return dossier.evidence_rows(table(spark, d, "leads")).select("lead_id", "source_group", "native_id").distinct()


@_query(f"WITH w AS ({_LOCATORS}) SELECT ord, r.source_group, r.native_id FROM raw_records r SEMI JOIN w ON r.source_group = w.source_group AND r.native_id = w.native_id")
def bundle_semi(spark: SparkSession, d: str) -> DataFrame:
    return dossier.bundle_records(table(spark, d, "leads"), table(spark, d, "raw_records")).select("ord", "source_group", "native_id")


@_query("""
    SELECT DISTINCT e.entity_id, l.lead_id FROM entities e JOIN (SELECT DISTINCT lead_id, claim FROM leads) l ON contains(lower(l.claim), lower(e.canonical_name)) WHERE length(e.canonical_name) >= 5""")
def backlinks(spark: SparkSession, d: str) -> DataFrame:
    """Backlinks of all claims to all names."""
    return dossier.backlinks(table(spark, d, "leads"), table(spark, d, "entities"))


@_query("""
    WITH v AS (SELECT lead_id, unnest(CAST(json_extract(evidence, '$[*].values.*') AS JSON[])) AS j FROM leads),
    t AS (SELECT DISTINCT lead_id, claim AS text FROM leads UNION SELECT lead_id, json_extract_string(j, '$') FROM v)
    SELECT DISTINCT e.entity_id, t.lead_id FROM entities e JOIN t ON contains(lower(t.text), lower(e.canonical_name)) WHERE length(e.canonical_name) >= 5""")
def entity_scan(spark: SparkSession, d: str) -> DataFrame:
    """Entities named in claims or in the values that evidence quotes."""
    return dossier.entity_scan(table(spark, d, "leads"), table(spark, d, "entities"))


@_query(f"""
    WITH l AS ({_LOCATORS}), w AS (SELECT DISTINCT source_group, native_id FROM l WHERE native_id IS NOT NULL)
    SELECT w.source_group, w.native_id, r.content_hash, count(*) AS n FROM w LEFT JOIN raw_records r ON r.source_group = w.source_group AND r.native_id = w.native_id GROUP BY ALL""")
def lead_sources(spark: SparkSession, d: str) -> DataFrame:
    """The records that leads point at, each with its rows; those that are not in the store too."""
    return dossier.lead_sources(table(spark, d, "leads"), table(spark, d, "raw_records")).groupBy("source_group", "native_id", "content_hash").agg(F.count("*").alias("n"))


@_query(r"""
    WITH c AS (SELECT DISTINCT lead_id, claim, regexp_extract_all(claim, '\(([^)]{4,160})\)', 1) AS every, regexp_extract(claim, '\bfor \(([^)]{4,160})\)', 1) AS named FROM leads)
    SELECT lead_id, CASE WHEN named <> '' THEN named WHEN len(every) > 0 THEN every[-1] ELSE coalesce(nullif(substr(claim, 1, 60), ''), 'lead') END AS label FROM c""")
def lead_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "leads").select("lead_id", "claim").distinct().select("lead_id", text.lead_label(F.col("claim")).alias("label"))


@_query("""
    WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part)
    SELECT p_partkey, CASE WHEN s = '' THEN 'untitled' ELSE rtrim(substr(s, 1, 60), '-') END AS slug FROM s""")
def slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@_query("""
    WITH c AS (SELECT DISTINCT native_id, trim(regexp_replace(native_id, '[^A-Za-z0-9._-]+', '-', 'g'), '-') AS c FROM raw_records)
    SELECT native_id, CASE WHEN c <> native_id OR c = '' OR length(c) > 80 THEN rtrim(substr(CASE WHEN c = '' THEN 'id' ELSE c END, 1, 80), '-') || '-' || substr(sha1(native_id), 1, 8) ELSE c END AS safe FROM c""")
def safe_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_records").select("native_id").distinct().select("native_id", text.safe_id(F.col("native_id")).alias("safe"))


@_query("""
    SELECT lead_id, claim FROM (SELECT DISTINCT lead_id, claim, CASE WHEN isnan(rank_score) THEN NULL ELSE rank_score END AS r, CASE WHEN isnan(score) THEN NULL ELSE score END AS s FROM leads) ORDER BY r DESC NULLS LAST, s DESC NULLS LAST, lead_id LIMIT 50""")
def top_leads(spark: SparkSession, d: str) -> DataFrame:
    """The fifty leads a dossier starts from (a top-k report); scores that are not numbers come last, with the missing ones."""
    return dossier.top_leads(table(spark, d, "leads").select("lead_id", "claim", "rank_score", "score").distinct()).select("lead_id", "claim")


@_query("""
    SELECT name, coalesce(a, b) AS entity_id FROM (SELECT DISTINCT raw_name AS name, lower(raw_name) AS n FROM aliases) w
    LEFT JOIN (SELECT lower(canonical_name) AS n, min(entity_id) AS a FROM entities GROUP BY 1) o ON w.n = o.n
    LEFT JOIN (SELECT lower(raw_name) AS n, min(entity_id) AS b FROM aliases GROUP BY 1) x ON w.n = x.n WHERE coalesce(a, b) IS NOT NULL""")
def entity_lookup(spark: SparkSession, d: str) -> DataFrame:
    """All names looked up, letter case aside."""
    filed = table(spark, d, "aliases")
    return dossier.entity_of_name(filed.select(F.col("raw_name").alias("name")), table(spark, d, "entities"), filed)


@_query(f"""
    WITH w AS ({_LOCATORS})
    SELECT 'leads' AS key, CAST(count(*) AS VARCHAR) AS value FROM leads UNION ALL SELECT 'entities', CAST(count(*) AS VARCHAR) FROM entities UNION ALL SELECT 'aliases', CAST(count(*) AS VARCHAR) FROM aliases
    UNION ALL SELECT 'raw_records', CAST(count(*) AS VARCHAR) FROM raw_records r SEMI JOIN w ON r.source_group = w.source_group AND r.native_id = w.native_id""")
def evidence_bundle(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of a written bundle."""
    folder = f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}"
    dossier.write_bundle(*(table(spark, d, t) for t in ("leads", "entities", "aliases", "raw_records")), folder)
    return spark.read.parquet(f"{folder}/bundle_manifest")


@_query("""
    WITH l AS (SELECT DISTINCT ON (lead_id) lead_id, status, signal_type, claim, detector_id, CASE WHEN isnan(rank_score) THEN NULL ELSE rank_score END AS r, CASE WHEN isnan(score) THEN NULL ELSE score END AS s FROM leads)
    SELECT lead_id, status, signal_type AS what_it_is, claim, detector_id AS detector FROM l ORDER BY r DESC NULLS LAST, s DESC NULLS LAST, lead_id LIMIT 50""")
def leads_csv(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty leads written as a spreadsheet file, and read again."""
    one = table(spark, d, "leads").groupBy("lead_id").agg(F.first(F.struct("*")).alias("r")).select("r.*")  # rows of an id are alike
    with tempfile.TemporaryDirectory() as folder:  # the driver's own file, as a user would have it
        dossier.write_csv(one, f"{folder}/leads.csv")
        with open(f"{folder}/leads.csv", encoding="utf-8-sig", newline="") as f:
            rows = [(int(r["lead_id"]), r["status"], r["what_it_is"], r["claim"], r["detector"]) for r in csv.DictReader(f)]
    return spark.createDataFrame(rows, "lead_id bigint, status string, what_it_is string, claim string, detector string")


# --- streams, run as batches --------------------------------------------------------------------------------------


@_query("""
    SELECT date_trunc('hour', ts) AS starts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    from ledgerloom.streaming.ingest import windowed_counts

    out = windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("starts"), "event_type", "n", F.round("total", 4).alias("total"))
