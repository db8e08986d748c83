"""Profiles of raw records: field statistics, identifiers, and joins proved by exact value containment."""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import norm_aggressive
from ledgerloom.operators.normalise import read_once
from ledgerloom.operators.shred import parse
from ledgerloom.operators.skew import broadcast_if_small
from ledgerloom.session import cut

# Hints in field names.
ID_HINT = r"(?i)(^|[._])(id|uuid|guid|key)s?($|[._])|_id$|id$"
NAME_HINT = r"(?i)name|title|label|organi[sz]ation"
JUNK_HINT = r"(?i)middle_name|first_name|last_name|prefix|suffix|phone|address|zip|posted_by|contact|printed|signed|_display|country|state"
DELIMITERS = ["-", ":", "/", "|"]


def spread_sample(df: DataFrame, group: str, order: str, cap: int) -> DataFrame:
    """Every n-th row of each group in order, at most ``cap``: deterministic and spread over the whole group.

    Only group and order are ranked, by blocks and offsets; the rows chosen, few by construction, then fetch the rest of
    their columns.  Rows that tie in group and order are told apart by nothing, so one of the chosen places brings all.
    """
    keys = df.select(group, order)
    ranked = rank_within(keys, group, order)
    size = keys.groupBy(F.col(group).alias("_of")).agg(F.count("*").alias("_size"))
    step = F.greatest(F.lit(1), F.floor(F.col("_size") / cap))
    out = ranked.join(broadcast_if_small(size), F.col(group).eqNullSafe(F.col("_of")))
    chosen = out.where((F.col("_rank") % step == 0) & (F.floor(F.col("_rank") / step) < cap)).select(F.col(group).alias("_g"), F.col(order).alias("_o"))
    if set(df.columns) == {group, order}:
        return chosen.select(F.col("_g").alias(group), F.col("_o").alias(order)).select(*df.columns)
    return df.join(broadcast_if_small(chosen.distinct()), F.col(group).eqNullSafe(F.col("_g")) & F.col(order).eqNullSafe(F.col("_o"))).drop("_g", "_o")


def rank_within(df: DataFrame, group: str, order: str) -> DataFrame:
    """``_rank`` from 0 within each group by ``order``: range-partitioned blocks, numbered, plus the blocks before."""
    spread = cut(df.repartitionByRange(group, order).withColumn("_b", F.spark_partition_id()))
    sizes = spread.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_o", F.sum("_n").over(Window.partitionBy(group).orderBy("_b")) - F.col("_n")).drop("_n")
    before = before.select(F.col(group).alias("_g"), F.col("_b").alias("_b2"), "_o")
    inner = F.row_number().over(Window.partitionBy(group, "_b").orderBy(order)) - 1
    joined = spread.withColumn("_i", inner).join(broadcast_if_small(before), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_b2")))
    return joined.withColumn("_rank", F.col("_i") + F.col("_o")).drop("_b", "_i", "_g", "_b2", "_o")


def _leaves(value, path: str, out: list, max_list: int | None) -> None:
    """Leaves in their order, without recursion, so that nesting has no limit of its own."""
    stack = [(path, value)]
    while stack:
        path, value = stack.pop()
        if isinstance(value, dict):
            stack.extend((f"{path}.{k}" if path else k, v) for k, v in reversed(value.items()))
            continue
        if isinstance(value, list):
            if max_list is not None:
                out.append((path + "[]", "list", str(len(value))))
            stack.extend((path + "[]", v) for v in reversed(value[:max_list]))
            continue
        kind = "null" if value is None else "true" if value is True else "false" if value is False else "integer" if isinstance(value, int) else "real" if isinstance(value, float) else "text"
        out.append((path, kind, None if value is None else value if isinstance(value, str) else json.dumps(value)))


def flatten(df: DataFrame, group: str = "source_group", text: str = "raw_json", max_list: int | None = None) -> DataFrame:
    """(group, path, kind, value): every leaf of every record; list positions are ``[]``, containers are left out.

    For a first look ``max_list`` walks only so many elements of each list and adds a row of the kind ``list`` with its
    whole length; by default all elements are walked.
    """

    def run(batches):
        for batch in batches:
            gs, ps, ks, vs = [], [], [], []
            for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                record = parse(t)
                if record is None:
                    continue
                leaves: list = []
                _leaves(record, "", leaves, max_list)
                for p, k, v in leaves:
                    gs.append(g), ps.append(p), ks.append(k), vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (gs, ps, ks, vs)], ["g", "path", "kind", "value"])

    return df.select(F.col(group).alias("g"), text).mapInArrow(run, "g string, path string, kind string, value string").withColumnRenamed("g", group)


def field_stats(leaves: DataFrame, records: DataFrame, group: str = "source_group") -> DataFrame:
    """Per group and path: leaves, nonempty, distinct, types, examples, fill, length, all over the whole group.

    ``fill`` is nonempty over the group's records and exceeds 1 for fields inside lists.  ``examples`` are up to four
    values cut to 80 characters, ``example`` the smallest of all: the smallest of each of sixteen classes by the first
    digit of the value's MD5, of which the first four stand, so they depend neither on the order of rows nor on a sort.
    """
    full = F.col("value").isNotNull() & (F.col("value") != "")
    values = leaves.where(full).groupBy(group, "path", "value").agg(F.count("*").alias("n"))
    digit, short = F.substring(F.md5(F.col("value").cast("binary")), 1, 1), F.substring("value", 1, 80)
    per_value = values.groupBy(group, "path").agg(
        F.sum("n").alias("nonempty"), F.count("*").alias("n_distinct"), F.avg(F.length("value")).alias("avg_len"), F.min(short).alias("example"),
        F.array(*[F.min(F.when(digit == x, short)) for x in "0123456789abcdef"]).alias("examples"),
    )
    per_value = per_value.withColumn("examples", F.slice(F.array_sort(F.array_distinct(F.array_compact("examples"))), 1, 4))
    kinds = leaves.withColumn("kind", F.when(full, F.col("kind")).otherwise("empty")).groupBy(group, "path", "kind").agg(F.count("*").alias("k"))
    kinds = kinds.groupBy(group, "path").agg(F.sum("k").alias("n_leaves"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "k")))).alias("types"))
    total = records.groupBy(group).agg(F.count("*").alias("n_records"))
    out = kinds.join(per_value, [group, "path"], "left").join(total, group)
    return out.withColumns({"nonempty": F.coalesce("nonempty", F.lit(0)), "n_distinct": F.coalesce("n_distinct", F.lit(0))}).withColumn("fill", F.round(F.col("nonempty") / F.col("n_records"), 3))


def exact_values(records: DataFrame, paths: list[str], group: str = "source_group", text: str = "raw_json") -> DataFrame:
    """(grp, field, value): all distinct values of the named fields over whole groups, blanks trimmed and dropped.

    A field inside a list is read from the list's first element, as joins are proved on one value per record.
    """
    read, found = read_once(records.select(F.col(group).alias("grp"), F.col(text).alias("_rec")), "_rec", paths)
    cells = F.explode(F.array(*[F.struct(F.lit(p).alias("field"), F.trim(found[p]).alias("value")) for p in paths]))
    rows = read.select("grp", cells.alias("x")).select("grp", "x.field", "x.value")
    return rows.where("value IS NOT NULL AND value <> ''").distinct()


def loose_types(leaves: DataFrame, group: str = "source_group") -> DataFrame:
    """(group, path, kind, n) with the loose labels of a first look: empty, bool, int, float, int_str, str."""
    value = F.col("value")
    label = (
        F.when(value.isNull() | (value == ""), "empty").when(F.col("kind").isin("true", "false"), "bool").when(F.col("kind") == "integer", "int")
        .when(F.col("kind") == "real", "float").when(value.rlike(r"^-?\d+$"), "int_str").otherwise("str")
    )
    return leaves.select(group, "path", label.alias("kind")).groupBy(group, "path", "kind").agg(F.count("*").alias("n"))


def name_beside(stats: DataFrame, group: str = "source_group") -> DataFrame:
    """(group, id_path, name_path): for each identifier candidate the fullest name field under the same parent."""
    parent = F.regexp_replace("path", r"\.?[^.]*$", "")
    ids = stats.where(is_id_candidate()).select(group, parent.alias("parent"), F.col("path").alias("id_path"))
    names = stats.where(is_name_candidate()).select(group, parent.alias("parent"), F.col("path").alias("name_path"), "fill")
    return ids.join(names, [group, "parent"]).groupBy(group, "id_path").agg(F.max_by("name_path", F.struct("fill", "name_path")).alias("name_path"))


def is_id_candidate() -> Column:
    """Over ``field_stats``: an identifier by name with some variety, or nearly unique short values; 25 at least."""
    uniq = F.try_divide("n_distinct", "nonempty")
    named = F.col("path").rlike(ID_HINT) & (uniq > 0.001)
    return ~F.col("path").rlike(JUNK_HINT) & (F.col("nonempty") >= 25) & (named | ((uniq > 0.95) & (F.col("avg_len") <= 40)))


def is_name_candidate() -> Column:
    return F.col("path").rlike(NAME_HINT) & ~F.col("path").rlike(JUNK_HINT) & (F.col("fill") > 0.3)


def containment(values: DataFrame, least_distinct: int = 25, least: float = 0.5) -> DataFrame:
    """(group_a, field_a, group_b, field_b, n_a, n_common, containment) over distinct (grp, field, value) rows.

    One self-join by value over all fields at once, then a count per pair of fields; pairs within one group are left out.
    """
    distinct = values.where("value IS NOT NULL AND value <> ''").select("grp", "field", "value").distinct()
    size = distinct.groupBy("grp", "field").agg(F.count("*").alias("n_a")).where(F.col("n_a") >= least_distinct)
    kept = distinct.join(broadcast_if_small(size.select("grp", "field")), ["grp", "field"], "left_semi")
    a, b = kept.select(F.col("grp").alias("group_a"), F.col("field").alias("field_a"), "value"), kept.select(F.col("grp").alias("group_b"), F.col("field").alias("field_b"), "value")
    common = a.join(b, "value").where("group_a <> group_b").groupBy("group_a", "field_a", "group_b", "field_b").agg(F.count("*").alias("n_common"))
    out = common.join(size.withColumnsRenamed({"grp": "group_a", "field": "field_a"}), ["group_a", "field_a"])
    return out.withColumn("containment", F.col("n_common") / F.col("n_a")).where(F.col("containment") >= least)


def composite_delimiter(values: DataFrame, share: float = 0.6) -> DataFrame:
    """(grp, field, delimiter): fields of whose distinct values more than ``share`` split in exactly two parts."""
    distinct = values.where("value IS NOT NULL AND value <> ''").select("grp", "field", "value").distinct()
    halves = lambda d: F.split("value", f"\\Q{d}\\E")
    good = [F.avg(((F.size(halves(d)) == 2) & (F.get(halves(d), 0) != "") & (F.get(halves(d), 1) != "")).cast("int")).alias(f"d{i}") for i, d in enumerate(DELIMITERS)]
    found = F.coalesce(*[F.when(F.col(f"d{i}") > share, F.lit(d)) for i, d in enumerate(DELIMITERS)])
    return distinct.groupBy("grp", "field").agg(*good).withColumn("delimiter", found).where("delimiter IS NOT NULL").select("grp", "field", "delimiter")


def composite_containment(values: DataFrame, composites: DataFrame, least_distinct: int = 25, least: float = 0.5) -> DataFrame:
    """Containment of the left and right halves of composite fields in other fields, with how far it can be relied on."""
    halves = values.join(composites, ["grp", "field"]).withColumn("h", F.split("value", F.concat(F.lit("\\Q"), "delimiter", F.lit("\\E"))))
    two = halves.where(F.size("h") == 2)
    left = two.select("grp", F.concat("field", F.lit("#left")).alias("field"), F.get("h", F.lit(0)).alias("value"))
    right = two.select("grp", F.concat("field", F.lit("#right")).alias("field"), F.get("h", F.lit(1)).alias("value"))
    out = containment(values.select("grp", "field", "value").unionByName(left).unionByName(right), least_distinct, least).where("field_a LIKE '%#%'")
    return out.withColumn("reliability", F.when(F.col("containment") >= 0.9, "HIGH").otherwise(F.concat(F.lit("UNRELIABLE: "), F.round(F.lit(100) * (1 - F.col("containment")), 0).cast("int").cast("string"), F.lit("% of halves match nothing"))))


def name_joins(names: DataFrame, least_distinct: int = 10, least: float = 0.3) -> DataFrame:
    """(group_a, field_a, group_b, field_b, n_a, n_common, containment): for each name field the field of another group that
    holds most of its names in normal form, where identifiers join nothing."""
    keyed = names.select("grp", "field", norm_aggressive(F.col("value")).alias("value"))
    found = containment(keyed, least_distinct, least)
    best = found.groupBy("group_a", "field_a").agg(F.min_by(F.struct("group_b", "field_b", "n_a", "n_common", "containment"), F.struct(-F.col("containment"), F.col("group_b"), F.col("field_b"))).alias("b"))
    return best.select("group_a", "field_a", "b.*")


def report(stats: list[dict], joins: list[dict], most: int = 15) -> str:
    """The profile as Markdown: the fullest fields of each group, its identifiers and names, and the joins from the surest
    down."""
    lines = ["# Profile", ""]
    for g in sorted({s["source_group"] for s in stats}):
        own = sorted((s for s in stats if s["source_group"] == g), key=lambda s: (-(s["fill"] or 0), s["path"]))
        marked = lambda kind: ", ".join(s["path"] for s in own if s.get(kind)) or "none"  # noqa: B023, E731
        lines += [f"## {g}", "", f"Identifiers: {marked('id_candidate')}. Names: {marked('name_candidate')}.", "", "| field | fill | distinct | examples |", "|-|-|-|-|"]
        shown = lambda s: "; ".join(s.get("examples") or [s.get("example") or ""]).replace("|", "/")
        lines += [f"| {s['path']} | {s['fill']} | {s['n_distinct']} | {shown(s)} |" for s in own[:most]] + [""]
    lines += ["## Joins", ""] + [f"- {j['group_a']}.{j['field_a']} in {j['group_b']}.{j['field_b']}: {j['containment']:.3f}" + (f" ({j['reliability']})" if j.get("reliability") else "") for j in sorted(joins, key=lambda j: (-j["containment"], j["field_a"]))]
    return "\n".join(lines) + "\n"


def write_profile(stats: DataFrame, joins: DataFrame, folder: str | Path) -> dict:
    """``profile.json`` and ``PROFILE_REPORT.md``: one entry per field and join, so as large as the schemas."""
    rows = [r.asDict(recursive=True) for r in stats.withColumns({"id_candidate": is_id_candidate(), "name_candidate": is_name_candidate()}).orderBy("source_group", "path").collect()]
    pairs = [r.asDict() for r in joins.collect()]
    groups: dict[str, dict] = {}
    for r in rows:
        g = groups.setdefault(r["source_group"], {"n_records": r["n_records"], "fields": {}, "id_candidates": [], "name_candidates": []})
        g["fields"][r["path"]] = {k: r[k] for k in ("types", "nonempty", "n_distinct", "fill", "avg_len", "examples")}
        for kind in ("id", "name"):
            if r[f"{kind}_candidate"]:
                g[f"{kind}_candidates"].append(r["path"])
    out = {"groups": groups, "joins": sorted(pairs, key=lambda j: (-j["containment"], j["group_a"], j["field_a"], j["group_b"], j["field_b"]))}
    Path(folder).mkdir(parents=True, exist_ok=True)
    (Path(folder) / "profile.json").write_text(json.dumps(out, ensure_ascii=False, indent=1, sort_keys=True), encoding="utf-8")
    (Path(folder) / "PROFILE_REPORT.md").write_text(report(rows, pairs), encoding="utf-8")
    return out
