"""Dossiers: the leads that matter most, their sources and entities, as notes, CSV, HTML and a portable bundle."""

from __future__ import annotations

import csv
import html
import json
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import group_slug, lead_label, safe_id, slug
from ledgerloom.operators.skew import broadcast_if_small
from ledgerloom.operators.substrings import names_held
from ledgerloom.session import cut

_EVIDENCE = "array<struct<table:string,locators:array<struct<source_group:string,native_id:string>>,locator:struct<source_group:string,native_id:string>,source_group:string,native_id:string,values:map<string,string>,value:string>>"


def top_leads(leads: DataFrame, n: int = 50) -> DataFrame:
    """The first leads by rank, then score, then id; nulls and what is not a number last."""
    value = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    return leads.orderBy(F.desc_nulls_last(value("rank_score")), F.desc_nulls_last(value("score")), "lead_id").limit(n)


def evidence_rows(leads: DataFrame) -> DataFrame:
    """(lead_id, position, source_group, native_id, value): one row per locator, whichever way the item is written.

    Items may hold a list of locators, one locator, or group and id themselves.
    """
    items = leads.select("lead_id", F.posexplode(F.from_json("evidence", _EVIDENCE)).alias("position", "e"))
    one = F.coalesce("e.locator", F.struct(F.col("e.source_group"), F.col("e.native_id")))
    listed = F.when(F.size("e.locators") > 0, F.col("e.locators")).otherwise(F.array(one))
    value = F.coalesce(F.col("e.value"), F.get(F.map_values("e.values"), F.lit(0)))
    rows = items.select("lead_id", "position", F.explode(listed).alias("l"), value.alias("value"))
    return rows.select("lead_id", "position", "l.source_group", "l.native_id", "value").where("native_id IS NOT NULL")


def evidence_texts(leads: DataFrame) -> DataFrame:
    """(lead_id, text): every value that evidence quotes, whatever it is called there."""
    items = leads.select("lead_id", F.explode(F.from_json("evidence", _EVIDENCE)).alias("e"))
    quoted = F.array_append(F.coalesce(F.map_values("e.values"), F.array().cast("array<string>")), F.col("e.value"))
    return items.select("lead_id", F.explode(quoted).alias("text")).where("text IS NOT NULL")


def lead_sources(leads: DataFrame, records: DataFrame) -> DataFrame:
    """Distinct records the leads point at, with their text where it is known.

    The few locators (checked) are broadcast to the records and only what they find is joined back, so the records are
    never shuffled; a group that is null is joined by id alone.
    """
    wanted = evidence_rows(leads).select("source_group", "native_id").distinct()
    found = bundle_records(leads, records.select("source_group", "native_id", "content_hash", "source_file", "raw_json"))
    named = found.join(broadcast_if_small(wanted.where("source_group IS NOT NULL")), ["source_group", "native_id"])
    loose = found.withColumnRenamed("source_group", "_g").join(broadcast_if_small(wanted.where("source_group IS NULL")), "native_id").select(*named.columns)
    known = named.unionByName(loose)
    lost = wanted.join(known.select(F.col("source_group").alias("_g"), F.col("native_id").alias("_n")).distinct(), F.col("source_group").eqNullSafe(F.col("_g")) & (F.col("native_id") == F.col("_n")), "left_anti")
    return known.unionByName(lost, allowMissingColumns=True)


def bundle_records(leads: DataFrame, records: DataFrame) -> DataFrame:
    """The raw records that evidence names: by group and id, or by id alone where the evidence has no group.

    Each record is given once per row it has; one that both forms name is still given once.
    """
    wanted = evidence_rows(leads).select("source_group", "native_id").distinct()
    exact = broadcast_if_small(wanted.where("source_group IS NOT NULL").select(F.col("source_group").alias("_g"), F.col("native_id").alias("_n")))
    loose = broadcast_if_small(wanted.where("source_group IS NULL").select(F.col("native_id").alias("_m")))
    by_both = (F.col("source_group") == F.col("_g")) & (F.col("native_id") == F.col("_n"))
    by_id = F.col("native_id") == F.col("_m")
    return records.join(exact, by_both, "left_semi").unionByName(records.join(exact, by_both, "left_anti").join(loose, by_id, "left_semi"))


def entity_of_name(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, entity_id): by canonical name without case, else by alias; the smallest id on ties."""
    wanted = names.select(F.col("name"), F.lower("name").alias("_n")).distinct()
    own = entities.groupBy(F.lower("canonical_name").alias("_n")).agg(F.min("entity_id").alias("a"))
    other = aliases.groupBy(F.lower("raw_name").alias("_n")).agg(F.min("entity_id").alias("b"))
    return wanted.join(own, "_n", "left").join(other, "_n", "left").select("name", F.coalesce("a", "b").alias("entity_id")).where("entity_id IS NOT NULL")


def names_in(texts: DataFrame, entities: DataFrame, least_length: int = 5) -> DataFrame:
    """(entity_id, lead_id): entities whose canonical name stands anywhere in a lead's texts (lead_id, text), letter case
    aside; names shorter than ``least_length`` are not searched.

    The texts are walked where they are, and only what stands in them and is as good as certainly a name is joined to the
    names. Pairs are never shuffled: where an entity has several rows, entities of the same names are one party until each
    party and lead is there once, and only then is the party joined to its entities.
    """
    own = entities.where(F.length("canonical_name") >= least_length).select("entity_id", F.lower("canonical_name").alias("name"))
    hits = names_held(texts.select(F.col("lead_id").alias("key"), F.lower("text").alias("text")), own.select("name"))
    once = own.groupBy("entity_id").count().where("count > 1").isEmpty()
    own = own.withColumn("name", F.encode("name", "UTF-8"))
    if once:
        return hits.distinct().join(own, "name").select("entity_id", F.col("key").alias("lead_id"))
    # a party is known by 128 bits over its names, whatever their order
    of_entity = Window.partitionBy("entity_id")
    own = own.repartition("entity_id").distinct().select("*", F.bit_xor(F.xxhash64("name")).over(of_entity).alias("_a"), F.bit_xor(F.xxhash64(F.lit(1), "name")).over(of_entity).alias("_b"))
    found = hits.join(own.select("name", "_a", "_b").distinct(), "name").select("key", "_a", "_b").distinct()
    parties = own.select("entity_id", "_a", "_b").distinct()
    return found.join(parties, ["_a", "_b"]).select("entity_id", F.col("key").alias("lead_id"))


def backlinks(leads: DataFrame, entities: DataFrame, least_length: int = 5) -> DataFrame:
    """(entity_id, lead_id): entities whose name stands in a lead's claim."""
    return names_in(leads.select("lead_id", F.col("claim").alias("text")), entities, least_length)


def entity_scan(leads: DataFrame, entities: DataFrame, least_length: int = 5) -> DataFrame:
    """(entity_id, lead_id): entities whose name stands in a lead's claim or in a value its evidence quotes."""
    texts = leads.select("lead_id", F.col("claim").alias("text")).unionByName(evidence_texts(leads))
    return names_in(texts, entities, least_length)


# --- sinks: bounded by the number of leads exported, so they are written on the driver -----------------------------


def write_csv(leads: DataFrame, path: str | Path, n: int = 50) -> None:
    """Nine columns with a byte-order mark, as spreadsheets expect."""
    cols = ["lead_id", "status", "what_it_is", "claim", "detector", "legal_flag", "named_parties_tier", "innocent_explanations", "evidence_locators"]
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(cols)
        for r in _rows(leads, n):
            out.writerow([r["lead_id"], r["status"], r["signal_type"], r["claim"], r["detector_id"], r["legal_flag"], r["defamation_tier"], r["innocent_explanations"], "; ".join(r["locators"])])


def _rows(leads: DataFrame, n: int) -> list[dict]:
    """The leads to export, with their note names and locators: at most ``n`` rows."""
    top = top_leads(leads, n)
    top = top.withColumn("note", F.concat(F.lit("LEAD-"), F.col("lead_id").cast("string"), F.lit(" "), slug(lead_label(F.col("claim")), 56)))
    where = evidence_rows(top).groupBy("lead_id").agg(F.array_sort(F.collect_set(F.concat_ws("::", "source_group", "native_id"))).alias("locators"))
    rows = [r.asDict() for r in top.join(where, "lead_id", "left").collect()]
    key = lambda r: (r["rank_score"] is None, -(r["rank_score"] or 0), r["score"] is None, -(r["score"] or 0), r["lead_id"])
    return [r | {"locators": r["locators"] or []} for r in sorted(rows, key=key)]


def write_html(leads: DataFrame, path: str | Path, n: int = 50, excerpt: int = 600) -> None:
    body = [f"<tr><td>{r['lead_id']}</td><td>{html.escape(r['detector_id'] or '')}</td><td>{html.escape((r['claim'] or '')[:excerpt])}</td><td>{html.escape('; '.join(r['locators']))}</td></tr>" for r in _rows(leads, n)]
    Path(path).write_text("<!doctype html><meta charset='utf-8'><title>Leads</title><table><tr><th>lead<th>detector<th>claim<th>evidence</tr>\n" + "\n".join(body) + "\n</table>\n", encoding="utf-8")


# What each status of a lead means.
_STATUS = {
    "new": "nobody has checked it yet", "verified": "it was checked and holds", "promoted": "attempts to refute it failed", "published": "it passed the fact check", "killed": "it was checked and rejected",
}


def _front(**fields) -> list[str]:
    return ["---", *[f"{k}: {json.dumps(v, ensure_ascii=False) if isinstance(v, str) else 'null' if v is None else v}" for k, v in fields.items()], "---", ""]


def _lead_note(r: dict, sources: dict[str, str], quoted: list[tuple]) -> str:
    try:
        innocent = json.loads(r["innocent_explanations"] or "[]")
    except ValueError:
        innocent = [r["innocent_explanations"]]
    tier = r["defamation_tier"] or "none"
    body = _front(status=r["status"], signal_type=r["signal_type"], detector=r["detector_id"], run=r.get("created_run"), score=r["score"], rank_score=r["rank_score"], legal_flag=r["legal_flag"], defamation_tier=tier)
    body += ["## Claim", "", r["claim"] or "(no text)", "", f"Status {r['status']}: {_STATUS.get(r['status'], 'see the table of leads')}. Scores order leads; they prove nothing.", "", "## Evidence", ""]
    body += [f"- [[{sources.get(x, x)}]]" + (f": {v}" if v is not None else "") for x, v in quoted] or ["- none recorded"]
    body += ["", "## Innocent explanations", "", *([f"- {x}" for x in innocent] or ["- none recorded"]), ""]
    body += ["## How to check this", "", "- [ ] Open every source above and compare names, amounts and dates with the claim.", "- [ ] Rule each innocent explanation in or out.", f"- [ ] Run the detector `{r['detector_id']}` again and see that the lead comes back.", ""]
    if tier not in ("none", "null", ""):
        body += ["## Right of reply", "", f"Tier {tier}: the lead names or implies someone. Ask them before publication.", "", "- Asked:", "- Answer:", ""]
    return "\n".join(body)


def write_vault(leads: DataFrame, records: DataFrame, folder: str | Path, n: int = 50, lines: int = 150, entities: DataFrame | None = None, aliases: DataFrame | None = None) -> None:
    """Markdown notes of leads, their sources and the entities they name, linked both ways; same input, same bytes.

    Everything on the driver is bounded by the exported leads: their evidence, the first ``lines`` lines of each source,
    and the entities they name.
    """
    folder = Path(folder)
    for part in ("leads", "sources", "entities"):
        (folder / part).mkdir(parents=True, exist_ok=True)
    top = cut(top_leads(leads, n))
    rows = _rows(top, n)
    excerpt = F.array_join(F.slice(F.split(F.col("raw_json"), "\n"), 1, lines), "\n")
    note = F.concat(F.lit("SRC "), group_slug(F.col("source_group")), F.lit(" "), safe_id(F.col("native_id")))
    named = lead_sources(top, records).select("source_group", "native_id", "content_hash", "source_file", excerpt.alias("text"), note.alias("note")).orderBy("source_group", "native_id", "content_hash").collect()
    locator = lambda r: f"{r['source_group']}::{r['native_id']}" if r["source_group"] is not None else r["native_id"]
    sources: dict[str, str] = {}
    for s in named:
        sources.setdefault(locator(s), s["note"])
    quoted: dict[int, list[tuple]] = {}
    back: dict[str, set] = {}
    title = {r["lead_id"]: r["note"] for r in rows}
    for e in evidence_rows(top).distinct().orderBy("lead_id", "position", "source_group", "native_id", "value").collect():
        quoted.setdefault(e["lead_id"], []).append((locator(e), e["value"]))
        back.setdefault(locator(e), set()).add(title[e["lead_id"]])
    for r in rows:
        (folder / "leads" / f"{r['note']}.md").write_text(_lead_note(r, sources, quoted.get(r["lead_id"], [])), encoding="utf-8")
    for where, name in sources.items():
        held = [s for s in named if locator(s) == where]
        body = _front(locator=where, source_file=held[0]["source_file"], content_hash=held[0]["content_hash"]) + [f"# {held[0]['native_id']}", ""]
        for s in held:
            body += ["```json", s["text"] if s["text"] is not None else "not in the store", "```", ""]
        body += ["## Leads", "", *[f"- [[{x}]]" for x in sorted(back.get(where, ()))], "", f"Whole record: `show_locator(records, {where!r})`", ""]
        (folder / "sources" / f"{name}.md").write_text("\n".join(body), encoding="utf-8")
    if entities is not None:
        cols = [c for c in ("entity_type", "n_mentions") if c in entities.columns]
        scan = cut(entity_scan(top, entities))
        linked = scan.groupBy("entity_id").agg(F.array_sort(F.collect_list("lead_id")).alias("leads"))  # at most ``n`` leads each
        own = entities.join(broadcast_if_small(linked), "entity_id").select("entity_id", "canonical_name", *cols, "leads", F.concat(F.lit("ENT "), slug(F.col("canonical_name")), F.lit(" "), F.col("entity_id").cast("string")).alias("note"))
        spelt: dict[int, list[str]] = {}
        if aliases is not None:
            for a in aliases.join(broadcast_if_small(linked.select("entity_id")), "entity_id").select("entity_id", "raw_name").distinct().orderBy("entity_id", "raw_name").collect():
                spelt.setdefault(a["entity_id"], []).append(a["raw_name"])
        for e in own.orderBy("entity_id").collect():
            body = _front(**{c: e[c] for c in cols}) + [f"# {e['canonical_name']}", "", "## Aliases", "", *([f"- {x}" for x in spelt.get(e["entity_id"], [])] or ["- none recorded"]), "", "## Leads", "", *[f"- [[{title[x]}]]" for x in e["leads"]], ""]
            (folder / "entities" / f"{e['note']}.md").write_text("\n".join(body), encoding="utf-8")
    body = ["# Leads", "", "Every note says what records show; none is a finding. Check the sources of a lead before its claim is used.", "", *[f"- [[{r['note']}]] {r['claim'] or ''}" for r in rows], ""]
    (folder / "README.md").write_text("\n".join(body), encoding="utf-8")


def write_bundle(leads: DataFrame, entities: DataFrame, aliases: DataFrame, records: DataFrame, folder: str) -> None:
    """A self-contained directory: all leads, entities and aliases, the raw records evidence names, and a manifest."""
    kept = bundle_records(leads, records)
    for name, df in (("leads", leads), ("entities", entities), ("aliases", aliases), ("raw_records", kept)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = leads.sparkSession
    counts = [(name, str(spark.read.parquet(f"{folder}/{name}").count())) for name in ("leads", "entities", "aliases", "raw_records")]
    spark.createDataFrame(counts, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/bundle_manifest")
