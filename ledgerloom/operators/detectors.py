"""Detectors: declarative templates that compare typed tables and emit leads with the locators of their evidence."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.skew import broadcast_if_small

PROVENANCE = ("source_group", "native_id")


class PreflightError(ValueError):
    """A detector that cannot run: a missing table or column, or malformed parameters."""


@dataclass
class Detector:
    """One entry of a pack's detector list."""

    id: str
    template: str
    params: dict
    innocent_explanations: list[str] = field(default_factory=list)
    legal_flag: bool = False
    defamation_tier: str = "named_org"
    signal_type: str = ""


def guard(left: Column, right: Column) -> Column:
    """Holds if either side is null or both agree apart from case and surrounding blanks."""
    return left.isNull() | right.isNull() | (F.lower(F.trim(left)) == F.lower(F.trim(right)))


def _keys(left: DataFrame, right: DataFrame, on: list) -> Column:
    cond = F.lit(True)
    for a, b in on:
        cond = cond & (left[a] == right[b])
    return cond


def contradiction(left: DataFrame, right: DataFrame, on: list, left_value: str, right_value: str, tolerance: float = 0.0, guards: list | None = None) -> DataFrame:
    """Pairs with equal keys whose values differ by more than ``tolerance``; ``diff`` is the distance.

    Null keys and null values never contradict.  Columns of both sides come with the prefixes l_ and r_.
    """
    l, r = _prefixed(left, "l_"), _prefixed(right, "r_")
    cond = _keys(l, r, [("l_" + a, "r_" + b) for a, b in on])
    for a, b in guards or []:
        cond = cond & guard(l["l_" + a], r["r_" + b])
    diff = F.abs(l["l_" + left_value] - r["r_" + right_value])
    return l.join(r, cond & (diff > F.lit(tolerance))).withColumn("diff", diff)


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(prefix + c) for c in df.columns])


def contradiction_report(left: DataFrame, right: DataFrame, on: list, left_value: str, right_value: str, guards: list | None = None) -> DataFrame:
    """One row: pairs joined, pairs with exactly one null value, pairs a guard excludes; one pass over the join."""
    l, r = _prefixed(left, "l_"), _prefixed(right, "r_")
    kept = F.lit(True)
    for a, b in guards or []:
        kept = kept & guard(l["l_" + a], r["r_" + b])
    joined = l.join(r, _keys(l, r, [("l_" + a, "r_" + b) for a, b in on]))
    lv, rv = F.col("l_" + left_value), F.col("r_" + right_value)
    return joined.agg(F.count("*").alias("pairs"), F.count_if(lv.isNull() != rv.isNull()).alias("one_side_null"), F.count_if(~kept).alias("guard_excluded"))


def gap(left: DataFrame, right: DataFrame, on: list, guards: list | None = None, score: str | None = None) -> DataFrame:
    """Left rows without counterpart, with a ``score``; written as an anti join, so null keys count as gaps."""
    r = _prefixed(right.select(*dict.fromkeys([b for _, b in on] + [b for _, b in guards or []])), "r_")
    cond = _keys(left, r, [(a, "r_" + b) for a, b in on])
    for a, b in guards or []:
        cond = cond & guard(left[a], r["r_" + b])
    value = F.coalesce(F.nullif(F.col(score), F.lit(0).cast(left.schema[score].dataType)), F.lit(1.0)) if score else F.lit(1.0)
    return left.join(r, cond, "left_anti").withColumn("gap_score", value.cast("double"))


def exact_sum(value: Column) -> Column:
    """A sum that does not depend on the order of rows: in decimals of two places, then double."""
    return F.sum(value.cast("decimal(18,2)")).cast("double")


def outlier_top(df: DataFrame, value: str, groups: list[str], n: int = 25) -> DataFrame:
    """The ``n`` groups with the largest sums; null values are dropped, a null group is a group, ties go by the group.

    Where rows carry provenance, ``sample`` is the smallest locator of the group, taken in the same aggregation.
    """
    df = df.where(F.col(value).isNotNull())
    keys = groups or ["grp"]
    df = df if groups else df.withColumn("grp", F.lit("all"))
    sample = [F.min(F.struct(*PROVENANCE)).alias("sample")] if set(PROVENANCE) <= set(df.columns) else []
    return df.groupBy(*keys).agg(exact_sum(F.col(value)).alias("total"), F.count("*").alias("n_rows"), *sample).orderBy(F.desc("total"), *keys).limit(n)


def outlier_sigma(df: DataFrame, value: str, groups: list[str], sigmas: float = 3.0) -> DataFrame:
    """Rows farther than ``sigmas`` standard deviations from their group's mean, with how many; a null group is a group.

    The statistics are aggregated first and joined back: no group is sorted or gathered, however large.
    """
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)] or [F.lit("all").alias("_g0")]
    stats = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_deviation"))
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = df.join(broadcast_if_small(stats), same).drop(*[f"_g{i}" for i in range(len(keys))])
    far = F.abs(F.col(value) - F.col("_mean"))
    return out.where((F.col("_deviation") > 0) & (far > F.col("_deviation") * F.lit(sigmas))).withColumn("deviations", far / F.col("_deviation")).drop("_mean", "_deviation")


def grain(df: DataFrame, groups: list[str]) -> DataFrame:
    """Rows, distinct groups and rows per group: shows a sum at the wrong grain before it is believed."""
    return df.agg(F.count("*").alias("rows_in"), F.count_distinct(F.struct(*groups)).alias("n_groups")).withColumn("rows_per_group", F.col("rows_in") / F.col("n_groups"))


def intermediary(df: DataFrame, name: str, patterns: list[str]) -> DataFrame:
    """Names that hide a principal: (name, n_records, intermediary, principal, sample locator), first pattern that fits.

    Patterns have the named groups ``principal`` and, if they like, ``intermediary``; they are searched without case.
    """
    per = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n_records"), *([F.min(F.struct(*PROVENANCE)).alias("sample")] if set(PROVENANCE) <= set(df.columns) else []))
    principal, middle = F.lit(None).cast("string"), F.lit(None).cast("string")
    for p in reversed(patterns):
        java, groups = java_pattern(p)
        hit = F.nullif(F.trim(F.regexp_extract("name", java, groups["principal"])), F.lit(""))
        mid = F.regexp_extract("name", java, groups["intermediary"]) if "intermediary" in groups else F.lit("")
        principal, middle = F.when(hit.isNotNull(), hit).otherwise(principal), F.when(hit.isNotNull(), mid).otherwise(middle)
    return per.withColumns({"intermediary": middle, "principal": principal}).where("principal IS NOT NULL")


def java_pattern(pattern: str) -> tuple[str, dict[str, int]]:
    """A pattern with Python's named groups for the JVM, without regard to case, and its group numbers."""
    compiled = re.compile(pattern)
    return "(?i)" + re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern), dict(compiled.groupindex)


def _days(df: DataFrame, column: str) -> Column:
    """A date, timestamp or ISO text as days since 1970 with their fraction; null where it cannot be read."""
    kind = dict(df.dtypes)[column]
    at = F.try_to_timestamp(F.col(column)) if kind == "string" else F.col(column).cast("timestamp")
    return F.unix_micros(at) / F.lit(86_400e6)


def overlap(left: DataFrame, right: DataFrame, on: list, left_date: str, right_date: str, days: int = 90, amount: str | None = None, least: float | None = None) -> DataFrame:
    """Pairs of one entity whose dates lie at most ``days`` apart (inclusive); ``days_apart`` is the distance in days,
    with its fraction where dates have a time of day.

    The join key also holds the date's window and its neighbours, so an entity with very many rows is spread over its
    timeline instead of meeting in one task.  Null dates meet nothing; with ``amount`` a null amount does not either.
    """
    l = left.withColumn("_at", _days(left, left_date)).where("_at IS NOT NULL")
    r = right.withColumn("_at", _days(right, right_date)).where("_at IS NOT NULL")
    if amount:
        l = l.where(F.col(amount).isNotNull() & (F.col(amount) >= (0 if least is None else least)))
    l, r = _prefixed(l, "l_"), _prefixed(r, "r_")
    width = float(max(days, 1))
    l = l.withColumn("_w", F.floor(F.col("l__at") / width))
    at = F.floor(F.col("r__at") / width)
    r = r.withColumn("_w2", F.explode(F.array(at - 1, at, at + 1)))
    cond = _keys(l, r, [("l_" + a, "r_" + b) for a, b in on]) & (l["_w"] == r["_w2"])
    out = l.join(r, cond).withColumn("days_apart", F.abs(F.col("l__at") - F.col("r__at"))).where(F.col("days_apart") <= days)
    return out.drop("_w", "_w2", "l__at", "r__at")


# --- running a pack -----------------------------------------------------------------------------------------------

# The parameters of each template, the signal it stands for, and the default of its legal flag.
_SIDES = {"left", "right", "join_on", "guard_cols", "left_where", "label_cols"}
PARAMETERS = {
    "contradiction": _SIDES | {"right_where", "tolerance"},
    "gap": _SIDES | {"expectation", "score_col"},
    "outlier": {"table", "value_col", "group_cols", "method", "n", "threshold"},
    "intermediary": {"table", "name_col", "patterns"},
    "overlap": {"left", "right", "window_days", "min_amount"},
}
SIDE_PARAMETERS = {"contradiction": {"table", "value_col"}, "gap": {"table"}, "overlap": {"table", "entity_col", "date_col", "amount_col"}}
SIGNALS = {"contradiction": "contradiction", "gap": "gap", "outlier": "outlier", "intermediary": "hidden_principal", "overlap": "timing_overlap"}


def _known(d: Detector) -> None:
    """Refuse parameters no template reads: a misspelt guard would otherwise be left out in silence."""
    if d.template not in PARAMETERS:
        raise PreflightError(f"{d.id}: unknown template {d.template!r}")
    given = {"": d.params} | {s: d.params[s] for s in ("left", "right") if s in d.params and s in PARAMETERS[d.template]}
    for side, held in given.items():
        allowed = SIDE_PARAMETERS[d.template] if side else PARAMETERS[d.template]
        strange = sorted(k for k in held if k not in allowed and not k.startswith("_"))
        if strange:
            raise PreflightError(f"{d.id}: unknown parameters {', '.join(side + '.' * bool(side) + k for k in strange)}")


def requirements(d: Detector) -> dict[str, set[str]]:
    """Tables and columns a detector needs; malformed or unknown parameters raise."""
    p, need = d.params, {}

    def ask(table: str, *cols: str | None) -> None:
        need.setdefault(table, set()).update(c for c in cols if c)

    try:
        _known(d)
        if d.template in ("contradiction", "gap"):
            for side, at in (("left", 0), ("right", 1)):
                ask(p[side]["table"], *[pair[at] for pair in p["join_on"]], *[g[at] for g in p.get("guard_cols", [])], *PROVENANCE)
                if d.template == "contradiction":
                    ask(p[side]["table"], p[side]["value_col"])
            ask(p["left"]["table"], *p.get("label_cols", []), p.get("score_col"))
        elif d.template == "overlap":
            for side in ("left", "right"):
                ask(p[side]["table"], p[side]["entity_col"], p[side]["date_col"], *PROVENANCE)
            ask(p["left"]["table"], p["left"].get("amount_col"))
        elif d.template == "outlier":
            if p.get("method", "top_n") not in ("top_n", "sigma"):
                raise PreflightError(f"{d.id}: unknown method {p.get('method')!r}")
            ask(p["table"], p["value_col"], *p.get("group_cols", []), *PROVENANCE)
        else:
            ask(p["table"], p["name_col"], *PROVENANCE)
            if not p["patterns"] or not all("principal" in re.compile(x).groupindex for x in p["patterns"]):
                raise PreflightError(f"{d.id}: every pattern needs a group named principal")
    except (KeyError, TypeError, IndexError, re.error) as e:
        raise PreflightError(f"{d.id}: malformed params ({e!r})") from e
    return need


def _numeric(d: Detector) -> list[tuple[str, str]]:
    """(table, column) that must hold numbers."""
    p = d.params
    if d.template == "contradiction":
        return [(p[s]["table"], p[s]["value_col"]) for s in ("left", "right")]
    found = {"gap": ("left", p.get("score_col")), "overlap": ("left", p.get("left", {}).get("amount_col") if d.template == "overlap" else None)}
    if d.template in found:
        side, column = found[d.template]
        return [(p[side]["table"], column)] if column else []
    return [(p["table"], p["value_col"])] if d.template == "outlier" else []


def preflight(d: Detector, tables: dict[str, DataFrame]) -> list[str]:
    """What stands in a detector's way, nothing if it can run: tables, columns, types, parameters and where fragments."""
    try:
        need = requirements(d)
    except PreflightError as e:
        return [str(e)]
    out = []
    for t, cols in need.items():
        if t not in tables:
            out.append(f"{d.id}: no table {t}")
        else:
            out += [f"{d.id}: {t} has no column {c}" for c in sorted(cols - set(tables[t].columns))]
    for t, c in [] if out else _numeric(d):
        kind = dict(tables[t].dtypes)[c]
        if kind not in ("double", "float", "int", "bigint", "smallint", "tinyint") and not kind.startswith("decimal"):
            out.append(f"{d.id}: {c} is {kind}, not a number")
    if not out:
        try:
            run_detector(d, tables, "").schema  # noqa: B018 - analysed, not run: a fragment that names no column shows here
        except Exception as e:  # noqa: BLE001
            out.append(f"{d.id}: {str(e).splitlines()[0]}")
    return out


def _fragment(sql: str | None) -> Column:
    """A pack's ``AND l.amount >= 5``: kept as it stands, but for names in double quotes, outside texts."""
    if not sql or not sql.strip():
        return F.lit(True)
    parts = re.split(r"('(?:[^']|'')*')", sql)
    own = "".join(x if i % 2 else re.sub(r'"([^"]*)"', r"`\1`", x) for i, x in enumerate(parts))
    return F.expr("true " + own if re.match(r"\s*(AND|OR)\b", own, re.I) else own)


def _evidence(*parts: tuple[str, Column, Column, Column]) -> Column:
    """JSON array of {table, locators: [{source_group, native_id}], values: {value}}."""
    return F.to_json(F.array(*[F.struct(F.lit(t).alias("table"), F.array(F.struct(g.alias("source_group"), i.alias("native_id"))).alias("locators"), F.struct(v.cast("string").alias("value")).alias("values")) for t, g, i, v in parts]))


def _said(*parts) -> Column:
    """A claim states what records show; nulls are named as such."""
    words = [F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("None")) for x in parts]
    return F.concat(F.lit("Records show "), *words, F.lit(". The records do not establish intent or causation."))


def _label(cols: list[str], side: str = "") -> Column:
    return F.concat_ws(" / ", *[F.coalesce(F.col(f"{side}`{c}`").cast("string"), F.lit("None")) for c in cols]) if cols else F.lit("")


def _pairs(p: dict, tables: dict[str, DataFrame]) -> tuple[DataFrame, Column]:
    """The two sides joined on their keys as ``l`` and ``r``, and whether the guards hold."""
    l, r = tables[p["left"]["table"]].alias("l"), tables[p["right"]["table"]].alias("r")
    on, kept = F.lit(True), F.lit(True)
    for a, b in p["join_on"]:
        on = on & (F.col(f"l.`{a}`") == F.col(f"r.`{b}`"))
    for a, b in p.get("guard_cols", []):
        kept = kept & guard(F.col(f"l.`{a}`"), F.col(f"r.`{b}`"))
    return l.join(r, on), kept


def _contradictions(p: dict, tables: dict[str, DataFrame]) -> DataFrame:
    joined, kept = _pairs(p, tables)
    lv, rv, tolerance = F.col(f"l.`{p['left']['value_col']}`"), F.col(f"r.`{p['right']['value_col']}`"), p.get("tolerance", 0)
    diff = F.abs(lv - rv)
    hits = joined.where(kept & (diff > F.lit(tolerance))).where(_fragment(p.get("left_where"))).where(_fragment(p.get("right_where")))
    claim = _said("two disclosures of the same engagement (", _label(p.get("label_cols", []), "l."), ") report different values: ", lv, " vs ", rv, " (difference ", F.round(diff, 2), f", tolerance {tolerance})")
    proof = _evidence((p["left"]["table"], F.col("l.source_group"), F.col("l.native_id"), lv), (p["right"]["table"], F.col("r.source_group"), F.col("r.native_id"), rv))
    return hits.select(claim.alias("claim"), diff.cast("double").alias("score"), proof.alias("evidence"))


def _gaps(p: dict, tables: dict[str, DataFrame]) -> DataFrame:
    left = tables[p["left"]["table"]].alias("l").where(_fragment(p.get("left_where")))
    right = tables[p["right"]["table"]].where("native_id IS NOT NULL")
    hits = gap(left.select("l.*"), right, p["join_on"], p.get("guard_cols"), p.get("score_col"))
    claim = _said(p.get("expectation", "an expected counterpart record"), " is missing for (", _label(p.get("label_cols", [])), ")")
    return hits.select(claim.alias("claim"), F.col("gap_score").alias("score"), _evidence((p["left"]["table"], F.col("source_group"), F.col("native_id"), F.lit("present"))).alias("evidence"))


def _overlaps(p: dict, tables: dict[str, DataFrame]) -> DataFrame:
    a, b, days, amount = p["left"], p["right"], p.get("window_days", 90), p["left"].get("amount_col")
    hits = overlap(tables[a["table"]], tables[b["table"]], [(a["entity_col"], b["entity_col"])], a["date_col"], b["date_col"], days, amount, p.get("min_amount", 0))
    ld, rd = F.col(f"`l_{a['date_col']}`"), F.col(f"`r_{b['date_col']}`")
    paid = [", amount ", F.col(f"`l_{amount}`")] if amount else []
    claim = _said("'", F.col(f"`l_{a['entity_col']}`"), f"' appears in {a['table']} (dated ", ld, *paid, f") and in {b['table']} (dated ", rd, f") within {days} days")
    score = F.coalesce(F.nullif(F.col(f"`l_{amount}`").cast("double"), F.lit(0.0)), F.lit(1.0)) if amount else F.lit(1.0)
    proof = _evidence((a["table"], F.col("l_source_group"), F.col("l_native_id"), ld), (b["table"], F.col("r_source_group"), F.col("r_native_id"), rd))
    return hits.select(claim.alias("claim"), score.alias("score"), proof.alias("evidence"))


def _outliers(p: dict, tables: dict[str, DataFrame]) -> DataFrame:
    t, value, groups = tables[p["table"]], p["value_col"], p.get("group_cols", [])
    if p.get("method", "top_n") == "top_n":
        top = outlier_top(t, value, groups, p.get("n", 25))
        claim = _said(f"aggregate {value} of ", F.round("total", 2), " across ", F.col("n_rows"), " records for (", _label(groups or ["grp"]), "), among the highest in the corpus")
        return top.select(claim.alias("claim"), F.col("total").alias("score"), _evidence((p["table"], F.col("sample.source_group"), F.col("sample.native_id"), F.col("total"))).alias("evidence"))
    hits = outlier_sigma(t, value, groups, p.get("threshold", 3.0))
    away = F.col("deviations")
    claim = _said(f"{value} of ", F.col(value), " for (", _label(groups), "), ", F.round(away, 2), " standard deviations from the mean of its group")
    return hits.select(claim.alias("claim"), away.alias("score"), _evidence((p["table"], F.col("source_group"), F.col("native_id"), F.col(value))).alias("evidence"))


def _intermediaries(p: dict, tables: dict[str, DataFrame]) -> DataFrame:
    hits = intermediary(tables[p["table"]], p["name_col"], p["patterns"])
    named = F.coalesce(F.nullif(F.trim("intermediary"), F.lit("")), F.col("name"))
    claim = _said("a disclosure names '", named, "' as filer/client while the underlying principal is '", F.col("principal"), "' (", F.col("n_records"), " filings)")
    return hits.select(claim.alias("claim"), F.col("n_records").cast("double").alias("score"), _evidence((p["table"], F.col("sample.source_group"), F.col("sample.native_id"), F.col("name"))).alias("evidence"))


_TEMPLATES = {"contradiction": _contradictions, "gap": _gaps, "overlap": _overlaps, "outlier": _outliers, "intermediary": _intermediaries}


def run_detector(d: Detector, tables: dict[str, DataFrame], run: str) -> DataFrame:
    """Leads of one detector, without ids: (detector_id, ..., created_run)."""
    rows = _TEMPLATES[d.template](d.params, tables)
    return rows.select(
        F.lit(d.id).alias("detector_id"), F.lit(d.template).alias("template"), F.lit(d.signal_type or SIGNALS[d.template]).alias("signal_type"), "claim", "score",
        F.lit(None).cast("double").alias("rank_score"), F.lit("new").alias("status"), F.lit(int(d.legal_flag)).alias("legal_flag"), F.lit(d.defamation_tier).alias("defamation_tier"),
        "evidence", F.lit(_json(d.params)).alias("params"), F.lit(_json(d.innocent_explanations)).alias("innocent_explanations"), F.lit(run).alias("created_run"),
    )


def detector_report(d: Detector, tables: dict[str, DataFrame]) -> DataFrame:
    """(detector_id, measure, value): what a detector leaves out or sums over, so that its leads can be judged.

    Contradictions: pairs with exactly one null value, and contradicting pairs a guard excludes; gaps: matches a guard
    excludes; outliers: rows, groups and rows per group.
    """
    p = d.params
    if d.template in ("contradiction", "gap"):
        joined, kept = _pairs(p, tables)
        joined = joined.where(_fragment(p.get("left_where"))).where(_fragment(p.get("right_where")))
        counts = [F.count_if(~kept).alias("guard_excluded")]
        if d.template == "contradiction":
            lv, rv = F.col(f"l.`{p['left']['value_col']}`"), F.col(f"r.`{p['right']['value_col']}`")
            apart = F.abs(lv - rv) > F.lit(p.get("tolerance", 0))
            counts = [F.count_if(kept & (lv.isNull() != rv.isNull())).alias("one_side_null"), F.count_if(apart & ~kept).alias("guard_excluded")]
        row = joined.agg(*counts)
    elif d.template == "outlier":
        row = grain(tables[p["table"]].where(F.col(p["value_col"]).isNotNull()), p.get("group_cols") or [p["value_col"]])
    else:
        row = run_detector(d, tables, "").agg(F.count("*").alias("leads"))
    pairs = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in row.columns])
    return row.select(F.explode(pairs).alias("x")).select(F.lit(d.id).alias("detector_id"), "x.measure", "x.value")


def _json(value) -> str:
    import json

    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def run_pack(spark: SparkSession, detectors: list[Detector], tables: dict[str, DataFrame], run: str, path: str) -> list[str]:
    """Run every detector that passes preflight; all are checked before any runs.  Returns why others were skipped.

    Each detector overwrites only its own partition of this run, after its plan has succeeded, so a rerun replaces and a
    failure leaves what was there.
    """
    why = {d.id: preflight(d, tables) for d in detectors}
    skipped = [x for reasons in why.values() for x in reasons]
    for d in detectors:
        if not why[d.id]:
            try:
                leads = run_detector(d, tables, run).withColumn("lead_key", F.sha2(F.concat_ws("|", "detector_id", "claim", "evidence"), 256))
                leads.write.option("partitionOverwriteMode", "dynamic").partitionBy("created_run", "detector_id").mode("overwrite").parquet(path)
            except Exception as e:  # noqa: BLE001 - one detector must not stop the others
                skipped.append(f"{d.id}: {e}")
    return skipped


# The stages of a lead in their order; it can be killed at any before the last.
STAGES = ["new", "verified", "promoted", "published"]


def apply_status_events(leads: DataFrame, events: DataFrame, key: str = "lead_id") -> DataFrame:
    """Leads with the status an event log (key, status, at) takes them to; other transitions than those of the lifecycle
    are ignored: one stage at a time, killed from any stage but the last, nothing after that.

    Each stage is one minimum per lead over the events after the stage before it, combined per task, so a lead with very
    many events is no hot spot.  Of events at one time the earlier stage comes first.  Leads without events keep theirs.
    """
    start = F.when(F.col("status") == "killed", -1).otherwise(F.array_position(F.array(*map(F.lit, STAGES)), F.coalesce("status", F.lit("new"))) - 1)
    reached = leads.select(key, start.alias("_s")).where(F.col("_s").between(0, len(STAGES) - 2)).distinct()
    for i, stage in enumerate(STAGES[1:], 1):
        held = events.where(F.col("status") == stage).select(F.col(key).alias("_k"), "at")
        before = F.col("_s") >= i - 1 if i == 1 else (F.col("_s") >= i - 1) | (F.col("at") >= F.col(f"_t{i - 1}"))
        good = reached.join(held, F.col(key) == F.col("_k")).where((F.col("_s") < i) & before)
        reached = reached.join(good.groupBy(key).agg(F.min("at").alias(f"_t{i}")), key, "left")
    killed = events.where("status = 'killed'").groupBy(key).agg(F.min("at").alias("_x"))
    last = len(STAGES) - 1
    reached = reached.join(killed, key, "left")
    highest = F.greatest(F.col("_s"), *[F.when(F.col(f"_t{i}").isNotNull(), i).otherwise(0) for i in range(1, last + 1)])
    name = F.get(F.array(*map(F.lit, STAGES)), highest.cast("int"))
    dead = F.col("_x").isNotNull() & (F.col(f"_t{last}").isNull() | (F.col("_x") < F.col(f"_t{last}")))
    moved = reached.select(key, F.when(dead, "killed").otherwise(name).alias("_to"))
    return leads.join(moved, key, "left").withColumn("status", F.coalesce("_to", "status")).drop("_to")


def rank_leads(leads: DataFrame) -> DataFrame:
    """Fill ``rank_score`` with the score's share of its detector's largest score, an extension; existing ones stay.

    A score that is not a number ranks like a missing one.  The maximum is aggregated and joined back, so a detector with very many leads is never sorted in one task.
    """
    most = leads.where(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("detector_id").agg(F.max("score").alias("_most"))
    share = F.when((F.col("_most") > 0) & ~F.isnan("score"), F.col("score") / F.col("_most"))
    own = F.nanvl("rank_score", F.lit(None).cast("double"))
    return leads.join(broadcast_if_small(most), "detector_id", "left").withColumn("rank_score", F.coalesce(own, share)).drop("_most")
