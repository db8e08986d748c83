"""Raw records to typed tables by a declarative mapping: paths, explosion, constants, coercion, union, provenance."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.coerce import COERCIONS

PROVENANCE = ["source_group", "native_id", "content_hash", "elem_index"]


def json_at(json: Column, path: str) -> Column:
    """Scalar text at a dotted path; ``[]`` takes the first element of a list and does nothing to anything else.

    Containers, nulls and missing paths are null.  The path '' is the value itself.
    """
    raw = reduce(_step, path.split("."), json) if path else json
    return F.when(~F.ltrim(raw).rlike(r"^[\[{]"), raw)


def _step(json: Column, segment: str) -> Column:
    name = segment.removesuffix("[]").replace("'", "\\'")
    inner = F.get_json_object(json, f"$['{name}']")
    if not segment.endswith("[]"):
        return inner
    return F.when(F.ltrim(inner).startswith("["), F.get_json_object(inner, "$[0]")).otherwise(inner)


def _getter(name: str):
    return lambda j: F.get_json_object(j, f"$['{name}']")


def elements_at(json: Column, path: str) -> Column:
    """Array of the JSON texts of the elements at a path: a list's elements, a lone object as one, lists on the way flattened."""
    current = F.array(json)
    for segment in path.split("."):
        name = segment.removesuffix("[]").replace("'", "\\'")
        inner = F.filter(F.transform(current, _getter(name)), lambda j: j.isNotNull())
        listed = F.transform(inner, lambda j: F.when(F.ltrim(j).startswith("["), F.from_json(j, "array<string>")).otherwise(F.array(j)))
        current = F.flatten(listed)
    return F.filter(current, lambda j: j.isNotNull())


def group_matches(group: Column, pattern: str) -> Column:
    """A group is named exactly, as profiles report it."""
    return group == pattern


def read_once(rows: DataFrame, record: str, paths: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """``rows`` with every object on the way to ``paths`` parsed once, and the scalar text at each path.

    Each object is parsed into a struct of texts, one level at a time, so a field that is an object here and a text there
    spoils none of its neighbours.  A list on the way (``[]``) is read from its first element.
    """
    tree: dict = {}
    for p in paths:
        node = tree
        for segment in p.split(".") if p else []:
            node = node.setdefault(segment, {})
    found: dict[str, Column] = {"": F.when(~F.ltrim(record).rlike(r"^[\[{]"), F.col(record))}
    made = 0

    def walk(rows: DataFrame, at: str, node: dict, prefix: str) -> DataFrame:
        nonlocal made
        if not node:
            return rows
        held = f"_parsed{made}"
        made += 1
        names = list(dict.fromkeys(s.removesuffix("[]") for s in node))
        shape = T.StructType([T.StructField(x, T.StringType()) for x in names])
        rows = rows.withColumn(held, F.from_json(at, shape))
        for segment, below in node.items():
            value = F.col(held)[segment.removesuffix("[]")]
            if segment.endswith("[]"):
                value = F.when(F.ltrim(value).startswith("["), F.get_json_object(value, "$[0]")).otherwise(value)
            here = f"{prefix}.{segment}" if prefix else segment
            found[here] = F.when(~F.ltrim(value).rlike(r"^[\[{]"), value)
            if below:
                text = f"_text{made}"
                rows = walk(rows.withColumn(text, value), text, below, here)
        return rows

    return walk(rows, record, tree, ""), found


def normalise_table(raw: DataFrame, mapping) -> DataFrame:
    """One typed table from all its sources, with provenance; absent columns are null, derived columns come last.

    A constant wins over a path of the same column.  In an exploding source ``^.`` reads from the enclosing record; records
    without the exploded path give no rows, nor do records that are null or no complete JSON.  ``elem_index`` is null
    unless exploded.  A derived entry without a name keeps only the rows it does not hold for.
    """
    parts = []
    for s in mapping.sources:
        rows = raw.where(group_matches(F.col("source_group"), s.group) & F.try_parse_json("raw_json").isNotNull()).select("source_group", "native_id", "content_hash", F.col("raw_json").alias("_rec"))
        if s.explode:
            rows = rows.select("*", F.posexplode(elements_at(F.col("_rec"), s.explode)).alias("elem_index", "_el"))
        else:
            rows = rows.withColumn("elem_index", F.lit(None).cast("int"))
        wanted = {c: p for c, p in s.paths.items() if c not in s.const}
        upper = {c: p[2:] for c, p in wanted.items() if p.startswith("^.")}
        own = {c: p for c, p in wanted.items() if c not in upper}
        values: dict[str, Column] = {}
        for record, asked in (("_rec", upper if s.explode else wanted | upper), ("_el", own if s.explode else {})):
            if asked:
                rows, found = read_once(rows, record, list(asked.values()))
                kept = {f"_v_{c}": found[p] for c, p in asked.items()}
                rows = rows.withColumns(kept)
                values |= {c: F.col(f"`_v_{c}`") for c in asked}
        cols = []
        for c in mapping.columns:
            coerce = COERCIONS[mapping.types.get(c, "text")]
            const = F.lit(None if s.const.get(c) is None else str(s.const[c])).cast("string")
            cols.append(coerce(const if c in s.const else values.get(c, F.lit(None).cast("string"))).alias(c))
        parts.append(rows.select(*cols, *PROVENANCE))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for name, sql in mapping.derived:
        out = out.withColumn(name, F.expr(sql)) if name else out.where(~F.coalesce(F.expr(sql), F.lit(False)))
    return out.drop(*[n for n, _ in mapping.derived if n.startswith("_new_")])


def write_tables(raw: DataFrame, mappings: list, folder: str, only: str | None = None, views: list[tuple[str, str]] = ()) -> dict[str, int]:
    """Build ``norm_<name>`` of every mapping anew under ``folder``, or of the one named; rows written per table.

    Views are SQL over the tables and earlier views; they are written as tables too, so that later runs need no session
    state.  As derived steps belong to a whole build, views are left out where only one table is built.
    """
    spark, written = raw.sparkSession, {}
    for m in mappings:
        if only is None or m.name == only:
            target = f"{folder}/norm_{m.name}"
            normalise_table(raw, m).write.mode("overwrite").parquet(target)
            table = spark.read.parquet(target)
            table.createOrReplaceTempView(f"norm_{m.name}")
            written[f"norm_{m.name}"] = table.count()
    if only is not None and not written:
        raise ValueError(f"no table named {only}")
    for name, sql in views if only is None else ():
        spark.sql(sql).write.mode("overwrite").parquet(f"{folder}/{name}")
        view = spark.read.parquet(f"{folder}/{name}")
        view.createOrReplaceTempView(name)
        written[name] = view.count()
    return written


_ALTER = re.compile(r"\s*ALTER\s+TABLE\s+(\w+)\s+ADD\s+(?:COLUMN\s+)?(\w+).*", re.I | re.S)
_UPDATE = re.compile(r"\s*UPDATE\s+(\w+)\s+SET\s+(.+?)\s*;?\s*$", re.I | re.S)
_DELETE = re.compile(r"\s*DELETE\s+FROM\s+(\w+)(?:\s+WHERE\s+(.+?))?\s*;?\s*$", re.I | re.S)
_VIEW = re.compile(r"\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?VIEW\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)\s+AS\s+(.+?)\s*;?\s*$", re.I | re.S)
_DROP_VIEW = re.compile(r"\s*DROP\s+VIEW\b", re.I)
_INDEX = re.compile(r"\s*(CREATE\s+(UNIQUE\s+)?INDEX|ANALYZE|PRAGMA)\b", re.I)


def _split_outside(sql: str, at: re.Pattern) -> list[str]:
    """``sql`` cut where ``at`` matches outside texts, brackets and CASE ... END."""
    parts, depth, start = [], 0, 0
    for token in re.finditer(r"'(?:[^']|'')*'|[()]|\b(?:CASE|END)\b|" + at.pattern, sql, re.I | re.S):
        word = token[0].upper()
        if word in ("(", "CASE"):
            depth += 1
        elif word in (")", "END"):
            depth -= 1
        elif not depth and not word.startswith("'"):
            parts.append(sql[start : token.start()])
            start = token.end()
    return [*parts, sql[start:]]


def derive_from_sql(statement: str, tables: dict, views: list[tuple[str, str]] | None = None) -> None:
    """Turn a pack's statements into derived steps of its mappings; anything else is refused loudly.

    ``UPDATE t SET a = x, b = y WHERE p`` becomes CASE WHEN p THEN x ELSE a END and so on, all from the values before it;
    ``DELETE FROM t WHERE p`` keeps the other rows; a view is kept for ``write_tables``.  Index statements mean nothing.
    """
    if _INDEX.match(statement) or _DROP_VIEW.match(statement):
        return
    alter, update, delete, view = (x.fullmatch(statement) for x in (_ALTER, _UPDATE, _DELETE, _VIEW))
    if alter and alter[1] in tables:
        t = tables[alter[1]]
        if alter[2] not in t.columns and alter[2] not in dict(t.derived):
            t.derived.append((alter[2], "CAST(NULL AS STRING)"))
        return
    if update and update[1] in tables:
        t = tables[update[1]]
        body, *where = _split_outside(update[2], re.compile(r"\bWHERE\b"))
        steps = []
        for assignment in _split_outside(body, re.compile(",")):
            name, _, value = (x.strip() for x in assignment.partition("="))
            if not re.fullmatch(r"\w+", name) or not value:
                raise ValueError(f"post_sql assignment cannot be read: {assignment.strip()[:120]}")
            keep = f"`{name}`" if name in t.columns or name in dict(t.derived) else "NULL"
            steps.append((name, f"CASE WHEN {where[0].strip()} THEN {value} ELSE {keep} END" if where else value))
        # Assignments see the values before the statement, so all are computed before any takes effect.
        t.derived += steps if len(steps) == 1 else [*((f"_new_{n}", sql) for n, sql in steps), *((n, f"`_new_{n}`") for n, _ in steps)]
        return
    if delete and delete[1] in tables:
        tables[delete[1]].derived.append(("", delete[2] or "true"))
        return
    if view and views is not None:
        views.append((view[1], view[2]))
        return
    raise ValueError(f"post_sql statement is no assignment, deletion or view of a mapped table: {statement.strip()[:120]}")
