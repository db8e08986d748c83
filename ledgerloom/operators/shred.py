"""Problem 2: deeply nested JSON records as related flat tables.

Each record is parsed once and walked into path-value-ordinal triples; a triple's table is the path of its innermost
repeated ancestor and its row key the ordinals of all repeated ancestors.  As all triples of a record are born in one
task, pivoting a table's triples into rows needs no shuffle.  Which paths repeat is a property of the whole
``source_group`` and is found in a first pass that keeps only (group, path) pairs, combined per task before the shuffle.

A repeating field may be carried as a list, as a lone object (position 0), as an object with the keys 0..n-1, or as text
holding JSON of one of those.  Text that is not complete JSON gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import deep
from ledgerloom.operators.skew import broadcast_if_small
from ledgerloom.session import cut

_TYPE = {bool: "boolean", int: "number", float: "number", str: "text", dict: "object", list: "list"}


def parse(text: str | None):
    """The record, or None for null, incomplete or invalid JSON; nesting may be as deep as it likes."""
    if not text:
        return None
    try:
        return deep.loads(text)
    except ValueError:
        return None


def opened(value):
    """A value with JSON text of a list or an object replaced by what it holds."""
    if isinstance(value, str):
        head = value.lstrip()[:1]
        if head == "[" or head == "{":
            inner = parse(value)
            if isinstance(inner, (list, dict)):
                return inner
    return value


def is_index_map(value: dict) -> bool:
    """An object that stands for a list: its keys are 0..n-1 in any order and it holds an object."""
    n = len(value)
    return n > 0 and all(k.isdecimal() for k in value) and {int(k) for k in value} == set(range(n)) and any(isinstance(v, dict) for v in value.values())


def elements_of(value) -> list[tuple[int, object]]:
    """Position and value of each element of a repeating field, however carried; scalars carry none."""
    value = opened(value)
    if isinstance(value, list):
        return list(enumerate(value))
    if isinstance(value, dict):
        return [(int(k), v) for k, v in value.items()] if is_index_map(value) else [(0, value)]
    return []


def repeating_paths(value, path: str, out: set[str]) -> None:
    """Collect the paths (names joined by ``.``) under which a list of objects is held."""
    stack = [(value, path)]
    while stack:
        value, path = stack.pop()
        value = opened(value)
        if isinstance(value, dict):
            if path and is_index_map(value):
                value = list(value.values())
            else:
                stack.extend((v, f"{path}.{k}" if path else k) for k, v in value.items() if v.__class__ in (dict, list, str))
                continue
        if isinstance(value, list):
            if path and any(isinstance(v, dict) for v in value):
                out.add(path)
            stack.extend((v, path) for v in value if isinstance(v, (dict, list)))


def triples(value: dict, repeated: frozenset[str]) -> Iterator[tuple[str, str, str, str, object, str]]:
    """(table, row, parent table, parent row, value, column) of one record; a row itself comes with the column ''.

    Tables are named as ``child_path`` is: field names joined by ``.``, ``[]`` after repeating fields; the root is ''.
    """
    stack = [(value, "", "", "", "", "")]  # object, plain path, marked path, table, row, column prefix
    yield "", "", "", "", value, ""
    while stack:
        obj, plain, marked, table, row, prefix = stack.pop()
        for k, v in obj.items():
            p = f"{plain}.{k}" if plain else k
            m = f"{marked}.{k}" if marked else k
            if p in repeated:
                child = m + "[]"
                for at, element in elements_of(v):
                    if isinstance(element, dict):
                        pos = f"{row}.{at}" if row else str(at)
                        yield child, pos, table, row, element, ""
                        stack.append((element, p, child, child, pos, ""))
            else:
                w = opened(v)
                if isinstance(w, dict):
                    stack.append((w, p, m, table, row, f"{prefix}{k}."))
                else:
                    yield table, row, "", "", w, f"{prefix}{k}"


def find_repeating(df: DataFrame, group: str = "source_group", text: str = "raw_json") -> DataFrame:
    """(group, paths): the repeating paths of each group, as one array; groups without any are absent.

    The result is as large as the schemas, not the data.  It is written to reliable storage, since two passes use it.
    """

    def run(batches):
        seen: dict[str, set[str]] = {}
        for batch in batches:
            for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = parse(t)
                if isinstance(value, dict) and g is not None:
                    repeating_paths(value, "", seen.setdefault(g, set()))
        pairs = [(g, p) for g, paths in seen.items() for p in paths]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in pairs], pa.string()), pa.array([x[1] for x in pairs], pa.string())], ["g", "p"])

    pairs = df.select(F.col(group).alias("g"), F.col(text).alias("t")).mapInArrow(run, "g string, p string").distinct()
    return cut(pairs.groupBy(F.col("g").alias(group)).agg(F.array_sort(F.collect_set("p")).alias("paths")))


def shred(df: DataFrame, key: str = "ord", group: str = "source_group", text: str = "raw_json", values: bool = True, root: bool = True, repeating: DataFrame | None = None, carry: str | None = None) -> DataFrame:
    """Rows of all flat tables: key, group, child_path, elem_pos, parent_path, parent_pos and, if asked, fields.

    ``fields`` maps a column (field names under the row's own object) to its text; lists of scalars stay JSON text, null
    fields are absent.  The root table has the path ''.  Records with a null group, null key or text that is no
    complete JSON object give no rows; repeated records give repeated rows.  ``repeating`` takes the result of
    ``find_repeating`` where it is known already, and ``carry`` names a text column to give every row of a record.
    """
    names = ["key", "g", "child_path", "elem_pos", "parent_path", "parent_pos"] + ["fields"] * values + ["carried"] * bool(carry)
    kinds = [pa.int64(), *[pa.string()] * 5] + [pa.map_(pa.string(), pa.string())] * values + [pa.string()] * bool(carry)
    schema = ", ".join(f"{n} {'bigint' if n == 'key' else 'map<string,string>' if n == 'fields' else 'string'}" for n in names)

    def run(batches):
        cache: dict[tuple, frozenset[str]] = {}
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for k, g, t, paths, own in zip(*(batch.column(i).to_pylist() for i in range(5))):
                record = parse(t)
                if not isinstance(record, dict):
                    continue
                repeated = cache.setdefault(g, frozenset(paths or ()))
                if not repeated and not root:
                    continue
                rows: dict[tuple[str, str], list] = {}
                for table, row, up, up_row, value, column in triples(record, repeated):
                    if not column:
                        rows[table, row] = [k, g, table, row, up, up_row, *([{}] if values else []), *([own] if carry else [])]
                    elif values and value is not None:
                        rows[table, row][6][column] = value if isinstance(value, str) else deep.dumps(value)
                for r in rows.values():
                    if root or r[2]:
                        for c, v in zip(cols, r):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array([list(x.items()) for x in c] if n == "fields" else c, t) for n, c, t in zip(names, cols, kinds)], names)

    paths = broadcast_if_small(find_repeating(df, group, text) if repeating is None else repeating)
    rows = df.select(group, F.col(key).alias("_k"), F.col(text).alias("_t"), (F.col(carry).cast("string") if carry else F.lit(None).cast("string")).alias("_c")).where(F.col(group).isNotNull() & F.col("_k").isNotNull())
    rows = rows.join(paths, group, "left" if root else "inner").select(F.col("_k").cast("bigint"), group, "_t", "paths", "_c")
    return rows.mapInArrow(run, schema).withColumnsRenamed({"key": key, "g": group} | ({"carried": carry} if carry else {}))


def child_objects(df: DataFrame) -> DataFrame:
    """(ord, child_path, elem_pos) of every object in a repeating field."""
    return shred(df, values=False, root=False).select("ord", "child_path", "elem_pos")


def flat_table(shredded: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """One flat table of ``shredded``: the rows at ``path`` with the named columns pivoted out of their triples."""
    at = shredded.where(F.col("child_path") == path)
    return at.select("ord", "elem_pos", "parent_path", "parent_pos", *[F.col("fields")[c].alias(c.replace(".", "_").replace("@", "")) for c in columns])
