"""Problem 3: schemas that drift between the files of a directory.

A column-lifespan catalogue has one row per directory, field, type and file.  ``lag`` over the numbered files of a
directory turns it into islands; an island that starts or ends inside the directory's series is a change.  A field that
ends where another of the same kind starts is a rename if it keeps its parent or its own name, the two never stand in one
file of the directory and their content looks alike.  Content is compared in a second pass over only those files and fields that are still in question.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import deep
from ledgerloom.operators.shred import elements_of, find_repeating, opened, parse, triples
from ledgerloom.operators.skew import broadcast_if_small
from ledgerloom.session import cut

#: Least likeness of content (0..1) for a rename: the two have more in common than not.
ALIKE = 0.5


def fields_of(record: dict, repeated: frozenset[str]):
    """(path, type, value) of every field of one record that has a value; null and blank text have none."""
    stack = [(record, "", "")]
    while stack:
        obj, plain, marked = stack.pop()
        for k, v in obj.items():
            if v is None or (v.__class__ is str and not v.strip()):
                continue
            p = f"{plain}.{k}" if plain else k
            m = p if marked is plain else f"{marked}.{k}"
            if p in repeated:
                m += "[]"
                held = opened(v)
                if not isinstance(held, (list, dict)):
                    yield m, _kind(held), held
                    continue
                inner = [e for _, e in elements_of(held) if isinstance(e, dict)]
                yield m, "list", inner
                stack.extend((e, p, m) for e in inner)
            else:
                v = opened(v)
                yield m, _kind(v), v
                if isinstance(v, dict):
                    stack.append((v, p, p if m is p else m))


def _kind(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return "object" if isinstance(v, dict) else "list" if isinstance(v, list) else "text"


def features_of(value) -> list[tuple[str, int]]:
    """Kinds of evidence in one value, (family, bucket): the form of the text and its words, or names of what it holds."""
    if isinstance(value, list):
        if value and not isinstance(value[0], dict):
            return [("word", _bucket(str(v).lower())) for v in value]
        return [("name", _bucket(k)) for v in value if isinstance(v, dict) for k in v]
    if isinstance(value, dict):
        return [("name", _bucket(k)) for k in value]
    if isinstance(value, bool):
        return [("form", int(value))]
    if isinstance(value, (int, float)):
        size = int(math.log10(abs(value))) if abs(value) >= 1 and math.isfinite(value) else -1
        whole = isinstance(value, int) or value == int(value) if math.isfinite(value) else False
        return [("form", _bucket(f"n{size}{value < 0}{isinstance(value, int)}")), ("word", _bucket(repr(value)))]
    words = value.split()
    form = _LETTERS.sub("a", _DIGITS.sub("9", value.strip())) if len(words) <= 3 else f"long{int(math.log2(len(words)))}"
    return [("form", _bucket(form)), *(("word", _bucket(w.strip('.,;"').lower())) for w in words)]


_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


@lru_cache(maxsize=200_000)
def _bucket(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _files(df: DataFrame) -> DataFrame:
    """Rows of files that stand in a series: XML files with one record each are left out."""
    return df.where(F.col("source_group").isNotNull() & F.col("source_file").isNotNull() & ~F.col("source_file").rlike(r"(?i)\.xml$"))


def _directory(file: Column) -> Column:
    return F.regexp_replace(file, r"/?[^/]*$", "")


def catalogue(df: DataFrame, repeating: DataFrame, every_file: bool = False) -> DataFrame:
    """(source_group, source_file, path, kind, n): how many records of a file have a field with a value of a type.

    Counts are combined per task before the shuffle.  A row with an empty path counts the file's parsed records, so a
    file whose records carry no field still takes its place in the series.
    """

    def run(batches):
        cache: dict = {}
        for batch in batches:
            per: dict[tuple, Counter] = defaultdict(Counter)  # by group and file
            for g, f, t, paths in zip(*(batch.column(i).to_pylist() for i in range(4))):
                record = parse(t)
                if not isinstance(record, dict):
                    continue
                repeated = cache.setdefault(g, frozenset(paths or ()))
                own = per[g, f]
                own["", ""] += 1
                own.update({(p, k) for p, k, _ in fields_of(record, repeated)})
            found = [(*at, *field, n) for at, own in per.items() for field, n in own.items()]
            yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in found], pa.string()) for i in range(4)), pa.array([x[4] for x in found], pa.int64())], ["source_group", "source_file", "path", "kind", "n"])

    rows = (df if every_file else _files(df)).select("source_group", "source_file", "raw_json").join(broadcast_if_small(repeating), "source_group", "left")
    found = rows.mapInArrow(run, "source_group string, source_file string, path string, kind string, n bigint")
    return found.groupBy("source_group", "source_file", "path", "kind").agg(F.sum("n").alias("n"))


def lifespans(cat: DataFrame) -> DataFrame:
    """The catalogue with one type per field and file (the commonest), files numbered within their directory, and the
    island each row belongs to: consecutive files with the field and the same type.

    The numbering window holds the files of one directory, not their records.
    """
    cat = cat.withColumn("dir", _directory(F.col("source_file")))
    files = cat.where("path = ''").groupBy("dir", "source_file").agg(F.max("source_group").alias("source_group"), F.sum("n").alias("records"))
    files = files.withColumn("at", F.row_number().over(Window.partitionBy("dir").orderBy("source_file")))
    files = files.withColumn("last", F.max("at").over(Window.partitionBy("dir")))
    field = cat.where("path <> ''").groupBy("dir", "source_file", "path").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"), F.sum("n").alias("n"))
    own = Window.partitionBy("dir", "path").orderBy("at")
    field = field.join(files.hint("merge"), ["dir", "source_file"])
    field = field.withColumns({"before": F.lag("at").over(own), "kind_before": F.lag("kind").over(own), "next": F.lead("at").over(own)})
    starts = F.when((F.col("before") == F.col("at") - 1) & (F.col("kind_before") == F.col("kind")), 0).otherwise(1)
    return field.withColumn("island", F.sum(starts).over(own.rowsBetween(Window.unboundedPreceding, 0)))


def _ancestors(path: Column) -> Column:
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.when(i < F.size(parts), F.array_join(F.slice(parts, 1, i), ".")))


def _topmost(events: DataFrame) -> DataFrame:
    """Drop events on fields beneath a field that has an event in the same file."""
    named = events.withColumn("_up", F.explode(_ancestors(F.col("path")))).where("_up IS NOT NULL").select("dir", "at", "path", "_up")
    over = events.select("dir", "at", F.col("path").alias("_up")).distinct()
    beneath = named.join(over.hint("merge"), ["dir", "at", "_up"]).select("dir", "at", "path").distinct()
    return events.join(beneath.hint("merge"), ["dir", "at", "path"], "left_anti")


def _similarity(df: DataFrame, repeating: DataFrame, wanted: DataFrame) -> DataFrame:
    """Feature histograms (dir, source_file, path, family, bucket, n) of only the wanted (source_file, path) pairs."""
    per_file = wanted.groupBy("source_file").agg(F.collect_set("path").alias("asked"))

    def run(batches):
        cache: dict = {}
        for batch in batches:
            per: dict[tuple, Counter] = defaultdict(Counter)  # by file and field
            for g, f, t, paths, asked in zip(*(batch.column(i).to_pylist() for i in range(5))):
                record = parse(t)
                if not isinstance(record, dict):
                    continue
                repeated, asked = cache.setdefault(g, frozenset(paths or ())), set(asked)
                for p, _, v in fields_of(record, repeated):
                    if p in asked:
                        per[f, p].update(features_of(v))
            found = [(*at, *x, n) for at, own in per.items() for x, n in own.items()]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([x[i] for x in found], pa.string()) for i in range(3)), pa.array([x[3] for x in found], pa.int64()), pa.array([x[4] for x in found], pa.int64())],
                ["source_file", "path", "family", "bucket", "n"],
            )

    rows = _files(df).select("source_group", "source_file", "raw_json").join(broadcast_if_small(repeating), "source_group", "left")
    rows = rows.join(broadcast_if_small(per_file), "source_file").select("source_group", "source_file", "raw_json", "paths", "asked")
    found = rows.mapInArrow(run, "source_file string, path string, family string, bucket bigint, n bigint")
    return found.groupBy("source_file", "path", "family", "bucket").agg(F.sum("n").alias("n"))


def changes(df: DataFrame, repeating: DataFrame | None = None, counted: DataFrame | None = None) -> DataFrame:
    """(source_group, source_file, change_kind, field_path, new_path) of every change between neighbouring files.

    Files follow each other by name within a directory; a file with no parsable record is not part of the series.
    Defined results: no rows for empty input, for directories of one file, and for records with null group, file or
    text; a field whose type is mixed within a file has its commonest type.  Repeated rows change nothing.  ``repeating``
    and ``counted`` take the repeating paths and the catalogue where they are known already.
    """
    repeating = find_repeating(_files(df)) if repeating is None else repeating
    life = cut(lifespans(catalogue(df, repeating) if counted is None else _files(counted)))
    files = life.select("dir", "at", "source_file", "source_group").distinct()
    added = life.where("at > 1 AND (before IS NULL OR before < at - 1)").select("dir", "at", "path", "kind", F.lit("added").alias("event"))
    removed = life.where("at < last AND (next IS NULL OR next > at + 1)").select("dir", (F.col("at") + 1).alias("at"), "path", "kind", F.lit("removed").alias("event"))
    retyped = life.where("before = at - 1 AND kind <> kind_before").select("dir", "at", "path", "kind", F.lit("retyped").alias("event"))
    events = cut(_topmost(added.unionByName(removed).unionByName(retyped)))

    old = events.where("event = 'removed'").select("dir", "at", "kind", F.col("path").alias("old"))
    new = events.where("event = 'added'").select("dir", "at", "kind", F.col("path").alias("new"))
    # The catalogue and what follows from it grow with the files; as they compress well, their size on disk would have
    # them broadcast, hence the hints.
    pairs = old.join(new.hint("merge"), ["dir", "at", "kind"]).where(_related(F.col("old"), F.col("new")))
    present = life.select("dir", F.col("at").alias("_at"), "path")
    both = pairs.join(present.withColumnRenamed("path", "old").hint("merge"), ["dir", "old"]).join(present.withColumnRenamed("path", "new").hint("merge"), ["dir", "new", "_at"])
    pairs = cut(pairs.join(both.select("dir", "at", "old", "new").distinct().hint("merge"), ["dir", "at", "old", "new"], "left_anti"))

    names = life.select("dir", "at", "source_file").distinct()
    olds = pairs.join(names.withColumn("at", F.col("at") + 1).withColumnRenamed("source_file", "old_file").hint("merge"), ["dir", "at"])
    pairs = olds.join(names.withColumnRenamed("source_file", "new_file").hint("merge"), ["dir", "at"])
    wanted = pairs.select(F.col("old_file").alias("source_file"), F.col("old").alias("path")).union(pairs.select("new_file", "new")).distinct()
    hist = _similarity(df, repeating, wanted)
    share = F.col("n") / F.sum("n").over(Window.partitionBy("source_file", "path", "family"))
    hist = cut(hist.withColumn("share", share))
    # Bhattacharyya coefficient per family: the sum over buckets of the root of the product of shares.
    left = pairs.join(hist.select(F.col("source_file").alias("old_file"), F.col("path").alias("old"), "family", "bucket", F.col("share").alias("_a")).hint("merge"), ["old_file", "old"])
    right = hist.select(F.col("source_file").alias("new_file"), F.col("path").alias("new"), "family", "bucket", F.col("share").alias("_b"))
    like = left.join(right.hint("merge"), ["new_file", "new", "family", "bucket"]).groupBy("dir", "at", "old", "new", "family").agg(F.sum(F.sqrt(F.col("_a") * F.col("_b"))).alias("bc"))
    by = like.groupBy("dir", "at", "old", "new").agg(*[F.max(F.when(F.col("family") == x, F.col("bc"))).alias(x) for x in ("form", "word", "name")])
    # The forms of the values, or the names they hold, decide; words, which ids and dates do not share, only rank.
    by = by.where(F.coalesce("name", "form", F.lit(0.0)) >= ALIKE).withColumn("likeness", F.coalesce("name", F.col("form") + F.coalesce("word", F.lit(0.0))))
    renamed = _best_pairs(by)

    renamed = renamed.select("dir", "at", F.col("old").alias("path"), F.col("new").alias("new_path"), F.lit("renamed").alias("event"))
    taken = renamed.select("dir", "at", "path", F.lit("removed").alias("event")).unionByName(renamed.select("dir", "at", F.col("new_path").alias("path"), F.lit("added").alias("event")))
    plain = events.join(taken.hint("merge"), ["dir", "at", "path", "event"], "left_anti").select("dir", "at", "path", F.lit("").alias("new_path"), "event")
    out = plain.unionByName(renamed).join(files.hint("merge"), ["dir", "at"])
    return out.select("source_group", "source_file", F.col("event").alias("change_kind"), F.col("path").alias("field_path"), "new_path")


def _related(old: Column, new: Column) -> Column:
    """A field that is renamed keeps its parent, one that is moved keeps its name."""
    parent = lambda c: F.regexp_replace(c, r"\.?[^.]*$", "")
    leaf = lambda c: F.replace(F.regexp_extract(c, r"([^.]*)$", 1), F.lit("[]"), F.lit(""))
    return (parent(old) == parent(new)) | (leaf(old) == leaf(new))


def _best_pairs(pairs: DataFrame) -> DataFrame:
    """One partner per field and file: a pair stands if it is the best of both its sides; then so among the rest, until
    none is left.  Each round settles a pair of every file that has one, so it ends."""
    chosen = left = pairs.select("dir", "at", "old", "new", "likeness")
    chosen = chosen.limit(0).drop("likeness")
    while True:
        rank = lambda side: F.row_number().over(Window.partitionBy("dir", "at", side).orderBy(F.desc("likeness"), "old", "new"))
        best = cut(left.withColumns({"_o": rank("old"), "_n": rank("new")}).where("_o = 1 AND _n = 1").select("dir", "at", "old", "new"))
        if best.isEmpty():
            return chosen
        chosen = chosen.unionByName(best)
        left = cut(left.join(best.select("dir", "at", "old"), ["dir", "at", "old"], "left_anti").join(best.select("dir", "at", "new"), ["dir", "at", "new"], "left_anti"))
        if left.isEmpty():
            return chosen


def alias_table(changed: DataFrame) -> DataFrame:
    """(dir, name, canonical): every name a field has had in a directory and the name it has at the end.

    Renames form chains in file order, so the last name is found by following ``new_path`` to later renames; a name
    renamed back to an earlier one ends at itself.  Each round doubles the steps followed, until none is left.
    """
    step = changed.where("change_kind = 'renamed'").select(_directory(F.col("source_file")).alias("dir"), F.col("source_file").alias("since"), F.col("field_path").alias("name"), F.col("new_path").alias("to"))
    last = cut(step.groupBy("dir", "name").agg(F.max_by("to", "since").alias("canonical"), F.max("since").alias("since")))
    while True:
        nxt = last.select("dir", F.col("name").alias("canonical"), F.col("canonical").alias("_to"), F.col("since").alias("_since"))
        ahead = last.join(nxt.hint("merge"), ["dir", "canonical"], "left").withColumn("_on", F.coalesce(F.col("_since") > F.col("since"), F.lit(False)))
        ahead = cut(ahead.select("dir", "name", F.when(F.col("_on"), F.col("_to")).otherwise(F.col("canonical")).alias("canonical"), F.when(F.col("_on"), F.col("_since")).otherwise(F.col("since")).alias("since"), "_on"))
        last = ahead.drop("_on")
        if not ahead.where("_on").limit(1).count():
            return last.select("dir", "name", "canonical")


def _by_directory(alias: DataFrame) -> DataFrame:
    """(dir, aliases): the changed names of each directory, longest first."""
    entry = F.struct((-F.length("name")).alias("order"), "name", "canonical")
    return alias.where("name <> canonical").groupBy("dir").agg(F.array_sort(F.collect_list(entry)).alias("aliases"))


def _last_name(path: Column, aliases: Column) -> Column:
    """A path with the last name of its longest renamed prefix, again and again until none is left.

    Each name is replaced once at most, so as many rounds as there are names are enough and end in any case.
    """
    at = lambda p, a: (p == a["name"]) | F.startswith(p, F.concat(a["name"], F.lit(".")))

    def step(state: Column, _: Column) -> Column:
        hit = F.get(F.filter(state["left"], lambda a: at(state["path"], a)), F.lit(0))
        renamed = F.concat(hit["canonical"], F.substring(state["path"], F.length(hit["name"]) + 1, F.length(state["path"])))
        return F.when(hit.isNull(), state).otherwise(F.struct(renamed.alias("path"), F.filter(state["left"], lambda a: a["name"] != hit["name"]).alias("left")))

    walked = F.aggregate(aliases, F.struct(path.alias("path"), aliases.alias("left")), step)
    return F.when(F.exists(aliases, lambda a: at(path, a)), walked["path"]).otherwise(path)


def renamed_path(path: str, aliases: list[tuple[str, str]]) -> str:
    """``_last_name`` for one path; ``aliases`` are (name, canonical), longest name first."""
    left = list(aliases)
    while hit := next((a for a in left if path == a[0] or path.startswith(a[0] + ".")), None):
        path = hit[1] + path[len(hit[0]) :]
        left = [a for a in left if a[0] != hit[0]]
    return path


def cells(df: DataFrame, repeating: DataFrame, alias: DataFrame) -> DataFrame:
    """(ord, source_group, source_file, row, field, text): every scalar value of every record under its last name.

    A record's values are walked once and given out as they come; a name is resolved once per directory and task.
    """

    def run(batches):
        repeated_of: dict = {}
        names: dict[tuple, str] = {}
        known: dict[str, list] = {}
        for batch in batches:
            of, counts, at, fields, texts = [], [], [], [], []  # records that have values, how many, and the values
            for i, (g, t, paths, d, aliases) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 3, 4, 5, 6)))):
                record = parse(t)
                if not isinstance(record, dict):
                    continue
                repeated = repeated_of.setdefault(g, frozenset(paths or ()))
                own = known.setdefault(d, [(a["name"], a["canonical"]) for a in aliases or ()])
                before = len(texts)
                for table, row, _, _, value, column in triples(record, repeated):
                    if column and value is not None:
                        field = names.get((d, table, column))
                        if field is None:
                            field = names[d, table, column] = renamed_path(f"{table}.{column}" if table else column, own)
                        at.append(row)
                        fields.append(field)
                        texts.append(value if value.__class__ is str else deep.dumps(value))
                of.append(i)
                counts.append(len(texts) - before)
            each = pa.array(np.repeat(np.array(of, np.int64), counts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(each) for c in range(3)), *(pa.array(c, pa.string()) for c in (at, fields, texts))], ["ord", "source_group", "source_file", "row", "field", "text"])

    return _with_names(df, repeating, alias).mapInArrow(run, "ord bigint, source_group string, source_file string, row string, field string, text string")


def _with_names(df: DataFrame, repeating: DataFrame, alias: DataFrame) -> DataFrame:
    """(ord, source_group, source_file, raw_json, paths, dir, aliases): records with what is known of their group and
    directory; rows with a null group or key are left out."""
    rows = df.where("source_group IS NOT NULL AND ord IS NOT NULL").select(F.col("ord").cast("bigint").alias("ord"), "source_group", "source_file", "raw_json", F.coalesce(_directory(F.col("source_file")), F.lit("")).alias("dir"))
    rows = rows.join(broadcast_if_small(repeating), "source_group", "left").join(broadcast_if_small(_by_directory(alias)), "dir", "left")
    return rows.select("ord", "source_group", "source_file", "raw_json", "paths", "dir", "aliases")


def unified(df: DataFrame) -> DataFrame:
    """One table over all files: (ord, source_group, source_file, row, field, text, number, flag).

    A field stands under its directory's last name for it, and for what encloses it.  Its value is kept as text and, where it can be read so, as
    number and as flag, so no value is lost when a field changed type.  Scalars and lists of scalars only; ``row`` holds the
    positions of the enclosing repeated objects.  Files outside any series, XML files of one record each among them, are in
    it too.
    """
    repeating = find_repeating(df)
    changed = cut(changes(df, repeating))
    rows = cells(df, repeating, alias_table(changed))
    plain = F.regexp_replace("text", "[$,\\s]", "")
    return rows.select(
        "*",
        F.when(F.col("text").rlike("^[\\s$,+-.0-9]") & plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain).try_cast("double").alias("number"),
        F.when(F.lower("text").isin("true", "yes", "y"), True).when(F.lower("text").isin("false", "no", "n"), False).alias("flag"),
    )


def canonical_types(life: DataFrame, alias: DataFrame) -> DataFrame:
    """(field, kind): the commonest type of every canonical field outside lists, over all files of all directories.

    Objects count by the fields in them; a field that is an object here and a text there has the type of the texts.
    """
    named = life.where(~F.contains("path", F.lit("[]")) & (F.col("kind") != "object")).select("dir", "path", "kind", "n")
    named = named.join(broadcast_if_small(_by_directory(alias)), "dir", "left").withColumn("field", F.when(F.col("aliases").isNull(), F.col("path")).otherwise(_last_name(F.col("path"), F.col("aliases"))))
    per = named.groupBy("field", "kind").agg(F.sum("n").alias("n"))
    return per.groupBy("field").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"))


def _cast(text: Column, kind: str) -> Column:
    """What a text of another file stands for in a field of this type; null if it stands for nothing of the kind."""
    if kind == "number":
        plain = F.regexp_extract(F.regexp_replace(text, r"[$,\s]", ""), r"^(?:FY|#)?([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)%?$", 1)
        return F.nullif(plain, F.lit("")).try_cast("double")
    if kind == "boolean":
        low = F.lower(F.trim(text))
        return F.when(low.isin("true", "yes", "y"), True).when(low.isin("false", "no", "n"), False)
    return text


def _root_values(df: DataFrame, repeating: DataFrame, alias: DataFrame) -> DataFrame:
    """(ord, source_group, source_file, own): each record's values outside lists of objects, by their last names.

    Where two names of one field stand in one record, the first that is met counts.
    """

    def run(batches):
        repeated_of: dict = {}
        names: dict[tuple, str] = {}
        known: dict[str, list] = {}
        for batch in batches:
            of, maps = [], []
            for i, (g, t, paths, d, aliases) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 3, 4, 5, 6)))):
                record = parse(t)
                if not isinstance(record, dict):
                    continue
                repeated = repeated_of.setdefault(g, frozenset(paths or ()))
                own = known.setdefault(d, [(a["name"], a["canonical"]) for a in aliases or ()])
                found: dict[str, str] = {}
                stack = [(record, "")]
                while stack:
                    held, up = stack.pop()
                    for k, v in held.items():
                        path = f"{up}.{k}" if up else k
                        if v is None or path in repeated:
                            continue
                        v = opened(v)
                        if v.__class__ is dict:
                            stack.append((v, path))
                            continue
                        field = names.get((d, path))
                        if field is None:
                            field = names[d, path] = renamed_path(path, own)
                        found.setdefault(field, v if v.__class__ is str else deep.dumps(v))
                of.append(i)
                maps.append(list(found.items()))
            each = pa.array(np.array(of, np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(each) for c in range(3)), pa.array(maps, pa.map_(pa.string(), pa.string()))], ["ord", "source_group", "source_file", "own"])

    return _with_names(df, repeating, alias).mapInArrow(run, "ord bigint, source_group string, source_file string, own map<string,string>")


def unified_table(df: DataFrame) -> DataFrame:
    """One row per record of all files, with one typed column per canonical field outside lists.

    The columns and the casts into them are generated from the catalogue and the alias table: a column stands under the
    last name of its field, has the type its field has most often, and takes over what earlier names and types held.  What
    a cast cannot read is kept as text in ``uncast``, so no value is lost.  The list of columns is as long as the schemas.
    Names become ``a_b``; one that would clash with another, letter case aside, gets a number.
    """
    repeating = find_repeating(df)
    life = cut(catalogue(df.where("source_group IS NOT NULL AND source_file IS NOT NULL"), repeating, every_file=True))
    alias = cut(alias_table(cut(changes(df, repeating, life))))
    life = life.where("path <> ''").withColumn("dir", _directory(F.col("source_file")))
    types = [(r["field"], r["kind"]) for r in canonical_types(life, alias).orderBy("field").collect()]
    rows = _root_values(df, repeating, alias)
    taken = {"ord", "source_group", "source_file", "uncast", "_own"}
    cols, checked = [], []
    for field, kind in types:
        name = re.sub(r"\W+", "_", field).strip("_") or "field"
        while name.lower() in taken:
            name += "_2"
        taken.add(name.lower())
        text = F.col("own")[field]
        cols.append(_cast(text, kind).alias(name))
        if kind in ("number", "boolean"):  # any other value is its text
            checked.append((field, name))
    typed = rows.select("ord", "source_group", "source_file", *cols, F.col("own").alias("_own"))
    lost = [F.when(F.col("_own")[field].isNotNull() & F.col(name).isNull(), F.struct(F.lit(field).alias("key"), F.col("_own")[field].alias("value"))) for field, name in checked]
    uncast = F.map_from_entries(F.array_compact(F.array(*lost))) if lost else F.create_map().cast("map<string,string>")
    return typed.withColumn("uncast", F.to_json(uncast)).drop("_own")
