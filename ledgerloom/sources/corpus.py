"""Directories of CSV, JSON, JSONL and XML files as raw records: verbatim JSON with a content hash and a locator.

A Python data source streams each file, so memory stays flat however large a file is.  Small files are packed into
partitions of about the split size; JSON Lines files larger than that are split into byte ranges, and the line numbers
of a range come from a count of the line ends before it, made once for all ranges.  Reading goes through Arrow's file
systems, so local paths and object stores work alike.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import posixpath
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerloom.functions import deep
from ledgerloom.operators.skew import broadcast_if_small
from ledgerloom.session import cut

SUFFIXES = (".csv", ".json", ".jsonl", ".xml")
# Fields that name a record, in this order.
ID_FIELDS = ("filing_uuid", "url", "uuid", "id")
SCHEMA = "source_group string, source_file string, native_id string, content_hash string, raw_json string, record_no bigint"
_PART = SCHEMA + ", split int"
_BLOCK = 1 << 20
#: What opening a file counts for when files are packed, in bytes.
_OPENING = 4 << 20


def dumps(record) -> str:
    return deep.dumps(record)


def canonical_hash(record) -> str:
    """SHA-256 of the record with sorted names and compact separators."""
    return hashlib.sha256(deep.dumps(record, sort_keys=True).encode("utf-8", "surrogatepass")).hexdigest()


def native_id(record: dict, fallback: str | None, fields=ID_FIELDS) -> str | None:
    named = (record.get(k) for k in fields)
    return next((str(v) for v in named if v is not None and v != ""), fallback)


def group_of(path: str) -> str:
    return posixpath.splitext(path)[1].lower() + "::" + re.sub(r"\d+", "#", path)


def _wrapped(value) -> dict:
    return value if isinstance(value, dict) else {"_value": value}


# --- JSON Lines ---------------------------------------------------------------------------------------------------


def _to_line_start(stream, start: int) -> int:
    """Position of the first line that begins at ``start`` or after it."""
    if not start:
        return 0
    stream.seek(start - 1)
    at = start - 1
    while block := stream.read(_BLOCK):
        end = block.find(b"\n")
        if end >= 0:
            return at + end + 1
        at += len(block)
    return at


def lines_within(stream, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin in [start, end), each read whole wherever it ends."""
    at = _to_line_start(stream, start)
    stream.seek(at)
    held: list[bytes] = []  # parts of a line that is not finished yet
    while at < end and (block := stream.read(_BLOCK)):
        pos = 0
        while at < end and (stop := block.find(b"\n", pos)) >= 0:
            line = b"".join([*held, block[pos:stop]])
            held, pos = [], stop + 1
            at += len(line) + 1
            yield line
        held.append(block[pos:])
    if at < end and any(held):
        yield b"".join(held)


def count_lines(stream, start: int, end: int) -> int:
    """How many lines begin in [start, end)."""
    stream.seek(max(start - 1, 0))
    left, n = end - max(start, 1), 0 if start else int(end > 0)
    while left > 0 and (block := stream.read(min(_BLOCK, left))):
        n += block.count(b"\n")
        left -= len(block)
    return n


def read_jsonl(stream, start: int, end: int) -> Iterator[tuple[int, dict, str]]:
    """Records of the lines that begin in [start, end): (number of the line within the range from 1, record, locator).

    Blank and broken lines count but give nothing.
    """
    for no, raw in enumerate(lines_within(stream, start, end), 1):
        body = raw.decode("utf-8", "replace").strip()
        if body:
            try:
                yield no, _wrapped(deep.loads(body)), f"line={no}"
            except ValueError:
                continue


# --- JSON ---------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(rb'"(?:[^"\\]+|\\.)*"|["{}\[\],]', re.S)


class _Bytes:
    """A stream of which a part is held: it grows at the end and is let go at the front, once a block."""

    def __init__(self, stream) -> None:
        self.stream, self.held, self.ended = stream, b"", False

    def more(self) -> bool:
        """Read on, by at least as much as is held, so that a long element is scanned a bounded number of times."""
        block = b"" if self.ended else self.stream.read(max(_BLOCK, len(self.held)))
        self.ended = not block
        self.held += block
        return bool(block)


def elements(source: _Bytes, pos: int) -> Iterator[bytes]:
    """The texts of the elements of a list whose opening bracket stands before ``pos``.

    Only quotes, brackets and commas are looked at: an element ends at the comma or bracket that closes it at its own
    depth.  A list that breaks off gives its complete elements.
    """
    first, depth = pos, 0
    while True:
        match = _TOKEN.search(source.held, pos)
        token = match[0] if match else b""
        if not match or token == b'"':  # nothing more here, or a text that is not finished yet
            back = match.start() if match else len(source.held)
            source.held, back, first = source.held[first:], back - first, 0
            if not source.more():
                return
            pos = back
            continue
        pos = match.end()
        if token in (b"{", b"["):
            depth += 1
        elif token in (b"}", b"]") and depth:
            depth -= 1
        elif token in (b",", b"]", b"}") and not depth:
            yield source.held[first : match.start()]
            if token != b",":
                return
            first = pos
            if first > _BLOCK:
                source.held, first, pos = source.held[first:], 0, 0


def _members(value) -> Iterator[tuple[object, str]]:
    """What a top-level value that is no list stands for: its only list longer than one, or itself."""
    lists = [k for k, v in value.items() if isinstance(v, list) and len(v) > 1] if isinstance(value, dict) else []
    if len(lists) == 1:
        yield from ((v, f"{lists[0]}[{i}]") for i, v in enumerate(value[lists[0]]))
    else:
        yield value, "root"


def read_json(stream) -> Iterator[tuple[int, dict, str]]:
    """Elements of a top-level list, one at a time however long it is; of the only list longer than one in a top-level
    object; or the object or scalar itself.  A broken tail or element ends the list silently."""
    source = _Bytes(stream)
    while source.more() and not source.held.removeprefix(b"\xef\xbb\xbf").strip():
        pass
    lead = len(source.held) - len(source.held.removeprefix(b"\xef\xbb\xbf").lstrip())
    try:
        if source.held[lead : lead + 1] == b"[":
            for i, text in enumerate(elements(source, lead + 1)):
                if text.strip():
                    yield i, _wrapped(deep.loads(text.decode("utf-8", "replace"))), f"index={i}"
        else:
            while source.more():
                pass
            for i, (value, locator) in enumerate(_members(deep.loads(source.held[lead:].decode("utf-8", "replace")))):
                yield i, _wrapped(value), locator
    except ValueError:
        return


# --- XML and CSV --------------------------------------------------------------------------------------------------


def read_xml(stream) -> Iterator[tuple[int, dict, str]]:
    """The one record of a file, built as the parser comes to the end of each element.

    Attributes are ``@name``; a leaf is its stripped text, or with attributes has it as ``#text``, empty or not; children
    of one name become a list; text between children is dropped.  A broken file gives nothing.
    """
    open_: list[list[tuple[str, object]]] = [[]]  # per open element, its finished children
    try:
        for event, node in ET.iterparse(stream, events=("start", "end")):
            if event == "start":
                open_.append([])
                continue
            children = open_.pop()
            value: object = {f"@{k}": v for k, v in node.attrib.items()}
            if children:
                for tag, child in children:
                    known = value.get(tag)
                    value[tag] = child if tag not in value else [*known, child] if isinstance(known, list) else [known, child]
            elif value:
                value["#text"] = (node.text or "").strip()
            else:
                value = (node.text or "").strip()
            open_[-1].append((node.tag, value))
            node.clear()
    except ET.ParseError:
        return
    [(tag, value)] = open_[0]
    yield 0, {"_root_tag": tag, tag: value}, ""


def read_csv(stream) -> Iterator[tuple[int, dict, str]]:
    for i, row in enumerate(csv.DictReader(io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline="")), 1):
        yield i, {k if k is not None else "_rest": v for k, v in row.items()}, f"row={i}"


_READERS = {".json": read_json, ".xml": read_xml, ".csv": read_csv}


# --- the data source ----------------------------------------------------------------------------------------------


class _Bin(InputPartition):
    """Byte ranges of files that one task reads: (path, relative path, number of the range, start, end)."""

    def __init__(self, ranges: list[tuple[str, str, int, int, int]]) -> None:
        self.ranges = ranges


class CorpusReader(DataSourceReader):
    """Reads records, or with the option ``lines`` only how many lines begin in each range of a file of several."""

    def __init__(self, options: dict) -> None:
        self.root = options["path"].rstrip("/")
        self.only = options.get("only")
        self.files = json.loads(options["files"]) if options.get("files") else None
        self.split = int(options.get("splitbytes", 128 << 20))
        self.tasks = max(int(options.get("tasks", 1)), 1)
        self.ids = tuple(options["idfields"].split(",")) if options.get("idfields") else ID_FIELDS
        self.lines = options.get("lines") == "true"

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root if "://" in self.root else "file://" + posixpath.abspath(self.root))

    def _ranges(self) -> list[tuple[str, str, int, int, int]]:
        from pyarrow import fs

        system, base = self._system()
        asked = fs.FileSelector(base, recursive=True) if self.files is None else [posixpath.join(base, x) for x in self.files]
        out = []
        for info in sorted(system.get_file_info(asked), key=lambda i: i.path):
            relative = posixpath.relpath(info.path, base)
            if info.type == fs.FileType.File and relative.lower().endswith(SUFFIXES) and (not self.only or self.only in group_of(relative)):
                step = self.split if relative.lower().endswith(".jsonl") else max(info.size, 1)
                out += [(info.path, relative, i, s, min(s + step, info.size)) for i, s in enumerate(range(0, max(info.size, 1), step))]
        if self.lines:
            several = {r[0] for r in out if r[2]}
            out = [r for r in out if r[0] in several]
        return out

    def partitions(self) -> list[_Bin]:
        """Ranges in the order of their names, packed up to the split size, or less where tasks would go idle."""
        ranges = self._ranges()
        weigh = lambda r: r[4] - r[3] + _OPENING
        room = min(self.split, max(_OPENING, sum(map(weigh, ranges)) // self.tasks))
        bins: list[list] = []
        filled = 0
        for r in ranges:
            if not bins or filled + weigh(r) > room + _OPENING:
                bins.append([])
                filled = 0
            bins[-1].append(r)
            filled += weigh(r)
        return [_Bin(b) for b in bins or [[]]]

    def read(self, part: _Bin) -> Iterator[pa.RecordBatch]:
        system, _ = self._system()
        if self.lines:
            counted = []
            for path, relative, no, start, end in part.ranges:
                with system.open_input_file(path) as stream:
                    counted.append((relative, no, count_lines(stream, start, end)))
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in counted], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64()))], ["source_file", "split", "n"])
            return
        rows, size = [], 0
        for r in part.ranges:
            for row in self._records(system, *r):
                rows.append(row)
                size += len(row[4])
                if size > 8 << 20 or len(rows) >= 10_000:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _records(self, system, path: str, relative: str, no: int, start: int, end: int) -> Iterator[tuple]:
        stem, suffix = posixpath.splitext(posixpath.basename(relative))
        suffix = suffix.lower()
        group, lined = group_of(relative), suffix == ".jsonl"
        with system.open_input_file(path) as stream:
            for at, record, locator in read_jsonl(stream, start, end) if lined else _READERS[suffix](stream):
                # A line's number within its file is known only once the lines before its range are counted.
                fallback = None if lined else stem if suffix == ".xml" else f"{relative}:{locator}"
                yield group, relative, native_id(record, fallback, self.ids), canonical_hash(record), dumps(record), at, no


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    clean = lambda s: s.encode("utf-8", "replace").decode("utf-8") if isinstance(s, str) and not s.isascii() else s
    names = ["source_group", "source_file", "native_id", "content_hash", "raw_json", "record_no", "split"]
    kinds = [*[pa.string()] * 5, pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([clean(r[i]) for r in rows], kinds[i]) for i in range(7)], names)


class Corpus(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return "source_file string, split int, n bigint" if self.options.get("lines") == "true" else _PART

    def reader(self, schema) -> CorpusReader:
        return CorpusReader({k.lower(): v for k, v in self.options.items()})


def read_corpus(spark: SparkSession, path: str, only: str | None = None, files: list[str] | None = None, **options: str) -> DataFrame:
    """Raw records of all files under ``path``, or of the named ``files`` there; ``only`` keeps the groups whose name
    contains it.

    ``record_no`` is a line's number from 1, an element's from 0, a row's from 1.  Files of several ranges are read twice,
    once for their line ends; the table of ranges is as large as the corpus is in splits.
    """
    spark.dataSource.register(Corpus)
    asked = {"path": path, "tasks": str(spark.sparkContext.defaultParallelism)} | options
    if only:
        asked["only"] = only
    if files is not None:
        asked["files"] = json.dumps(files)
    rows = spark.read.format("corpus").options(**asked).load()
    counts = cut(spark.read.format("corpus").options(**asked, lines="true").load())
    before = F.sum("n").over(Window.partitionBy("source_file").orderBy("split")) - F.col("n")  # a file's ranges, not its lines
    rows = rows.join(broadcast_if_small(counts.select("source_file", "split", before.alias("_before"))), ["source_file", "split"], "left")
    no = F.col("record_no") + F.coalesce("_before", F.lit(0))
    ids = F.coalesce("native_id", F.concat("source_file", F.lit(":line="), no.cast("string")))
    return rows.select("source_group", "source_file", ids.alias("native_id"), "content_hash", "raw_json", no.alias("record_no"))


def hash_of_records(records: DataFrame, key: str = "ord", text: str = "raw_json") -> DataFrame:
    """(key, content_hash): the canonical hash of every record that is complete JSON; others and null keys give no row."""

    def run(batches):
        for batch in batches:
            keys, hashes = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    hashes.append(canonical_hash(deep.loads(t)))
                    keys.append(k)
                except ValueError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hashes, pa.string())], ["k", "content_hash"])

    rows = records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint"), text)
    return rows.mapInArrow(run, "k bigint, content_hash string").withColumnRenamed("k", key)


def first_of_each(records: DataFrame) -> DataFrame:
    """One row per (source_group, native_id, content_hash): that of the first file by name, then the first record.

    A minimum per key, combined per task: however often one record repeats, it costs one row per task.
    """
    key = ["source_group", "native_id", "content_hash"]
    first = records.groupBy(*key).agg(F.min_by(F.struct("source_file", "raw_json", "record_no"), F.struct("source_file", "record_no")).alias("f"))
    return first.select("source_group", "f.source_file", "native_id", "content_hash", "f.raw_json", "f.record_no")


def load(records: DataFrame, store: str) -> int:
    """Append the records that ``store`` does not hold yet; loading the same files again adds nothing.

    Of the store only the groups of this load are read, and only keys.  A load with few records (checked) is broadcast
    to them, so the store is not shuffled; a large one is joined by shuffle.
    """
    spark, key = records.sparkSession, ["source_group", "native_id", "content_hash"]
    new = cut(first_of_each(records))
    try:
        known = spark.read.parquet(store).select(*key)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    else:
        groups = [r[0] for r in new.select("source_group").distinct().limit(1001).collect()]
        if len(groups) <= 1000 and None not in groups:  # templates of paths; beyond that all partitions are read
            known = known.where(F.col("source_group").isin(groups))
        held = known.join(broadcast_if_small(new.select(*key)), key, "left_semi")
        new = cut(new.join(held, key, "left_anti"))
    new.write.mode("append").partitionBy("source_group").parquet(store)
    return new.count()


def meta(spark: SparkSession, root: str, version: str = "1") -> DataFrame:
    """(key, value): what a store was built from."""
    return spark.createDataFrame([("schema_version", version), ("corpus_root", root)], "key string, value string")


def reconcile(records: DataFrame) -> DataFrame:
    return records.groupBy("source_group").agg(F.count("*").alias("n_records"))


def show_source(records: DataFrame, native: str, group: str | None = None) -> DataFrame:
    """Every record with a native id, in all groups or one."""
    out = records.where(F.col("native_id") == native)
    return out.where(F.col("source_group") == group) if group is not None else out


def show_locator(records: DataFrame, locator: str) -> DataFrame:
    """Records of ``group::id``: split at the last ``::``, and at the first where that finds nothing is left to the caller."""
    group, _, native = locator.rpartition("::")
    return show_source(records, native, group or None)
