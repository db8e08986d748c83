import hashlib
import io
import json

from pyspark.sql import functions as F

from ledgerloom.sources import corpus
from ledgerloom.streaming import ingest


def _golden(root):
    (root / "grants").mkdir(parents=True), (root / "vendors").mkdir(), (root / "audit").mkdir(), (root / "payments").mkdir()
    (root / "grants/2024-1.jsonl").write_bytes(b'{"id":"1","n":2.0}\n\n{bad\n7\n{"x":"caf\xe9"}\n{"id":"1","n":2.0}\n{"id":"1","n":3}')
    (root / "grants/2024-2.jsonl").write_bytes(b'{"n":2.0,"id":"1"}\n')
    (root / "audit/1.json").write_text(' [{"id": 5}, 3, {"a": [1]}, {"tr')
    (root / "audit/2.json").write_text('{"meta": 1, "items": [{"id": "q"}, {"id": "r"}]}')
    (root / "audit/3.json").write_text('{"id": "solo", "few": [1]}')
    (root / "vendors/77.xml").write_text('<VENDOR rev="5"><name> A </name><o><p>x</p><p k="1">y</p></o></VENDOR>')
    (root / "vendors/78.xml").write_text("<VENDOR><broken>")
    (root / "payments/1.csv").write_text('id,payee\nP1,"A, B"\n,C\n')
    (root / "payments/readme.txt").write_text("no")
    return str(root)


def test_all_formats(spark, tmp_path):
    rows = corpus.read_corpus(spark, _golden(tmp_path / "c")).collect()
    by = {(r["source_file"], r["native_id"]): json.loads(r["raw_json"]) for r in rows}
    assert by["grants/2024-1.jsonl", "grants/2024-1.jsonl:line=4"] == {"_value": 7}
    assert by["grants/2024-1.jsonl", "grants/2024-1.jsonl:line=5"] == {"x": "caf�"}
    assert by["audit/1.json", "5"] == {"id": 5} and by["audit/1.json", "audit/1.json:index=1"] == {"_value": 3} and len([r for r in rows if r["source_file"] == "audit/1.json"]) == 3
    assert by["audit/2.json", "q"] == {"id": "q"} and by["audit/3.json", "solo"]["few"] == [1]
    assert by["vendors/77.xml", "77"] == {"_root_tag": "VENDOR", "VENDOR": {"@rev": "5", "name": "A", "o": {"p": ["x", {"@k": "1", "#text": "y"}]}}}
    assert by["payments/1.csv", "P1"]["payee"] == "A, B" and by["payments/1.csv", "payments/1.csv:row=2"]["payee"] == "C"
    assert {r["source_group"] for r in rows} == {".jsonl::grants/#-#.jsonl", ".json::audit/#.json", ".xml::vendors/#.xml", ".csv::payments/#.csv"}
    first = next(r for r in rows if r["source_file"] == "grants/2024-2.jsonl")
    assert first["content_hash"] == hashlib.sha256(b'{"id":"1","n":2.0}').hexdigest()
    assert corpus.read_corpus(spark, str(tmp_path / "c"), only="vendors").count() == 1


def test_loading_twice_adds_nothing(spark, tmp_path):
    records = corpus.read_corpus(spark, _golden(tmp_path / "c"))
    n = corpus.load(records, str(tmp_path / "store"))
    assert n == records.select("source_group", "native_id", "content_hash").distinct().count() and corpus.load(records, str(tmp_path / "store")) == 0
    store = spark.read.parquet(str(tmp_path / "store"))
    assert {r["source_group"]: r["n_records"] for r in corpus.reconcile(store).collect()}[".jsonl::grants/#-#.jsonl"] == 4
    assert {r["source_file"] for r in corpus.show_locator(store, ".jsonl::grants/#-#.jsonl::1").collect()} == {"grants/2024-1.jsonl"}
    assert corpus.show_source(store, "1").count() == 2 and corpus.show_source(store, "none").count() == 0


def test_byte_ranges_cover_every_line_once():
    body = b"\n".join([b"", b'{"a":1}', b"x", b'{"b":"' + b"z" * 50 + b'"}', b'{"c":3}', b""])
    whole = list(corpus.read_jsonl(io.BytesIO(body), 0, len(body)))
    assert [n for n, _, _ in whole] == [2, 4, 5]
    for step in (1, 3, 7, 20, 1000):
        parts, before = [], 0
        for s in range(0, len(body), step):
            parts += [(before + no, r, f"line={before + no}") for no, r, _ in corpus.read_jsonl(io.BytesIO(body), s, min(s + step, len(body)))]
            before += corpus.count_lines(io.BytesIO(body), s, min(s + step, len(body)))
        assert parts == whole


def test_line_numbers_of_split_files(spark, tmp_path):
    lines = ["", '{"a":1}', "{bad", '{"id":"k"}'] + [json.dumps({"n": i, "pad": "z" * (i % 50)}) for i in range(300)]
    (tmp_path / "g").mkdir()
    (tmp_path / "g/1.jsonl").write_text("\n".join(lines))
    (tmp_path / "g/2.jsonl").write_text('{"b":1}\n')
    rows = corpus.read_corpus(spark, str(tmp_path), splitbytes="500").collect()
    got = {r["native_id"]: json.loads(r["raw_json"]) for r in rows if r["source_file"] == "g/1.jsonl"}
    assert got["k"] == {"id": "k"} and got["g/1.jsonl:line=2"] == {"a": 1} and len(got) == 302
    assert all(got[f"g/1.jsonl:line={i + 5}"]["n"] == i for i in range(300))
    assert [r["native_id"] for r in rows if r["source_file"] == "g/2.jsonl"] == ["g/2.jsonl:line=1"]


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"{i:02}.xml").write_text(f"<V><n a='1'/><n>{i}</n></V>")
    df = corpus.read_corpus(spark, str(tmp_path))
    assert df.count() == 60 and df.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism + 1
    assert json.loads(df.where("native_id = '07'").first()["raw_json"]) == {"_root_tag": "V", "V": {"n": [{"@a": "1", "#text": ""}, "7"]}}


def test_streamed_array_equals_json(monkeypatch):
    values = [{"a": "x" * 40}, 12, [1, {"b": None}], "t,]", 3.25, True, {"é": " "}]
    monkeypatch.setattr(corpus, "_BLOCK", 7)
    got = [r for _, r, _ in corpus.read_json(io.BytesIO(json.dumps(values).encode()))]
    assert got == [v if isinstance(v, dict) else {"_value": v} for v in values]


def test_stream_adds_each_record_once(spark, tmp_path):
    folder = tmp_path / "in" / "grants"
    folder.mkdir(parents=True)
    (folder / "1.jsonl").write_text('{"id":"a"}\n{bad\n\n{"id":"b"}\n')
    run = lambda: ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (folder / "2.jsonl").write_text('{"id":"a"}\n{"id": "c"}\n{"n":1}\n')
    (folder / "x.json").write_text('[{"id":"j"}]')
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["native_id"] for r in got.collect()) == ["a", "b", "c", "grants/2.jsonl:line=3", "j"]
    assert corpus.load(corpus.read_corpus(spark, str(tmp_path / "in")), str(tmp_path / "out")) == 0


def test_windows_sessions_and_intervals(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:05:00", 2.0), (1, "2024-01-01 00:20:00", 3.0), (1, "2024-01-01 02:00:00", 4.0)], "k int, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["n"], r["total"]) for r in ingest.windowed_counts(rows, "ts", "k").collect()) == [(1, 4.0), (2, 5.0)]
    assert sorted(r["n"] for r in ingest.sessions(rows, "ts", "k").collect()) == [1, 2]
    other = rows.select("k", F.col("ts").alias("ts2"))
    assert ingest.interval_join(rows, other, "k", "ts", "ts2", "30 minutes").count() == 5
