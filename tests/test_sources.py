import pytest

from tolparse import catalog, frames, streaming
from tolparse.sources import files, reports


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "src/deep").mkdir(parents=True)
    (tmp_path / "src/a.java").write_text("class A { int x; void f() { } }", encoding="utf-8")
    (tmp_path / "src/deep/b.java").write_bytes("class Б { }".encode("cp1251"))
    (tmp_path / "src/c.cs").write_bytes("﻿class C { }".encode("utf-16"))
    (tmp_path / "src/d.txt").write_text("no")
    return tmp_path


def test_decode():
    assert files.decode(b"\xef\xbb\xbfa") == "a" and files.decode("я".encode("cp1251")) == "я" and files.decode("я".encode()) == "я" and files.decode("a".encode("utf-16")) == "a" and files.decode(b"") == ""


RUSSIAN = "// Возвращает имя файла, если он есть\nvoid F() { Print(\"Привет, мир!\"); }\n"


@pytest.mark.parametrize("text, name", [
    *((RUSSIAN, n) for n in ("cp1251", "koi8-r", "cp866", "iso8859-5", "utf-8", "utf-16-le", "utf-16-be", "utf-16")), ("// Élève: où est-il passé, naïf garçon? Über große Straßen", "cp1252"), ("int año; // señal", "cp1252"), ("plain", "utf-8"), ("ж", "cp1251"), ("", "utf-8"),
])
def test_charsets(text, name):
    assert files.decode(text.encode(name)) == text


def test_read_files(spark, folder):
    java = files.read_files(spark, str(folder / "src"), ".java")
    assert sorted(r.text for r in java.collect()) == ["class A { int x; void f() { } }", "class Б { }"]
    assert files.read_files(spark, str(folder / "src"), "*.java, .cs").count() == 3
    assert files.read_files(spark, str(folder / "none"), ".java").count() == 0


def test_entity_report_round_trip(spark, folder):
    docs = files.read_files(spark, str(folder / "src"), "java")
    found = frames.entities(docs, catalog.grammar("java"), ["class", "field", "method"])
    path = str(folder / "report")
    reports.write_entity_report(found, docs, path, "java", "src")
    again = reports.read_entity_report(spark, path)
    assert sorted((r.type, r.value) for r in again.collect()) == sorted((r.type, r.value) for r in found.collect())
    lines = spark.read.text(f"{path}/header").collect()
    assert [r.value for r in lines] == ["java", "src"]


def test_value_report(spark, tmp_path):
    (tmp_path / "class_tolerant.txt").write_text("***\nf1\nA\nB\n***\nf2\n***\nf3\nC")
    got = sorted((r.file, r.value) for r in reports.read_value_report(spark, str(tmp_path / "class_tolerant.txt")).collect())
    assert got == [("f1", "A"), ("f1", "B"), ("f3", "C")]


def test_sinks(spark, folder):
    docs = files.read_files(spark, str(folder / "src"), "java")
    found = frames.entities(docs, catalog.grammar("java"), ["class", "method"])
    reports.write_by_type(found, str(folder / "types"))
    assert sorted(p.name for p in (folder / "types").iterdir() if p.is_dir()) == ["type=class", "type=method"]
    reports.write_stats(frames.stats(docs, catalog.grammar("java")), str(folder / "stats"))
    reports.write_stats(frames.stats(docs, catalog.grammar("java")), str(folder / "stats"))
    assert spark.read.json(str(folder / "stats")).count() == 2
    reports.write_differences(found, found.limit(0), str(folder / "diff"))
    assert spark.read.parquet(str(folder / "diff/left")).count() == 3  # A, f and Б
    assert reports.table_frame(spark, catalog.grammar("java").table).filter("cell like '%class%'").count() > 0


def test_stream(spark, folder):
    docs = streaming.document_stream(spark, str(folder / "src"), "*.java")
    found = streaming.entity_stream(docs, catalog.grammar("java"), ["class", "method"])
    q = found.writeStream.format("memory").queryName("entities_seen").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.type for r in spark.table("entities_seen").collect()).count("method") == 1


def test_counts_by_window(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = streaming.counts_by_window(stream, "ts", "event_type", "1 day", "1 day").writeStream.format("memory").queryName("windows_seen").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows_seen").agg({"n": "sum"}).first()[0] == events.count()


def report_file(path, blocks, end="\n", last=True):
    text = end.join(line for b in blocks for line in ("***", *b)) + (end if last else "")
    path.write_bytes(text.encode())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("last", [True, False])
def test_reports_are_cut_at_marks_alone(spark, tmp_path, end, last):
    blocks = [["f1", "class", "A***", "method", "***b"], [], ["f2"], ["f3", "field", "***", "x", "y"][:3], ["f4", "class", "Z"]]
    report_file(tmp_path / "a.txt", [["f1", "class", "A***", "method", "***b"], [], ["f2"], ["f4", "class", "Z"]], end, last)
    got = sorted((r.file, r.seq, r.type, r.value) for r in reports.read_entity_report(spark, str(tmp_path / "a.txt")).collect())
    assert blocks and got == [("f1", 0, "class", "A***"), ("f1", 1, "method", "***b"), ("f4", 0, "class", "Z")]


def test_one_long_report_is_read_by_many_tasks(spark, tmp_path):
    """The same rows, however small the splits are."""
    blocks = [[f"f{k}", *(x for j in range(k % 7) for x in (f"t{j}", f"value {k} {j} " * (k % 11)))] for k in range(3000)]
    report_file(tmp_path / "a.txt", blocks)
    want = sorted((b[0], j, b[1 + 2 * j], b[2 + 2 * j]) for b in blocks for j in range(len(b) // 2))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("1000b", "64k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = reports.read_entity_report(spark, str(tmp_path / "a.txt"))
            assert found.rdd.getNumPartitions() > 5
            assert sorted((r.file, r.seq, r.type, r.value) for r in found.collect()) == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_value_report_round_trip_and_comparison(spark, tmp_path):
    rows = [(k, "class_tolerant" if k % 2 else "class_baseline", f"f{j}", k, f"v{k // 2 if k < 8 else k}") for k in range(10) for j in range(3)]
    df = spark.createDataFrame(rows, "n int, type string, file string, seq int, value string")
    reports.write_value_report(df, str(tmp_path / "r"))
    back = reports.read_value_report(spark, [str(p) for p in (tmp_path / "r").iterdir() if p.is_dir()])
    assert sorted((r.file, r.value) for r in back.collect()) == sorted((r[2], r[4]) for r in rows)
    reports.compare_reports(spark, str(tmp_path / "r/type=class_baseline"), str(tmp_path / "r/type=class_tolerant"), str(tmp_path / "d"))
    side = lambda name: sorted((r.file, r.value) for r in spark.read.parquet(str(tmp_path / "d" / name)).collect())
    assert side("left") == [(f"f{j}", "v8") for j in range(3)] and side("right") == [(f"f{j}", "v9") for j in range(3)]
