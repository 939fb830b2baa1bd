"""One parse, all outputs; a batch's table, totals and reports."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from tolparse import catalog, frames
from tolparse.operators import batch, entities
from tolparse.sources import reports, shared

TEXTS = [(1, "class A { int x, y; void f() { } }", "a.java"), (2, None, "b.java"), (3, "", "c.java"), (4, "class B { ) }", "d.java"), (4, "class C { int int; void g() { } }", "e.java"), (None, "enum D { P }", "f.java")]
TYPES = ["class", "enum", "method", "field"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*t, "clash") for t in TEXTS], "doc_id long, text string, path string, stats string")


def as_rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_outcomes_equal_the_single_passes(docs):
    parser = catalog.grammar("java")
    found = frames.outcomes(docs, parser, ["stats", "messages", "entities", "nodes"], TYPES)
    assert found.count() == len(TEXTS) and found.columns == ["doc_id", "text", "path", "has_error", "stats", "messages", "entities", "nodes"]
    plain = docs.drop("stats")
    for what, single in (("messages", frames.messages(plain, parser)), ("entities", frames.entities(plain, parser, TYPES)), ("nodes", frames.nodes(plain, parser))):
        own = found.select("doc_id", F.explode(what).alias("x")).select("doc_id", "x.*")
        assert own.columns == single.columns and [f.dataType for f in own.schema] == [f.dataType for f in single.schema]
        assert sorted(map(repr, own.collect())) == sorted(map(repr, single.collect()))
    counted = ("doc_id", "chars_count", "tokens_count", "recovery_times", "has_error")
    assert as_rows(found.filter("stats is not null").select("doc_id", "stats.*"), *counted) == as_rows(frames.stats(plain, parser), *counted)


def test_split_keeps_every_row_and_parses_once(docs):
    good, bad = entities.split_by_outcome(frames.outcomes(docs, catalog.grammar("java")))
    assert as_rows(good, "path") == [(p,) for p in ("a.java", "b.java", "c.java", "e.java", "f.java")] and as_rows(bad, "path") == [("d.java",)]
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Exchange" not in plan


def test_batch(spark, docs, tmp_path):
    parser = catalog.grammar("java")
    done = batch.run(docs, parser, TYPES, str(tmp_path / "run"), nodes=True, tag="java-batch")
    assert not spark.sparkContext.getJobTags()
    plain = docs.drop("stats")
    want = frames.stats(plain, parser).filter("not has_error").agg(*(F.sum(c).alias(c) for c in ("chars_count", "tokens_count", "recovery_times"))).first().asDict()
    assert done.totals["documents"] == len(TEXTS) and done.totals["failed"] == 1 and done.totals["general_ms"] > 0
    assert {k: done.totals[k] for k in want} == want and done.totals_frame().first().asDict() == done.totals
    assert as_rows(done.counts(), "type", "n") == as_rows(entities.count_by_type(frames.entities(plain, parser, TYPES)), "type", "n")
    assert [(r.path, r.error.type) for r in done.failed.collect()] == [("d.java", "error")]
    assert done.nodes.count() == frames.nodes(plain, parser).count() and done.most("tokens_count", 1).first().doc_id == 1
    assert done.slowest().count() == 4 and done.longest_recoveries().count() == 4 and done.messages.count() == frames.messages(plain, parser).count()
    done.write_reports(str(tmp_path / "out"), "java", "src")
    back = reports.read_entity_report(spark, str(tmp_path / "out/entities"))
    assert as_rows(back, "file", "type", "value") == sorted([("a.java", "class", "A"), ("a.java", "field", "x y"), ("a.java", "method", "f"), ("e.java", "class", "C"), ("e.java", "field", "int"), ("e.java", "method", "g"), ("f.java", "enum", "D")])
    assert spark.read.json(str(tmp_path / "out/stats")).count() == 4 and "d.java" in json.dumps([r.asDict(True) for r in spark.read.json(str(tmp_path / "out/failed")).collect()])


def test_batch_of_nothing(docs, tmp_path):
    done = batch.run(docs.limit(0), catalog.grammar("java"), TYPES, str(tmp_path / "none"))
    assert done.totals["documents"] == done.totals["chars_count"] == 0 and done.counts().count() == done.failed.count() == 0


def test_a_running_batch_can_be_ended(spark, tmp_path):
    many = spark.range(64).select(F.col("id").alias("doc_id"), F.repeat(F.lit("class A { int x; void f() { x = 1; } }\n"), 20_000).alias("text")).repartition(64)
    threading.Timer(3, batch.cancel, (spark, "endless")).start()
    with pytest.raises(Exception, match="(?i)cancel"):
        batch.run(many, catalog.grammar("java"), TYPES, str(tmp_path / "ended"), tag="endless")
    assert not spark.sparkContext.getJobTags()


def test_shared_folders(spark):
    one, two = (shared.shared_folder(spark, "x") for _ in range(2))
    assert one != two and one.rpartition("/")[0] == two.rpartition("/")[0]
