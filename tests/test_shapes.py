"""Texts of one shape share a parse (F33), and what comes of them is what a parse of each gives."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tolparse import catalog, frames
from tolparse.parsing import shapes
from tolparse.parsing.shapes import Shapes
from tolparse.plans import queries

NAMES = frozenset(["name"])
WORDS = '{ } ( ) [ ] ; : , "s" "tt" 1 22 int class x Abc begin end group | = true null void'.split(" ") + ["\n", "é"]


def assert_equal(parser, found, text, tree=True):
    parsed = parser.parse(text, tree or None)
    s, failed, messages, entities = found
    counts = lambda s: (s.chars_count, s.tokens_count, s.recovery_times, s.recovery_times_any, s.longest_rollback)
    assert counts(s) == counts(parsed.statistics) and failed == parsed.has_error and s.general_ms > 0
    assert messages == shapes.message_rows(parsed.messages)
    assert entities == ([] if failed or not tree else list(frames.entity_rows(parsed, frozenset(parser.grammar.rules), NAMES)))


@pytest.mark.parametrize("name", ["json_ll", "json_lr", "groups", "bars", "csharp_members", "java_lr", "pascal", "xml", "words"])
def test_as_a_parse_of_each(name):
    parser = getattr(queries, name)() if hasattr(queries, name) else catalog.grammar(name)
    random.seed(3)
    texts = ["", '{"k": 1}', '{"kk":\n22}', '"k": 1}', '{"a": {"b": [1, {"c": 2}]}}', '{"a": [}', '{"a": 1', "class A { void f(int x) { } }", "class Bcd {\n\nvoid ff ( int yy ) { } }", "class A { ) }"]
    texts += [random.choice([" ", "  "]).join(random.choice(WORDS) for _ in range(random.randint(1, 20))) for _ in range(200)]
    for tree in (True, False):
        own = Shapes(parser, parser.grammar.rules, NAMES, tree)
        for text in texts * 2:
            assert_equal(parser, own(text), text, tree)


def test_one_parse_for_records_of_one_schema(monkeypatch):
    """Before, each record was parsed, whatever its shape."""
    parser = queries.json_ll()
    parses, parse = [], type(parser).parse_tokens
    monkeypatch.setattr(type(parser), "parse_tokens", lambda *a, **k: parses.append(1) or parse(*a, **k))
    own = Shapes(parser, ["member"])
    assert [own(f'{{"k{n}": {n}}}')[3] for n in range(500)] == [[(0, "member", f'"k{n}"')] for n in range(500)] and len(parses) == 1


def test_bounds(monkeypatch):
    """Long texts are parsed as they are; of short ones only so many shapes are kept."""
    parser = queries.json_ll()
    monkeypatch.setattr(shapes, "LONGEST", 30)
    monkeypatch.setattr(shapes, "SHAPES", 4)
    own = Shapes(parser, parser.grammar.rules, NAMES)
    for n in [*range(12), 3, 11, 0]:
        text = "{" + ", ".join(f'"k{k}": {k}' for k in range(n)) + "}"
        assert_equal(parser, own(text), text)
        assert len(own.known) <= 4 and all(len(key) <= 30 for key in own.known)


def test_blocks_and_visitors_need_the_texts():
    assert Shapes.fit(queries.json_ll()) and not Shapes.fit(queries.code()) and not Shapes.fit(catalog.grammar("java"))


def test_outcomes_by_shape_equal_the_single_passes(spark):
    parser = queries.json_ll()
    docs = spark.createDataFrame([(1, '{"a": 1, "b": {"c": 2}}'), (2, '{"dd": 10, "e":\n{"f": 33}}'), (3, '"a": 1}'), (4, None), (5, ""), (6, '"bb": 2}')], "doc_id long, text string")
    found = frames.outcomes(docs, parser, ["stats", "messages", "entities"], ["member"])
    for what, single in (("messages", frames.messages(docs, parser)), ("entities", frames.entities(docs, parser, ["member"]))):
        own = found.select("doc_id", F.explode(what).alias("x")).select("doc_id", "x.*")
        assert sorted(map(repr, own.collect())) == sorted(map(repr, single.collect()))
    counted = ("doc_id", "chars_count", "tokens_count", "recovery_times", "has_error")
    assert sorted(found.filter("stats is not null").select("doc_id", "stats.*").select(*counted).collect()) == sorted(frames.stats(docs, parser).select(*counted).collect())


def test_short_texts_go_in_larger_batches():
    """Before, 64 documents made a batch, however short."""
    sizes = lambda texts: [p.num_rows for p in frames.slices(pa.RecordBatch.from_pydict({"text": texts}), 0)]
    assert sizes(["{}"] * 2500) == [1024, 1024, 452] and sizes([]) == []
    assert sizes(["{}"] * 1024 + ["x" * 1000] * 130) == [1024, 64, 64, 2]
