import pytest
from pyspark.sql import functions as F

from tolparse import catalog, frames
from tolparse.operators import baselines, compare
from tolparse.parsing import visitors

PASCAL = """procedure a; forward;
procedure b(x: integer);
  function c: integer;
  begin y := 1; end;
begin z; end;
procedure d; external;
begin w; end.
"""


def test_routines_take_their_parts():
    parser = visitors.with_visitors(catalog.grammar("pascal"), visitors.aggregate_routines)
    root = parser.parse(PASCAL).root
    name = lambda n: next("".join(c.value) for c in n.children if c.type == "name")
    top = [n for n in root.children if n.type == "routine"]
    assert [name(n) for n in top] == ["a", "b", "d"]
    b = top[1]
    inner = [n for n in b.children if n.type in ("routine", "block")]
    assert [n.type for n in inner] == ["routine", "block"] and name(inner[0]) == "c" and inner[0].children[-1].type == "block"
    assert PASCAL[b.span()[0] : b.span()[1] + 1].startswith("procedure b") and PASCAL[b.span()[0] : b.span()[1] + 1].endswith("begin z; end;")
    assert [n.type for n in root.children if n.type == "block"] == ["block"]


def test_stack_of_owners():
    kinds = ["x", "r", "m", "r", "b", "b", "b"]
    assert visitors.owners_by_stack(kinds, lambda i: kinds[i] == "r", lambda i: kinds[i] == "b") == [None, None, 1, 1, 3, 1, None]


@pytest.mark.parametrize("part, expected", [("int a; int b;", True), ("a; int b;", False), ("class A { int a; int b; }", True), ("nt a; in", False), ("a", True)])
def test_can_wrap(part, expected):
    text = "class A { int a; int b; }"
    at = text.index(part)
    root = catalog.grammar("java").parse(text).root
    assert visitors.can_wrap(root, at, at + len(part) - 1) == expected


CODE = {
    "java": ("// class No { }\npublic class A { int x = 1, y; String s = \"class Z {\"; void f(int a) { return; } enum E { P } }", [("class", "A"), ("enum", "E"), ("field", "s"), ("field", "x"), ("method", "f")]),
    "csharp": ("class A { public int P { get; set; } private readonly int f = 3, g; void M() { x(); } enum E { Q } } struct S { int h; } interface I { int K(); }", [("class", "A"), ("enum", "E"), ("field", "f"), ("field", "h"), ("interface", "I"), ("method", "K"), ("method", "M"), ("property", "P"), ("struct", "S")]),
    "pascal": ("{ procedure no; } type T = class end; PROCEDURE P; property Q: integer;", [("class", "T"), ("property", "Q"), ("routine", "P")]),
}


@pytest.mark.parametrize("language", sorted(CODE))
def test_baselines(spark, language):
    text, want = CODE[language]
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert sorted((r.type, r.value) for r in baselines.baseline(docs, language).collect()) == want


def test_comparison_with_a_baseline(spark):
    docs = spark.createDataFrame([(1, CODE["csharp"][0])], "doc_id long, text string")
    parsed = frames.entities(docs, catalog.grammar("csharp"), ["class", "struct", "interface", "enum", "method", "property", "field"]).withColumn("value", F.split("value", " ")[0]).select("doc_id", "type", "value")
    left, right = compare.difference(parsed, baselines.baseline(docs, "csharp"))
    assert left.count() == right.count() == 0
