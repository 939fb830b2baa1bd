"""Lexers as Spark expressions: the proof lets through what it should, and the tokens are the lexer's."""

import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tolparse import catalog, frames
from tolparse.parsing import flat
from tolparse.parsing.engine import compile_grammar

HEAD = "\n\ntext = (A | B | Any)*\n\n%%\n%parsing start text"


@pytest.mark.parametrize(("tokens", "ok"), [
    ("A : [a-z]+\nB : [0-9]+", True), ("A : [a-z]+\nB : [a-z0-9]+", False), ("A : 'a'\nB : 'a' 'b'", False), ("A : '<!' .*? '>'\nB : '<' ~[>]* '>'", True), ("A : '<' ~[>]* '>'\nB : '<!' .*? '->'", False),
    ("A : 'ab' [x]*\nB : 'ac' ~[x]*", True), ("A : ('a' | 'b')+\nB : 'c'", True), ("A : ('a' | 'bb')+\nB : 'c'", False), ("A : [a]*\nB : 'c'", False), ("A : '>'\nB : '<' ~[>]* '>'", True), ("A : [a-z] '>'\nB : [a-f] [a-f] ~[>]* '>'", True), ("A : [a-z] [a-z] '>'\nB : [a-f] [a-f] [a-f] ~[>]* '>'", True), ("A : [a-z]+ '>'\nB : [a-f] [a-f] [a-f] ~[>]* '>'", False), ("A : %linestart 'a'\nB : 'b'", False),
])
def test_proof(tokens, ok):
    assert (flat.expression(compile_grammar(tokens + HEAD).lexer) is not None) == ok


def test_catalogue():
    assert [n for n in catalog.KINDS if flat.expression(catalog.grammar(n).lexer)] == ["html_tags", "consecutive_water", "words"]


GRAMMARS = [catalog.grammar("html_tags"), catalog.grammar("words"), *(compile_grammar(t + HEAD) for t in ("A : '<!' .*? '>'\nB : '<' ~[>]* '>'", "A : [a-c]+\nB : '-' [0-9]*", "A : '(' ~[)]* ')'\nB : [a-z] ~[x]"))]


def same(grammar, text):
    pattern = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", flat.expression(grammar.lexer))
    found = [m[0] for m in re.finditer(pattern, text)]
    assert found == [t.text for t in grammar.lexer.scan(text)[:-1]]


@given(st.text(alphabet="<>!-/abcx19() \n é🙂", max_size=40), st.sampled_from(range(len(GRAMMARS))))
def test_expression_finds_the_lexer_s_tokens(text, k):
    same(GRAMMARS[k], text)


def test_spark_finds_the_same(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["<", ">", "<!--", "-->", "<script", "</script>", "<style>", "</style>", "<a b>", "</a", "x", "é", "🙂", "\n", " ", "-", "!", "(", ")", "12"]) for _ in range(rng.choice([0, 5, 60]))) for _ in range(60)]
    texts += ["<script>" + "x" * 200_000, "<" * 3000, "a" * 100_000]
    docs = spark.createDataFrame([*enumerate(texts), (None, "null <id>"), (5, None)], "doc_id long, text string")
    for grammar in GRAMMARS:
        plain = frames.plain_tokens(docs, grammar)
        assert "MapInArrow" not in plain._jdf.queryExecution().executedPlan().toString()
        assert sorted(plain.collect(), key=repr) == sorted(frames.tokens(docs, grammar).select("doc_id", "tok_idx", "name", "text").collect(), key=repr)
    java = frames.plain_tokens(docs, catalog.grammar("java"))
    assert "MapInArrow" in java._jdf.queryExecution().executedPlan().toString()
