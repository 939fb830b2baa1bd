import pickle

import pytest

from tolparse import catalog, frames
from tolparse.operators import preprocess
from tolparse.parsing import engine, visitors
from tolparse.parsing.lexer import Lexer
from tolparse.plans import queries

CSHARP = "#{} A\n#if A && !B || C\n{}\n#elif B\nnever\n#else\nother\n#endif\n"
ODD = ["", "}", "x", "a; (b", "#if A\n#if B\nx", "class {", "int a;\n/// begin u\nint b;\nx y\n/// end\nint ;", "procedure p(a: integer); begin x; end; end.", "{$ifdef A}b{$else}", "(w; w); [w! w]; )"]


@pytest.fixture
def parses(monkeypatch):
    """How many tokens the parser was run on."""
    met = []
    for run in (engine._RunLL, engine.Silent):
        monkeypatch.setattr(run, "step", lambda self: (met.append(self.at), engine._Run.step(self))[1], raising=False)
    monkeypatch.setattr(engine._RunLL, "apply", lambda self, a, f=engine._RunLL.apply: (met.append(self.at), f(self, a))[1])
    return met


def shape(parsed):
    nodes = [(n.symbol, n.alias, n.shown, n.options, n.arguments, len(n.children), n.value, n.span()) for n in parsed.root.walk()] if parsed.root else None
    return nodes, parsed.messages, parsed.statistics.recovery_times, parsed.statistics.recovery_times_any, parsed.statistics.longest_rollback


def whole(parser, text, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(parser.pieces, "loop", None)
        return parser.parse(text)


def test_conditional_compilation_parses_a_piece_once(parses):
    """Before, the parser ran over all tokens of all texts, however often it had met the same."""
    parser = catalog.grammar("csharp_directives")
    text = "".join(CSHARP.format("define" if k % 2 else "undef", f"word{k}") for k in range(200))
    first = preprocess.excluded_by_directives(text, parser)
    assert len(first) == 200 and len(parses) < 1000
    parses.clear()
    assert preprocess.excluded_by_directives(text * 2, parser) == first + [(a + len(text), b + len(text)) for a, b in first]
    assert len(parses) < 1000


def test_directives_from_pieces_are_those_of_the_tree(monkeypatch):
    for name, texts in (("csharp_directives", [CSHARP.format("define", "w"), "#if A\n#define B\n#if !(B)\nx\n#endif\n#elif true\ny"]), ("pascal_directives", ["{$define A}{$ifdef A}b {$else}c {$endif}", "(*$ifndef A*)x(*$endif*) {n} 'q' {$R+}"])):
        parser = catalog.grammar(name)
        for t in [*texts, *ODD]:
            found = preprocess.excluded_by_directives(t, parser, ["C"])
            with monkeypatch.context() as m:
                m.setattr(parser.pieces, "loop", None)
                assert preprocess.excluded_by_directives(t, parser, ["C"]) == found


@pytest.mark.parametrize("name", ["csharp_directives", "pascal_directives", "pascal", "java", "html_tags", "markdown", "typescript", "xml"])
def test_trees_of_pieces_are_those_of_whole_texts(name, monkeypatch):
    parser = catalog.grammar(name)
    texts = [CSHARP.format("define", "w") * 3, "procedure p(a: integer); begin x; end;\nfunction q: integer; forward;\nend;" * 2, "class A { int f = 1; }\n" * 3, "<a><b>c</b></a>" * 3, "# a\nb\n## c\n", *ODD]
    for t in texts:
        assert shape(parser.parse(t)) == shape(whole(parser, t, monkeypatch)), t


def test_trees_with_blocks_and_water_between_pieces(monkeypatch):
    for parser in (queries.code(), queries.groups(), engine.compile_grammar("W : [a-z]+\nf = (W '.' | Any)*\n%%\n%parsing start f")):
        for t in [*ODD, "/// begin a\nint a;\n/// end\nint b;\n" * 3, "group x end; int y; q;", "a. ? ! b. ?"]:
            assert shape(parser.parse(t)) == shape(whole(parser, t, monkeypatch)), t


def test_longest_match_and_first_rule_on_ties():
    lexer = Lexer(engine.compile_grammar("A : 'a' | 'ab'\nB : 'abc'\nC : [a-c]+\nD : 'abcd' | 'b' ~[x]\n\nf = Any\n%%\n%parsing start f").grammar)
    assert [(t.name, t.text, t.line, t.column) for t in lexer.scan("ab abc\nabca abcd b\n c")] == [
        ("A", "ab", 1, 0), ("B", "abc", 1, 3), ("C", "abca", 2, 0), ("D", "abcd", 2, 5), ("D", "b\n", 2, 10), ("C", "c", 3, 1), ("EOF", "", 3, 2),
    ]


def test_a_used_parser_can_be_sent_to_workers():
    parser = engine.compile_grammar("W : [a-z]+\nf = (W | Any)*\n%%\n%parsing start f")
    parser.parse("a ? b")
    assert shape(pickle.loads(pickle.dumps(parser)).parse("a ? b")) == shape(parser.parse("a ? b"))


def test_counts_of_several_parsers_from_one_pass(spark, monkeypatch):
    """Before, each form of water read and scanned all texts anew, and the counts were joined."""
    texts = ["(a; b); [c! d]; ", "", "(a; b", "!;;!", "a; ] b;", *ODD]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parsers = {w.split("(")[0]: queries._item_parser(w) for w in queries._WATERS}
    got = {r.doc_id: tuple(r)[1:] for r in frames.node_counts(docs, parsers, "item").collect()}
    count = lambda p, t: sum(n.symbol == "item" for n in whole(p, t, monkeypatch).root.walk())
    assert got == {k: tuple(count(p, t) for p in parsers.values()) for k, t in enumerate(texts)}
    scanned = []
    monkeypatch.setattr(Lexer, "scan", lambda self, text, f=Lexer.scan: (scanned.append(text), f(self, text))[1])
    monkeypatch.setattr(frames, "per_document", lambda docs, rows, schema: list(rows(1, texts[0])))
    assert frames.node_counts(None, parsers, "item") == [(1, 2, 3, 2, 2)] and len(scanned) == 2


def test_routines_are_counted_in_the_pass_that_parses(spark):
    """Before, texts were parsed twice, and routines and what they hold were sorted, grouped and joined."""
    text = "procedure p(a: integer); function q: integer; begin y := 1; end; begin z; end;\nprocedure r; forward;\n"
    docs = spark.createDataFrame([(1, text), (1, text), (2, None), (3, "")], "doc_id long, text string")
    found = frames.entities_holding(docs, visitors.with_visitors(catalog.grammar("pascal"), visitors.aggregate_routines), ["routine"], ["block", "routine"])
    assert sorted((r.doc_id, r.value, r.block, r.routine) for r in found.collect()) == sorted([(1, "p", 1, 1), (1, "q", 1, 0), (1, "r", 0, 0)] * 2)
    plan = queries.routine_visitor(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("MapInArrow") == 1
