import pickle

import pytest

from tolparse import catalog
from tolparse.grammar.analysis import EMPTY, Sets
from tolparse.grammar.dsl import read_grammar
from tolparse.grammar.model import Grammar, GrammarError, Options
from tolparse.parsing.engine import compile_grammar

HEAD = "A : 'a'\nB : 'b'\nC : 'c'\n"


@pytest.mark.parametrize("name", sorted(catalog.KINDS))
def test_catalogue_compiles_and_survives_pickling(name):
    parser = pickle.loads(pickle.dumps(catalog.grammar(name)))
    assert parser.parse("").lexed.tokens


@pytest.mark.parametrize("name", sorted(catalog.KINDS))
def test_json_replays_the_grammar(name):
    grammar = catalog.grammar(name).grammar
    assert Grammar.from_json(grammar.to_json()).to_json() == grammar.to_json()


def test_text_can_be_read_again():
    grammar, _ = read_grammar(HEAD + "P : %left A %right B\ns = 'x' (A | Any)* => al | AnyAvoid(C) B?\n%%\n%parsing {\n start s\n skip C\n}\n%nodes leaf s\n")
    again, messages = read_grammar(grammar.to_text())
    assert not messages and again.pairs == grammar.pairs and again.options.data == grammar.options.data
    assert [a.symbols for a in again.rules["s"].alternatives] == [a.symbols for a in grammar.rules["s"].alternatives]


@pytest.mark.parametrize("body, problem", [
    ("s = A", "no start symbol"), ("s = A D\n%%\n%parsing start s", "unknown symbol D"), ("s = s A | B\n%%\n%parsing start s", "left-recursive"), ("s = (A?)*\n%%\n%parsing start s", "repeats what may be empty"),
    ("s = A B | A C\n%%\n%parsing start s", "not LL(1)"), ("A : 'x'\ns = A\n%%\n%parsing start s", "defined again"), ("s = %markup(x) A\n%%\n%parsing start s", "cannot be local"),
    ("s = Any(Include(A), Avoid(A)) B\n%%\n%parsing start s", "share"), ("s = Any(Include(Q)) B\n%%\n%parsing start s", "unknown symbols Q"), ("s = A\n%%\n%parsing {\nstart s\nskip s\n}", "cannot be skipped"),
    ("P : %left A %right B\ns = C\n%%\n%parsing {\nstart s\nskip A\n}", "belongs to a pair"), ("P : %left A %right B\nQ : %left A %right C\ns = C\n%%\n%parsing start s", "two pairs"),
    ("s = A\n%%\n%parsing {\nstart s\nrecovery s\n}", "recovery is only for"), ("s = A => x | B => x\nt = C => x\n%%\n%parsing start s", "alias x"), ("s = A (\n%%\n%parsing start s", "found the end"), ("s = A =>\n%%\n%parsing start s", "ends too early"),
    ("s = A\n%%\n%parsing unknown s", "no option"), ("custom_block = A\n%%\n%parsing start custom_block", "reserved"),
])
def test_problems(body, problem):
    with pytest.raises(GrammarError, match=problem.replace("(", r"\(").replace(")", r"\)")):
        compile_grammar(HEAD + body)


def test_lr_problems_and_warnings():
    parser = compile_grammar(HEAD + "s = s A | B => x\n%%\n%parsing start s", "LR")
    assert any("no effect" in m.text for m in parser.messages)
    ambiguous = compile_grammar(HEAD + "s = A s | A s B s | C\n%%\n%parsing start s", "LR")
    assert any(m.kind == "warning" and "shift and reduce" in m.text for m in ambiguous.messages)
    with pytest.raises(GrammarError, match="two reductions"):
        compile_grammar(HEAD + "s = x | y\nx = A\ny = A\n%%\n%parsing start s", "LR")
    with pytest.raises(GrammarError, match="different arguments"):
        compile_grammar(HEAD + "s = AnyAvoid(A) B | AnyAvoid(C) B\n%%\n%parsing start s", "LR")


def test_consecutive_water():
    warnings = [m.text for m in compile_grammar(HEAD + "a = Any b c\nb = A |\nc = Any C\n%%\n%parsing start a").messages]
    assert warnings == ["Any in a may be followed by Any in c"]
    assert not compile_grammar(HEAD + "a = AnyExcept(C) c\nc = Any C\n%%\n%parsing start a").messages


def test_quantified_water_is_warned_about():
    assert any("is ignored" in m.text for m in compile_grammar(HEAD + "a = Any* C\n%%\n%parsing start a").messages)


def test_first_that_looks_past_water():
    grammar, _ = read_grammar(HEAD + "s = Any B | x C\nx = A |\n%%\n%parsing start s")
    sets = Sets(grammar)
    assert sets.firsts["s"] == {"Any", "A", "C"} and sets.water_firsts["s"] == {"Any", "A", "B", "C"}
    assert sets.first(["x"]) == {"A", EMPTY} and sets.terminals_of["s"] == {"Any", "A", "B", "C"} and sets.begins["s"] == {"x"}


def test_shown_names():
    grammar, _ = read_grammar(HEAD + "s = (A | 'lit')+ B?\n%%\n%parsing {\n start s\n userify(\"the b\") B\n}")
    assert [grammar.shown(x) for x in grammar.rules["s"].alternatives[0].symbols] == ["(A | 'lit')+", "B?"]
    assert grammar.shown("B") == "the b"


def test_bare_recovery_means_all_rules_that_begin_with_water():
    parser = compile_grammar(HEAD + "s = x y\nx = Any A\ny = B\n%%\n%parsing {\nstart s\nrecovery\n}")
    assert parser.grammar.recovery() == {"s", "x"}


def test_options():
    options = Options()
    options.set("Parsing", "Skip", ["A"], [1, "x"])
    copy = options.clone()
    options.clear("parsing", "skip")
    assert copy.is_set("parsing", "skip", "A") and copy.parameters("parsing", "skip", "A") == [1, "x"] and not options.is_set("parsing", "skip") and copy.symbols("parsing", "skip") == ["A"]


def test_tables_as_rows():
    assert ("s", "A", "A s B") in compile_grammar(HEAD + "s = A s B |\n%%\n%parsing start s").table.rows()
    rows = compile_grammar(HEAD + "s = A s B |\n%%\n%parsing start s", "LR").table.rows()
    assert any(cell == "accept" for *_, cell in rows) and any(cell.startswith("shift") for *_, cell in rows)


def test_lr_expects_what_may_follow_empty_water():
    table = compile_grammar(HEAD + "s = A x B\nx = Any y\ny = Any C |\n%%\n%parsing start s", "LR").table
    after_a = table.states[0].moves["A"]
    assert {"B", "C"} <= table.expected(after_a) and "A" not in table.expected(after_a)
    after_water = table.states[after_a].moves["Any"]
    assert {"B", "C"} <= table.expected(after_water)


def test_many_grammars_as_documents(spark):
    from tolparse.operators import grammars

    text = HEAD + "s = x B | Any C\nx = A |\nl = x l | C\n%%\n%parsing start s"
    docs = spark.createDataFrame([(1, text), (2, "s = = ;"), (3, None), (None, HEAD + "s = A\n%%\n%parsing start s")], "doc_id long, text string")
    rows = [tuple(r) for r in grammars.analysis(docs).collect()]
    of = lambda doc, kind: {(r[2], r[3]) for r in rows if r[:2] == (doc, kind)}
    sets = Sets(read_grammar(text)[0])
    assert of(1, "first") == {(r, s) for r, own in sets.firsts.items() for s in own - {EMPTY}} and of(1, "follow") == {(r, s) for r, own in sets.follows.items() for s in own}
    assert of(1, "reachable") == {(r, s) for r, own in sets.terminals_of.items() for s in own} and of(1, "left_recursive") == {("l", "l")}
    assert any("left-recursive" in t for _, t in of(1, "message")) and of(2, "error") and of(None, "first") == {("s", "A")}
    assert {r[0] for r in rows} == {1, 2, None} and grammars.analysis(docs.limit(0)).count() == 0


def test_words_are_searched_once_a_text(spark, sf_dir):
    """Within a piece of a grammar's text, the turn's words must not be searched again for each word."""
    from tolparse.plans.queries import turn_grammars

    optimized = turn_grammars(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert all("regexp_extract_all" not in line for line in optimized.split("\n") if "lambda" in line)


def test_only_wanted_rules_leave_the_workers(spark):
    from tolparse.operators import grammars

    docs = spark.createDataFrame([(1, HEAD + "s = x B\nx = A |\n%%\n%parsing start s")], "doc_id long, text string")
    got = {(r.kind, r.rule, r.symbol) for r in grammars.analysis(docs, ["first", "ll_cell"], only=lambda rule: rule == "x").collect()}
    assert got == {("first", "x", "A"), ("ll_cell", "x", "A"), ("ll_cell", "x", "B")}


def test_long_chains_of_rules():
    """A chain of rules in the order that rounds over all rules follow worst, with a cycle behind it."""
    names = [f"r{k * 7919 % 3001}" for k in range(3001)]
    text = HEAD + "".join(f"{a} = {b} B | A\n" for a, b in zip(names, [*names[1:], names[-2]], strict=True)) + f"%%\n%parsing start {names[0]}"
    sets = Sets(read_grammar(text)[0])
    assert sets.firsts[names[0]] == {"A"} and sets.follows[names[-1]] == {"B"} and sets.left_recursive == set(names[-2:])
