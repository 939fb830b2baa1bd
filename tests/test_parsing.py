import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tolparse import catalog
from tolparse.grammar.model import Message
from tolparse.parsing.engine import compile_grammar
from tolparse.parsing.lexer import Lexer, _may_begin
from tolparse.parsing.tree import Node


def shape(node, depth=9):
    if not node.children:
        return node.type
    return (node.type, *(shape(c, depth - 1) for c in node.children))


def found(grammar, text, *types):
    p = catalog.grammar(grammar).parse(text)
    assert not p.has_error, p.messages
    return [(n.type, " ".join("".join(c.text()) for c in n.children if c.type == "name")) for n in p.root.walk() if n.type in types]


def compiled(rules, kind="LL", options="", terminals="A : 'a'\nB : 'b'\nC : 'c'\nD : 'd'\n"):
    return compile_grammar(f"{terminals}{rules}\n%%\n%parsing {{\nstart s\n{options}\n}}", kind)


# lexing ------------------------------------------------------------------------------------------------------------


def lexed(terminals, text, options=""):
    grammar = compile_grammar(f"{terminals}\ns = Any\n%%\n%parsing {{\nstart s\n{options}\n}}").grammar
    return [(t.name, t.text) for t in Lexer(grammar).scan(text)[:-1]]


def test_longest_match_then_first():
    assert lexed("X : 'ab'\nY : [a-z]+\nZ : 'abc'", "ab abc abcd") == [("X", "ab"), ("Y", "abc"), ("Y", "abcd")]


def test_patterns():
    assert lexed("N : [0-9]+ ('.' [0-9]+)?", "12.5 3.x") == [("N", "12.5"), ("N", "3"), ("UNDEFINED", "."), ("UNDEFINED", "x")]
    assert lexed("C : '/*' .*? '*/'", "/* a */ /* b */") == [("C", "/* a */"), ("C", "/* b */")]
    assert lexed(r"U : 'A' [а-я\-\]]+", "Aя-]") == [("U", "Aя-]")]
    assert lexed("Q : '(' (Q | ~[()])* ')'", "(a(b)c)") == [("Q", "(a(b)c)")]
    assert lexed("K : 'a' | 'ab' | 'abc'", "abc") == [("K", "abc")]
    assert lexed("K : 'ab'? 'x' ('y' | 'z')?", "x abx xz") == [("K", "x"), ("K", "abx"), ("K", "xz")]
    assert lexed("K : [ab]* 'c'\nL : ('+' | '-')+ [0-9]", "c abc +-1") == [("K", "c"), ("K", "abc"), ("L", "+-1")]


def test_line_start_ignore_case_fragment_undefined():
    assert lexed("H : %linestart '#' ~[\\n]*\nX : [a-z#]+", "# a\nb #c\n#d") == [("H", "# a"), ("X", "b"), ("X", "#c"), ("H", "#d")]
    assert lexed("K : 'begin' [A-Z]", "BeginA beginb", "ignorecase") == [("K", "BeginA"), *[("UNDEFINED", c) for c in "beginb"]]
    assert lexed("W : L+\nL : [a-z]", "ab1c", "fragment L\nignoreundefined") == [("W", "ab"), ("W", "c")]


def test_places():
    t = Lexer(catalog.grammar("words").grammar).scan("ab\n cd")[1]
    assert (t.start, t.end, t.line, t.column) == (4, 5, 2, 1)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab{}()[] \n\"'/*<>=;#.é", max_size=60), st.sampled_from(["csharp", "java_lr", "xml", "markdown", "html_tags", "pascal"]))
def test_tokens_and_gaps_are_the_text(text, name):
    lexer = catalog.grammar(name).lexer
    at = 0
    for t in lexer.scan(text)[:-1]:
        assert t.start >= at and text[t.start : t.end + 1] == t.text
        at = t.end + 1
    assert all(t.depth >= 0 for t in lexer(text).tokens)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["class", "A", "{", "}", "(", ")", ";", "int", "x", "=", "public", ",", "<", ">", "enum", "import"]), max_size=25), st.sampled_from(["csharp", "csharp_lr", "java", "java_lr"]))
def test_parsing_always_ends_with_spans_inside_their_parents(tokens, name):
    p = catalog.grammar(name).parse(" ".join(tokens))
    for n in p.root.walk() if p.root else ():
        own = n.span()
        for c in n.children:
            if own and (s := c.span()):
                assert own[0] <= s[0] and s[1] <= own[1]


# nesting -----------------------------------------------------------------------------------------------------------

BRACES = "X : [a-z]+\nP : %left '{' %right '}'\nQ : %left '[' %right ']'\nF : %left T %right T\nT : '~'\n"


def nested(text):
    parser = compile_grammar(BRACES + "s = Any\n%%\n%parsing start s")
    return parser.lexer(text)


def test_depth():
    assert [t.depth for t in nested("a { b { c } d } e").tokens[:-1]] == [0, 0, 1, 1, 2, 2, 1, 1, 0]
    assert [t.direction for t in nested("{ ~ a ~ }").tokens[:-1]] == ["down", "down", "forward", "up", "up"]


@pytest.mark.parametrize("text, kinds, last", [("a }", ["error"], "ERROR"), ("{ ]", ["error"], "ERROR"), ("{ {", ["warning", "warning"], "EOF"), ("{ a }", [], "EOF")])
def test_pair_errors(text, kinds, last):
    out = nested(text)
    assert [m.kind for m in out.messages] == kinds and out.tokens[-1].name == last


# water -------------------------------------------------------------------------------------------------------------


def test_water_stops_and_arguments():
    assert shape(compiled("s = Any B").parse("a c b").root) == ("s", "Any", "B")
    assert compiled("s = Any B").parse("a c b").root.children[0].value == ["a", "c"]
    assert compiled("s = AnyInclude(B) C").parse("a b a c").root.children[0].value == ["a", "b", "a"]
    assert compiled("s = AnyExcept(D) D").parse("a b d").root.children[0].value == ["a", "b"]
    assert compiled("s = AnyAvoid(C) B").parse("a c b").has_error
    assert compiled("s = Any B").parse("b").root.children[0].span() is None


def test_water_and_pairs():
    rules, terminals = "s = '(' Any ')'", "A : 'a'\nP : %left '(' %right ')'\nS : %left '[' %right ']'\n"
    p = compiled(rules, terminals=terminals).parse("( a ( a ) [ ) ] )")
    assert p.has_error  # ) closes where [ is open
    p = compiled(rules, terminals=terminals).parse("( a ( a ) [ a ] )")
    assert p.root.children[1].value == ["a", "(", "a", ")", "[", "a", "]"] and not p.has_error
    assert compiled("s = AnyIgnorePairs 'x' Any", terminals="A : 'a'\nP : %left '(' %right ')'\n").parse("( x )").root.children[0].value == ["("]


@pytest.mark.parametrize("kind", ["LL", "LR"])
def test_skipped_tokens_stay_in_water(kind):
    p = compiled("s = A Any B", kind, "skip D").parse("d a d c d b d")
    assert not p.has_error and p.root.children[1].value in (["d", "c", "d"], ["c", "d"])
    assert [n.symbol for n in p.root.children] == ["A", "Any", "B"]


@pytest.mark.parametrize("kind", ["LL", "LR"])
def test_recovery(kind):
    rules = "s = item*\nitem = A B ';' | Any ';'"
    p = compiled(rules, kind, "recovery item").parse("a b ; a ; a b ;")
    assert not p.has_error and p.statistics.recovery_times == 1
    items = [n for n in p.root.walk() if n.symbol == "item"]
    assert [shape(n) for n in items] == [("item", "A", "B", "';'"), ("item", "Any", "';'"), ("item", "A", "B", "';'")] and items[1].children[0].value == ["a"]
    off = compiled(rules, kind).parse("a b ; a ; a b ;")
    assert off.has_error and (off.root is None) == (kind == "LR")


def test_rollback_in_water():
    rules = "s = x*\nx = A AnyAvoid(C) B | Any D"
    p = compiled(rules, "LL", "recovery x").parse("a c d a b")
    assert p.statistics.recovery_times_any == 1 and p.statistics.recovery_times == 1 and not p.has_error
    assert p.root.children[0].children[0].value == ["a", "c"]


def test_any_error_promotes():
    p = compiled("s = x*\nx = A B | AnyError D", "LL", "recovery x").parse("a c d")
    assert p.has_error and any(m.kind == "error" and m.text == "unexpected token" for m in p.messages)
    assert isinstance(p.messages[0], Message)


def test_recovery_is_tried_once_at_a_token():
    p = compiled("s = x*\nx = A Any B | Any D", "LL", "recovery x").parse("a c")
    assert p.has_error


def test_trace():
    p = compiled("s = Any B").parse("a b")
    assert not p.messages and compiled("s = Any B").parse("a b", trace=True).messages[0].kind == "trace"


def test_greedy_quantifier():
    rules = "s = x B?\nx = A B?!"
    assert shape(compiled(rules).parse("a b b").root) == ("s", ("x", "A", "B"), "B")


# trees -------------------------------------------------------------------------------------------------------------


def tree(spec):
    symbol, *children = spec if isinstance(spec, tuple) else (spec,)
    node = Node(symbol)
    node.adopt([tree(c) for c in children])
    if not children:
        node.value = [symbol]
    return node


def rewritten(rules, options, text):
    return shape(compile_grammar(f"A : 'a'\nB : 'b'\nC : 'c'\n{rules}\n%%\n%parsing start s\n%nodes {{\n{options}\n}}").parse(text).root)


def test_rewrites():
    rules = "s = x y*\nx = A (B => two | C => three)\ny = A z\nz = B |"
    assert rewritten(rules, "", "a b a b a") == ("s", ("two", "A", "B"), ("y", "A", ("z", "B")), ("y", "A", "z"))
    assert rewritten(rules, "ghost y", "a b a b") == ("s", ("two", "A", "B"), "A", ("z", "B"))
    assert rewritten(rules, "void z two", "a b a b") == ("s", ("y", "A"))
    assert rewritten(rules, "leaf x y", "a c a b") == ("s", "three", "y")
    assert rewritten("s = A s | B", "list s", "a a b") == ("s", "A", "A", "B")
    assert rewritten("s = %nodes(leaf) x A\nx = A B", "ghost x", "a b a") == ("s", "x", "A")


def test_merge_water():
    parser = catalog.grammar("html_tags")
    root = tree(("s", "Any", "Any", "Any", "x", "Any"))
    for n, v in zip(root.children, (["1"], [], ["2"], ["x"], ["3"]), strict=True):
        n.value = v
    parser.rewriter.merge_water(root)
    assert [(n.symbol, n.value) for n in root.children] == [("Any", ["1"]), ("Any", ["2"]), ("x", ["x"]), ("Any", ["3"])]


def test_user_steps_and_single_pass():
    parser = catalog.grammar("words")
    seen = []
    parser.rewriter.__class__(parser.grammar, steps=(lambda r: seen.append(r.symbol) or r,))(tree(("text", "WORD")))
    assert seen == ["text"]


JAVA = """/// block begin whole
class A {
  int a = 1, b;
  /// block begin fields
  int c;
  int d;
  /// block end
  void f() { }
  /// block begin
  void g() { }
  /// block end
}
/// block end
"""


def test_custom_blocks():
    p = catalog.grammar("java").parse(JAVA)
    assert not p.has_error and p.root.symbol == "custom_block"
    blocks = [n for n in p.root.walk() if n.symbol == "custom_block"]
    assert [b.children[0].value[0] for b in blocks] == ["whole", "fields", ""] and [c.type for c in blocks[1].children[1:-1]] == ["field", "field"]
    cut = catalog.grammar("java").parse("class A { /// block begin x\n int a; } class B { int b; /// block end\n }")
    assert any("cuts a node" in m.text for m in cut.messages)
    lost = catalog.grammar("java").parse("class A { /// block end\n /// block begin\n }")
    assert [m.kind for m in lost.messages] == ["error"] and not lost.lexed.blocks


@pytest.mark.parametrize("deep", [1, 5, 30, 60])
def test_patterns_that_use_themselves(deep):
    p = compile_grammar("NESTED : '(*' (NESTED | ~[*()])* '*)'\nA : 'a'\ns = (A | Any)*\n%%\n%parsing {\nstart s\nskip NESTED\n}")
    text = "a " + "(* x " * deep + "*) " * deep + " a"
    assert [t.name for t in p.lexer.scan(text)[:-1]] == ["A", "NESTED", "A"]


# bundled grammars --------------------------------------------------------------------------------------------------

CSHARP = "using X.Y;\nnamespace N { [A] public enum E { P, Q } class S : B { private int f = 5, g; public int Pos { get; set; } int Read(int a) { if (a) { b(); } } delegate void D(int x); } }"


@pytest.mark.parametrize("name", ["csharp", "csharp_lr"])
def test_csharp(name):
    types = ("enum", "class", "field", "property", "method", "delegate")
    assert found(name, CSHARP, *types) == [("enum", "E"), ("class", "S"), ("field", "f g"), ("property", "Pos"), ("method", "Read"), ("delegate", "D")]


@pytest.mark.parametrize("name, field", [("java", ("field", "a b")), ("java_lr", None)])
def test_java(name, field):
    text = "import x.Y; @N(1) public class K extends Z { int a = 1, b; List<String> m(int q) throws E { } enum O { P } }"
    own = found(name, text, "class", "method", "enum")
    assert own == [("class", "K"), ("method", "m"), ("enum", "O")]
    assert field is None or field in found(name, text, "field")


def test_pascal_markdown_xml_and_others():
    assert found("pascal", "unit U; PROCEDURE Foo(a: integer); BEGIN x := 1; END; function B.C: integer; forward;", "routine") == [("routine", "Foo"), ("routine", "B.C")]
    heads = found("markdown", "Title\n=====\ntext\n# one\n~~~\n# no\n~~~\nSub\n---\n    # code\n", "setext_heading_1", "setext_heading_2", "atx_heading")
    assert [t for t, _ in heads] == ["setext_heading_1", "atx_heading", "setext_heading_2"]
    note = "<?xml version='1.0' e=\"u\"?><note><to>T</to><from a='1'/><h>Don't</h><b>x</b></note>"
    assert [n for _, n in found("xml", note, "element")] == ["note", "to", "from", "h", "b"]
    assert found("yacc", "%token A\n%%\ne : e '+' t { x } | t ;\nt : A ;\n%%\nz", "rule") == [("rule", "e"), ("rule", "t")]
    assert [t for t, _ in found("lex", "D   [0-9]\n%%\n[a-z]+ { a }\n[0-9] { b }\n%%\n", "rule")] == ["rule", "rule"]
    assert found("typescript", "export class A { x: number = 1; f(a: b): c { } }\nfunction g(x) { y }", "class", "function") == [("class", "A"), ("function", "g")]
    assert [t for t, _ in found("csharp_branches", "if (a) { switch (b) { } } else if (c) y();", "if", "switch", "else")] == ["if", "switch", "else", "if"]
    assert [t for t, _ in found("braces_lr", "f(a b); { x { y } } g(q);", "call", "block")] == ["call", "block", "call"]
    assert found("csharp_types", "namespace N { class A { void f() { x } } }", "class") == [("class", "A")]
    assert [t for t, _ in found("java_plain_lr", "class A { int x; int f ( a b ) { q { r } } }", "class", "field", "method")] == ["class", "field", "method"]


def test_first_characters_never_hide_a_match():
    for name in catalog.KINDS:
        lexer = catalog.grammar(name).lexer
        for char in map(chr, [*range(9, 14), *range(32, 127), 0xE9, 0x416]):
            for _, branches, line_start in lexer.rules:
                for b in branches:
                    if not line_start and not _may_begin(b.pattern, char):
                        assert not any((m := b.match(char + tail)) and m.end() for tail in ("", "a", "1", char, " x", "/*/", "->x", "''", '""', "=a>", "begin", "lass "))
