"""Bundled grammars over code of some length: no error, and all entities."""

import pytest

from tolparse import catalog

JAVA = """package a.b;
import x.Y;
@N(1) public class K<T extends Z & Q> extends Z<A> implements I {
  static { x(); }
  K(int a) { }
  int a = 1, b; Map<String, List<? extends T>> m = new HashMap<String, T>(), n; int[] c[] = {1, 2};
  public <U> List<String>[] get(int q) throws E { return a < b ? "}" : '{'; }
  enum O { P(1) { void f() { } }, R; int z; O(int i) { } }
  abstract void g();
  @Override public String toString() { return \"\"\"
      } \"\"\"; }
  @interface M { int v() default 3; }
  interface J extends L { default void d() { } }
  record R(int a, String b) { }
  int record;
}
"""
CSHARP = """#region a
using X.Y;
namespace N.M {
  [A(1)] public enum E : byte { P = 1, Q }
  class S<T> : B, I<T> where T : new() {
    private int f = 5, g; const string h = @"a""{";
    public int Pos { get; set; } = 3; int Q => f + 1;
    int Read(int a) { if (a) { b(); } }
    S(int a) : base(a) { }
    ~S() { }
    public static S operator +(S a, S b) { return a; }
    public static implicit operator int(S s) => 1;
    delegate void D(int x);
    event Action<int> Ev;
    public int this[int i] { get { return 1; } }
    Dictionary<string, List<int?>> d = new Dictionary<string, int>();
    (int, string) Tup() => (1, "");
    async Task<T[]> Go<U>(U u) where U : class { await x; }
  }
  struct V { }
  interface I { void F(); int? K { get; } }
  record Rec(int A);
}
"""
PASCAL = """unit U;
interface
uses A, B;
const c = 1; d: integer = 2;
type TFoo = class; TBar = class(TFoo)
  private
    fX: integer; a, b: string;
  public
    constructor Create(x: integer);
    class function Inst: TBar; static;
    property X: integer read fX write fX;
    function F(y: integer): TList<integer>; virtual; abstract;
  end;
  TRec = record x, y: real; end;
  TEnum = (one, two);
  TRef = class of TBar;
  IFoo = interface procedure Q; end;
var v: integer; w := 5;
implementation
constructor TBar.Create(x: integer);
var i: integer;
begin case x of 1: begin end; end; try a; except end; end;
procedure P(var a: array of integer; b: real := 1);
  procedure Inner; begin end;
begin Inner; end;
function Sq(x: integer) := x * x;
initialization
begin w; end
end.
"""
TYPESCRIPT = """import a from 'b';
export class A<T> extends B { x: number = 1; private readonly y?: string; @dec() get(a: b): c { } constructor(x) { } [k: string]: any; }
function g(x) { y }
namespace N.M { interface I { p: number; m(): void; } export const enum E { A } type T = A | B; let q = 5; }
if (x) { foo(); }
"""
YACC = "%token <x> A B\n%left '+' '-'\n%{ int x; %}\n%%\ne : e '+' t { x { y } } | t ;\nt : A %prec B ;\nlist : list\n   | e\nq : 'a' ;\n%%\nz"
LEX = '%x COMMENT STR\n%option noyywrap\n%{\ncode\n%}\nD   [0-9]\n%%\n[a-z]+ { a }\n{D}+"." { return 1; }\n<COMMENT>{\n  "*/" { BEGIN(INITIAL); }\n  . ;\n}\n<STR>abc|d { b { c } }\n%%\nrest'
MARKDOWN = "Title\n=====\ntext\n# one\n~~~\n# no\n~~~\nSub\n---\n    # code\n\n* a\n> b\n***\n######## deep\n```\n# open\n"
STATEMENTS = "x = 1; if (a) { switch (b) { case 1: if (q) x(); break; default: y(); } } else if (c) y(); f();"
C_STATEMENTS = "if (a) { } else { } switch (x) { case 1: y(); default: z = 1; } for (;;) { a(); } do { } while (x); try { } catch (E e) { } x = 5;"
PROGRAM = "program P; const a = 1; var b, c: integer; procedure Q(x: real); begin if x > 1 then begin y := 2 end else z := 3; end; begin for i := 1 to 5 do begin Q(i); end; repeat a; until c; case x of 1: y; end; end."


def found(name, text, types):
    p = catalog.grammar(name).parse(text)
    assert not p.has_error, p.messages
    types = types.split()
    return [" ".join([n.type, *("".join(c.text()) for c in n.children if c.type == "name")]) for n in p.root.walk() if n.type in types]


CASES = [
    ("java", JAVA, "class interface enum record annotation_type method", ["class K", "method get", "enum O", "method g", "method toString", "annotation_type M", "method v", "interface J", "method d", "record R"]),
    ("java", JAVA, "field initializer constructor", ["initializer", "constructor", "field a b", "field m n", "field c", "field z", "constructor", "field record"]),
    ("java_lr", JAVA.replace('"""\n      } """', '""'), "class interface enum annotation_type method constructor", ["class K", "constructor K", "method get", "enum O", "method g", "method toString", "annotation_type M", "method v", "interface J", "method d", "method R"]),
    ("csharp", CSHARP, "class struct interface enum record delegate event method property", ["enum E", "class S<T>", "property Pos", "property Q", "method Read", "delegate D", "event Ev", "method Tup", "method Go<U>", "struct V", "interface I", "method F", "property K", "record Rec"]),
    ("csharp", CSHARP, "field constructor finalizer operator indexer", ["field f g", "field h", "constructor", "finalizer S", "operator", "operator", "indexer", "field d"]),
    ("csharp", "namespace A.B;\nclass X { void F() { } }", "class method", ["class X", "method F"]),
    ("csharp_lr", CSHARP, "class struct interface enum delegate event method property", ["enum E", "class S<T>", "property Pos", "property Q", "method Read", "delegate D", "event Ev", "method Go<U>", "struct V", "interface I", "method F", "property K", "method Rec"]),
    ("csharp_members", CSHARP, "type enum scope", ["scope N.M", "enum E", "type S<T>", "type V", "type I"]),
    ("csharp_branches", STATEMENTS, "if else switch label", ["if", "switch", "label", "if", "label", "else", "if"]),
    ("csharp_branches_whole", STATEMENTS, "if switch section", ["if", "switch", "section", "if", "section", "if"]),
    ("csharp_operators_lr", C_STATEMENTS, "if else switch label loop do try", ["if", "else", "switch", "label", "label", "loop", "do", "loop", "try", "try"]),
    ("pascal", PASCAL, "class record interface synonym routine property", ["synonym TFoo", "class TBar", "routine Create", "routine Inst", "property X", "routine F", "record TRec", "synonym TEnum", "synonym TRef", "interface IFoo", "routine Q", "routine TBar.Create", "routine P", "routine Inner", "routine Sq"]),
    ("pascal", PASCAL, "constant variable field", ["constant c", "constant d", "field fX", "field a b", "field x y", "variable v", "variable w", "variable i"]),
    ("pascal", "type A = class x: integer; end; procedure f; begin end;", "class routine block", ["class A", "routine f", "block"]),
    ("pascal", "program P; type R = record a: real; end; begin f; end.", "record block heading", ["heading P", "record R", "block"]),
    ("pascal_statements", PROGRAM, "routine if loop repeat case", ["routine Q", "if", "loop", "repeat", "case"]),
    ("typescript", "module M { class A { x: number; f(): void { } } }", "module class field method", ["module M", "class A", "field x", "method f"]),
    ("typescript", TYPESCRIPT, "module class interface enum function alias method field", ["class A", "field x", "field y", "method get", "method constructor", "function g", "module N.M", "interface I", "field p", "method m", "enum E", "alias T"]),
    ("yacc", YACC, "rule symbols", ["symbols", "symbols", "rule e", "rule t", "rule list", "rule q"]),
    ("lex", LEX, "rule group states definition", ["states", "definition", "rule", "rule", "group", "rule", "rule", "group", "rule"]),
    ("markdown", MARKDOWN, "setext_heading_1 setext_heading_2 atx_heading code list_item block_quote thematic_break", ["setext_heading_1", "atx_heading", "code", "setext_heading_2", "code", "list_item", "block_quote", "thematic_break", "atx_heading", "code", "atx_heading"]),
    ("yacc", "%token <int> NUM 258 \"number\"\n%code requires {\n#include <x>\n}\n%%\n/* e : no */\nexp[result]: exp[l] '+' exp[r] %prec LOW { $$ = $l; }\n  | <int>{ mid(); } NUM | %empty ;\nlist: exp\nlast: ';' ;\n", "rule symbols code symbol", ["symbols", "code", "rule exp", "symbol", "symbol", "symbol", "symbol", "symbol", "rule list", "symbol", "rule last", "symbol"]),
    ("markdown", "two\nlines\n===\n   ### closed ###\n    # code\n#none\n\n- - -\n---\n10) item\n+ x\n---\n~~~ py\na\n~~~\n====\n", "setext_heading_1 setext_heading_2 atx_heading code list_item thematic_break paragraph", ["paragraph", "setext_heading_1", "atx_heading", "code", "paragraph", "thematic_break", "thematic_break", "list_item", "list_item", "thematic_break", "code", "paragraph"]),
    ("typescript", "function f<T extends A<B>[] = C | { x: 1 }, const U>(a: T): U { }\ninterface I<K extends keyof> { get<V>(k: K): V; }", "function interface method", ["function f", "interface I", "method get"]),
    ("xml", "<?xml version='1.0'?><!DOCTYPE a [<!ENTITY x 'y'>]><a:n><b c='<'/>it's = \"x <d e = 'f'>'</d><![CDATA[<no>]]></a:n>", "element", ["element a:n", "element b", "element d"]),
]


@pytest.mark.parametrize("name, text, types, want", CASES)
def test_entities(name, text, types, want):
    assert found(name, text, types) == want


@pytest.mark.parametrize("name, text, types, want", [
    ("yacc", "%token A\n%%\ne : e { x '+' t \n | t ;\nt : A ;\n%%\nz", "rule", ["rule e"]), ("java", "class A { int int int; void f() { } }", "class method", ["class A", "method f"]),
    ("csharp", "class A { int int int; void F() { } }", "class method", ["class A", "method F"]), ("pascal", "procedure; ; 5; procedure f; begin end;", "routine", ["routine", "routine f"]),
    ("typescript", "class A { x y z; f() { } }", "class method", ["class A", "method f"]),
])
def test_recovery(name, text, types, want):
    assert found(name, text, types) == want


def test_water_after_water_is_warned_about():
    parser = catalog.grammar("consecutive_water")
    assert [m.text for m in parser.messages] == ["Any in entry may be followed by Any in cause"]
    assert not parser.parse("1:2 info up caused by 3:4 down").has_error
