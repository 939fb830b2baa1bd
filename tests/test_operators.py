import random
import re

import pytest
from pyspark.sql import functions as F

from tolparse import catalog, frames
from tolparse.functions import enclosed_name, words
from tolparse.grammar.model import Grammar
from tolparse.operators import compare, entities, nesting, preprocess, sections, spans, trees
from tolparse.parsing.engine import compile_grammar
from tolparse.parsing.tree import Node, Rewriter

DOCS = "doc_id long, text string"


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


# frames --------------------------------------------------------------------------------------------------------------


def test_frames_of_empty_null_and_repeated(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "class A { int x; }", 0), (3, "class A { int x; }", 0)], DOCS + ", type int")
    parser = catalog.grammar("java")
    assert frames.tokens(docs, parser).groupBy("doc_id").count().collect()[0][:] == (3, 14)
    assert rows(frames.entities(docs, parser, ["class", "field"]), "doc_id", "type", "value") == sorted([(3, "class", "A"), (3, "field", "x")] * 2)
    assert rows(frames.stats(docs, parser), "doc_id", "tokens_count", "has_error") == [(2, 0, False), (3, 7, False), (3, 7, False)]
    for f in (frames.tokens, frames.nodes, frames.messages, frames.stats, frames.blocks):
        assert f(docs.limit(0), parser).count() == 0


def test_statistics_without_trees_equal_those_with(spark):
    text = "<p>a</p> <!-- <b> --> x < y"
    for name in catalog.KINDS:
        p = catalog.grammar(name)
        if p.flat:
            whole, (own, failed) = p.parse(text), p.statistics_of(text)
            assert (own.chars_count, own.tokens_count, own.recovery_times, failed) == (whole.statistics.chars_count, whole.statistics.tokens_count, 0, whole.has_error)
    assert [n for n in catalog.KINDS if catalog.grammar(n).flat] == ["html_tags", "words"]
    assert not compile_grammar("A : 'a'\nB : 'b'\ns = (A | AnyAvoid(B))*\n%%\n%parsing start s").flat and not compile_grammar("A : 'a'\ns = A*\n%%\n%parsing start s").flat


def test_table_functions(spark):
    frames.register_functions(spark, "own", catalog.grammar("java"), ["class", "method"])
    spark.createDataFrame([(1, "class A { int f() { } }"), (2, None), (3, "class { }")], DOCS).createOrReplaceTempView("own_docs")
    assert rows(spark.sql("SELECT d.doc_id, t.seq, t.type, t.value FROM own_docs d, LATERAL own_entities(d.text) t WHERE doc_id < 3")) == [(1, 0, "class", "A"), (1, 1, "method", "f")]
    docs = spark.table("own_docs")
    for kind, frame in (("tokens", frames.tokens), ("nodes", frames.nodes), ("messages", frames.messages)):
        want = frame(docs, catalog.grammar("java"))
        got = spark.sql(f"SELECT d.doc_id, t.* FROM own_docs d, LATERAL own_{kind}(d.text) t")
        plain = [c for c, k in want.dtypes if "map" not in k]
        assert sorted(map(str, got.select(plain).collect())) == sorted(map(str, want.select(plain).collect()))


def test_nodes_are_nested_sets(spark):
    text = "class A { int x; void f() { } class B { int y; } }"
    nodes = frames.nodes(spark.createDataFrame([(1, text)], DOCS), catalog.grammar("java"))
    found = {r.node_id: r for r in nodes.collect()}
    assert sorted(found) == list(range(len(found)))
    for r in found.values():
        if r.parent_id is not None:
            p = found[r.parent_id]
            assert p.node_id < r.node_id <= r.last_desc <= p.last_desc and r.level == p.level + 1 and p.start_off <= (r.start_off or p.start_off)
    assert rows(entities.select_entities(nodes, ["field", "method", "class"]), "type", "value") == [("class", "A"), ("class", "B"), ("field", "x"), ("field", "y"), ("method", "f")]
    whole = rows(trees.spans(nodes).filter("node_id = 0"), "start_off", "end_off")
    assert whole == [(0, len(text) - 1)]


def test_options_and_arguments_are_columns(spark):
    parser = compile_grammar("A : 'a'\nB : 'b'\ns = %nodes(leaf) x AnyAvoid(B)\nx = A\n%%\n%parsing start s")
    got = {r.symbol: r for r in frames.nodes(spark.createDataFrame([(1, "a a")], DOCS), parser).collect()}
    assert got["x"].options == {"nodes": ["leaf"]} and got["Any"].args == {"Avoid": ["B"]}


def test_messages(spark):
    out = frames.messages(spark.createDataFrame([(1, "class A { ) }")], DOCS), catalog.grammar("java")).collect()
    assert out[0].type == "error" and out[0].unexpected_lexeme == ")" and out[0].offset == 10 and out[0].line == 1


# relational rewriting against the fold in memory -----------------------------------------------------------------------


def random_tree(rng, depth=0):
    node = Node(rng.choice("abcdv"))
    if depth < 4 and rng.random() < 0.8:
        node.adopt([random_tree(rng, depth + 1) for _ in range(rng.randrange(1, 4))])
    else:
        node.value = [str(rng.randrange(100))]
    return node


def signature(root):
    def of(n):
        return (n.symbol, tuple(n.value) if not n.children else (), tuple(of(c) for c in n.children))

    return of(root)


def from_rows(found):
    children = {}
    for r in found:
        children.setdefault(r.parent_id, []).append(r)

    def of(r):
        own = sorted(children.get(r.node_id, []), key=lambda c: c.child_idx)
        return (r.symbol, tuple(r.value) if not own else (), tuple(of(c) for c in own))

    return of(children[None][0])


@pytest.mark.parametrize("options", [{"void": ["v"]}, {"ghost": ["b"]}, {"list": ["a", "c"]}, {"void": ["v"], "ghost": ["b", "d"], "list": ["a"]}, {"leaf": ["c", "d"]}])
def test_relational_rewriting_equals_the_fold(spark, options):
    rng = random.Random(repr(options))
    forest = []
    for _ in range(12):
        root = Node("r")
        root.adopt([random_tree(rng) for _ in range(3)])
        forest.append(root)
    raw = spark.createDataFrame([(*r[:-2], {}, {}) for k, root in enumerate(forest) for r in frames.node_rows(k, root)], frames.NODES)
    out = raw
    if "void" in options:
        out = trees.drop_subtrees(out, F.col("symbol").isin(options["void"]))
    if "ghost" in options:
        out = trees.splice(out, F.col("symbol").isin(options["ghost"]))
    if "list" in options:
        out = trees.flatten_lists(out, options["list"])
    if "leaf" in options:
        out = trees.collapse_leaves(out, options["leaf"])
    got = {}
    for r in trees.renumber(out).collect():
        got.setdefault(r.doc_id, []).append(r)
    grammar = Grammar("LL")
    for option, symbols in options.items():
        grammar.options.set("nodes", option, symbols)
    for k, root in enumerate(forest):
        rewriter = Rewriter(grammar)
        rewriter.splice(root)
        rewriter.leaves(root)
        have, want = from_rows(got[k]), signature(root)
        if "leaf" in options or not any(n.symbol != "r" and not n.children and not n.value for n in root.walk()):
            assert have == want


def test_merge_adjacent_equals_the_fold(spark):
    rng = random.Random(2)
    data, want = [], {}
    for doc in range(40):
        root = Node("r")
        own = []
        for k in range(rng.randrange(1, 12)):
            n = Node(rng.choice(["Any", "Any", "x"]))
            n.value = [str(k)] if rng.random() < 0.7 else []
            own.append(n)
            data.append((doc, k, n.symbol, n.value, k, k))
        root.adopt(own)
        Rewriter.merge_water(root)
        want[doc] = [(n.symbol, n.value) for n in root.children]
    df = spark.createDataFrame(data, "doc_id long, child_idx int, symbol string, value array<string>, start_off int, end_off int")
    merged = trees.merge_adjacent(df, ["doc_id"], "child_idx", F.col("symbol") == "Any", F.size("value") == 0)
    got = {}
    for r in sorted(merged.collect(), key=lambda r: (r.doc_id, r.child_idx)):
        got.setdefault(r.doc_id, []).append((r.symbol, list(r.value)))
    assert got == want


# segments ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("b, includes, overlaps, rest, hull", [
    ((3, 5), True, False, [(2, 2), (6, 8)], (2, 8)), ((6, 12), False, True, [(2, 5)], (2, 12)), ((0, 10), False, False, [], (0, 10)), ((2, 8), True, False, [], (2, 8)), ((9, 9), False, False, [(2, 8)], (2, 9)),
])
def test_spans(spark, b, includes, overlaps, rest, hull):
    c = [F.lit(x) for x in (2, 8, *b)]
    r = spark.range(1).select(spans.includes(*c).alias("i"), spans.overlaps(*c).alias("o"), spans.exclude(*c).alias("x"), spans.hull(*c).alias("h"), spans.merge(c[0], c[3]).alias("m"), spans.shift(c[0], F.lit(-5)).alias("s"), spans.covered(spans.exclude(*c)).alias("n")).first()
    assert (r.i, r.o, [tuple(x) for x in r.x], tuple(r.h), tuple(r.m), r.s, r.n) == (includes, overlaps, rest, hull, (2, b[1]), 0, sum(e - s + 1 for s, e in rest))


# nesting -------------------------------------------------------------------------------------------------------------


def test_window_depth_equals_the_stack(spark):
    docs = spark.createDataFrame([(1, "class A { int f() { x(y[1]); } }"), (2, "class B { }")], DOCS)
    tokens = frames.tokens(docs, catalog.grammar("java"))
    again = nesting.with_depth(tokens.drop("depth", "direction"), ["{", "(", "["], ["}", ")", "]"])
    assert rows(tokens, "doc_id", "tok_idx", "depth", "direction") == rows(again, "doc_id", "tok_idx", "depth", "direction")
    assert rows(nesting.unmatched(spark.createDataFrame([(1, 0, ")"), (1, 1, "("), (1, 2, "("), (1, 3, ")")], "doc_id int, tok_idx int, text string"), "(", ")")) == [(1, 1, 1)]


# preprocessing ---------------------------------------------------------------------------------------------------------

SHARP = "#define X Y\nclass A {\n#if X && (Q || !Q)\n void a() { }\n#if Q\n void b() { }\n#endif\n#elif Y\n#if X\n void c() { }\n#endif\n#else\n void d() { }\n#endif\n#undef X\n#if X\n void e() { }\n#endif\n}\n"


def test_csharp_directives(spark):
    docs = spark.createDataFrame([(1, SHARP), (2, "class B { }")], DOCS)
    cuts = preprocess.excluded(docs, catalog.grammar("csharp_directives"))
    kept = preprocess.without(docs, cuts)
    left = next(r.text for r in kept.collect() if r.doc_id == 1)
    assert re.findall(r"void (\w)", left) == ["a"] and "#elif" not in left and left.startswith("#define X Y\nclass A {\n#if X")
    methods = frames.nodes(kept, catalog.grammar("csharp")).filter("alias = 'method'")
    found = preprocess.remap(methods.select("doc_id", "start_off"), cuts)
    assert [SHARP[r.whole_off : r.whole_off + 6] for r in found.collect()] == ["void a"]


def test_pascal_directives(spark):
    text = "{$define D}{$ifndef D}one{$else}two{$endif}{$ifdef D}three{$else}four{$endif}{$ifdef N}five{$endif}"
    docs = spark.createDataFrame([(1, text)], DOCS)
    left = preprocess.without(docs, preprocess.excluded(docs, catalog.grammar("pascal_directives"))).first().text
    assert [w for w in ("one", "two", "three", "four", "five") if w in left] == ["two", "three"]
    assert preprocess.excluded(docs, catalog.grammar("pascal_directives"), ["N"]).count() == 2
    other = "{a {$ note} (* {$ifdef Q} *) (*$define D*){$R+}x(*$ifdef E*)y(*$else a note*)z(*$endif*) '{$ifdef N}' // {$ifdef N}\nw(*$R *.res*)"
    docs = spark.createDataFrame([(1, other)], DOCS)
    assert preprocess.without(docs, preprocess.excluded(docs, catalog.grammar("pascal_directives"))).first().text == other.replace("(*$ifdef E*)y(*$else a note*)", "")


def test_remap_equals_brute_force(spark):
    rng = random.Random(3)
    data, segments, want = [], [], []
    for doc in range(30):
        text = "".join(rng.choice("abc<>") for _ in range(60))
        cuts = [(m.start(), m.end() - 1) for m in re.finditer("<[^<>]*>", text)]
        segments += [(doc, s, e) for s, e in cuts]
        whole = [k for k in range(len(text)) if not any(s <= k <= e for s, e in cuts)]
        data += [(doc, k, "x") for k in range(len(whole))]
        want += [(doc, k, w) for k, w in enumerate(whole)]
    cuts = spark.createDataFrame(segments, "doc_id long, start_off int, end_off int")
    out = preprocess.remap(spark.createDataFrame(data, "doc_id long, start_off int, _extra string"), cuts)
    assert rows(out, "doc_id", "start_off", "whole_off") == sorted(want)


def test_pipeline_of_preprocessors(spark):
    upper = preprocess.Preprocessor(lambda d: d.withColumn("text", F.translate("text", "XY", "PQ")), name="upper")
    both = preprocess.pipeline(preprocess.REGISTRY["noop"](), upper, preprocess.conditional(catalog.grammar("csharp_directives")))
    docs = spark.createDataFrame([(1, "#if A\nclass X { }\n#endif\nclass Y { }")], DOCS)
    kept = both.before(docs)
    assert "class P" not in kept.first().text and "class Q" in kept.first().text and both.name == "noop | upper | conditional"
    nodes = both.after(frames.nodes(kept, catalog.grammar("words")), kept)
    assert nodes.filter("symbol = 'WORD'").agg(F.min("start_off")).first()[0] == docs.first().text.index("class Y")
    preprocess.register("mine", lambda: upper)
    assert preprocess.REGISTRY["mine"]() is upper


def test_offsets_lines_and_messages_come_back(spark):
    text = "#if A\nint x;\n#endif\nclass B {\n#if A\n  void no() { }\n#else\n  void m() { }\n#endif\n  int ) y;\n}\n"
    docs = spark.createDataFrame([(1, text), (1, text), (2, None), (3, "class C { int z; }")], DOCS)
    prep = preprocess.conditional(catalog.grammar("csharp_directives"))
    found = preprocess.nodes_through(docs.filter("doc_id <> 1").union(docs.filter("doc_id = 1").limit(1)), catalog.grammar("csharp"), prep)
    method = found.filter("type = 'method'").first()
    assert text[method.start_off : method.end_off + 1] == "void m() { }" and method.start_line == 8
    errors = preprocess.messages_through(docs, catalog.grammar("csharp"), prep).filter("unexpected_lexeme = ')'").collect()
    assert errors and {(m.line, m.col, text[m.offset]) for m in errors} == {(10, 6, ")")}
    cuts = preprocess.segments(prep.before(docs))
    assert rows(preprocess.remap(spark.createDataFrame([(1, 0), (1, 0), (3, 5), (1, None)], "doc_id long, start_off int").filter("start_off is not null"), cuts)) == [(1, 0, 20), (1, 0, 20), (3, 5, 5)]
    doubled = spark.createDataFrame([(1, 2, 9)] * 2, "doc_id long, start_off int, end_off int")
    assert rows(preprocess.remap(spark.createDataFrame([(1, 1), (1, 2)], "doc_id long, start_off int"), doubled)) == [(1, 1, 1), (1, 2, 10)]
    assert rows(preprocess.without(spark.createDataFrame([(1, "ab<!--x-->cd")] * 2, DOCS), doubled), "text") == [("abcd",)] * 2


def test_a_failing_preprocessor_keeps_the_text(spark):
    docs = spark.createDataFrame([(1, "bad", "q"), (2, "good", "q"), (3, None, "q")], DOCS + ", cuts string")

    def find(text):
        if text == "bad":
            raise ValueError("no")
        return [(0, 1)]

    assert rows(preprocess.cut(docs, find), "doc_id", "text", "cut_error") == [(1, "bad", "ValueError: no"), (2, "od", None), (3, None, None)]


def test_pascal_chain(spark):
    text = "{$ifdef X}procedure no; begin end;{$endif}\nprocedure a;\nbegin {$ifdef X}q;{$endif} w; end;\n"
    found = {r.type: r for r in preprocess.pascal_nodes(spark.createDataFrame([(1, text)], DOCS)).collect()}
    routine, block = found["routine"], found["block"]
    assert text[routine.start_off : routine.end_off + 1] == text[text.index("procedure a") : -1] and block.parent_id == routine.node_id and block.start_line == 3


@pytest.mark.parametrize("seed", range(3))
def test_enclosing_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    data = [(d, k, rng.choice([None, 1, 2, 3, 8, 9, 40]), "x") for d in (1, 2, None) for k in range(40)]
    got = rows(sections.enclosing(spark.createDataFrame(data, "doc_id long, seq int, level int, parent_seq string")).fillna(-1), "doc_id", "seq", "parent_seq")
    want = []
    for d, k, level, _ in data:
        before = [s for e, s, other, _ in data if e == d and s < k and level is not None and other is not None and other < level]
        want.append((-1 if d is None else d, k, max(before, default=-1)))
    assert got == sorted(want)


# hierarchies -----------------------------------------------------------------------------------------------------------


def test_sections(spark):
    text = "Top\n===\na\n## Two\nb\n#### Four\nc\nNext\n---\nd\n# Last\n"
    nodes = frames.nodes(spark.createDataFrame([(1, text)], DOCS), catalog.grammar("markdown")).filter("symbol = 'block'")
    blocks = nodes.select("doc_id", F.col("node_id").alias("seq"), "type", F.array_join("value", "").alias("value"), "start_off", "end_off")
    found = sorted(sections.sections(blocks).collect(), key=lambda r: r.section_id)
    assert [(r.level, r.title, r.parent_id) for r in found] == [(1, "Top", None), (2, "Two", 0), (3, None, 1), (4, "Four", 2), (2, "Next", 0), (1, "Last", None)]
    assert text[found[0].start_off : found[0].end_off + 1].endswith("d\n") and text[found[1].start_off : found[1].end_off + 1].endswith("c\n")


def test_routines(spark):
    kinds = ["tail", "routine", "modifier", "block", "other", "block", "routine", "routine", "block"]
    df = spark.createDataFrame([(1, 0, k, t, 10 * k, 10 * k + 9) for k, t in enumerate(kinds)], "doc_id int, parent_id int, seq int, type string, start_off int, end_off int")
    got = {r.seq: r.routine_seq for r in sections.attach_to_routines(df).collect()}
    assert got == {0: None, 1: 1, 2: 1, 3: 1, 4: None, 5: None, 6: 6, 7: 7, 8: 7}
    assert rows(sections.routine_spans(df)) == [(1, 1, 10, 39, 3), (1, 6, 60, 69, 1), (1, 7, 70, 89, 2)]


# reports and statistics --------------------------------------------------------------------------------------------------


def test_compare(spark):
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "value string")
    left, right = compare.difference(frame(["x", "x", "y", None, None]), frame(["x", "z", None]))
    assert sorted(r.value or "" for r in left.collect()) == ["", "x", "y"] and rows(right) == [("z",)]
    chunks = spark.createDataFrame([(1, "field", "a b  c"), (2, "other", "a b"), (3, "field", "  ")], "doc_id int, type string, value string")
    assert rows(compare.chunk_values(chunks, {"field": 1})) == [(1, "field", "a"), (1, "field", "b"), (1, "field", "c"), (2, "other", "a b")]
    assert rows(compare.chunk_values(chunks, {"field": 2})) == [(1, "field", "a b"), (1, "field", "c"), (2, "other", "a b")]
    assert compare.chunk_values(chunks, {}) is chunks and compare.rename_types(chunks, {}) is chunks
    assert {r.type for r in compare.rename_types(chunks, {"field": "f"}).collect()} == {"f", "other"}


def test_fold(spark):
    stats = spark.createDataFrame([(1, 10, 5, 1, 2, 3), (2, 20, 6, 2, 4, 5)], "doc_id int, chars_count long, tokens_count long, recovery_times long, recovery_times_any long, longest_rollback long")
    assert entities.fold_stats(stats).first().asDict() == {"chars_count": 30, "tokens_count": 11, "recovery_times": 3, "longest_rollback": 5, "recovery_times_any": 6}
    assert entities.fold_stats(stats, True).first().asDict() == {"tokens_count": 11, "recovery_times": 3, "longest_rollback": 8, "recovery_times_any": 4}
    assert entities.render_stats(entities.fold_stats(stats)).first().line.startswith("chars_count: 30; ")
    timed = stats.withColumns({"general_ms": F.lit(61500.25), "recovery_ms": F.col("doc_id") * 1.0})
    assert entities.render_stats(entities.fold_stats(timed, times=True)).first().line.endswith("; general_ms: 02:03.001; recovery_ms: 00:00.003")
    assert rows(entities.top(stats, "tokens_count", 1), "doc_id") == [(2,)]


def test_functions(spark):
    df = spark.createDataFrame([("<< a >>",), ("x",), (None,)], "t string")
    assert [r.n for r in df.select(enclosed_name(F.col("t"), "<<", ">>").alias("n")).collect()] == ["a", None, None]
    assert spark.range(1).select(words(F.lit(" a  b ")).alias("w")).first().w == ["a", "b"]


def test_bytes_that_are_no_text(spark):
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("cast(X'6162FF6364' as string)").alias("text"))
    assert rows(frames.tokens(docs, catalog.grammar("words")), "text", "start_off") == [("ab", 0), ("cd", 3)]
