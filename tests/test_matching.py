"""Matching of segments between tables, brackets of huge documents, blocks: against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tolparse import catalog, frames
from tolparse.operators import compare, entities, nesting, sections, spans, trees
from tolparse.parsing.engine import compile_grammar
from tolparse.parsing.lexer import Block, Token
from tolparse.parsing.tree import Node, insert_blocks

SEGMENTS = "doc_id long, start_off int, end_off int, name string"


def within(x, s, e):
    return s <= x <= e


TESTS = {"includes": lambda a, b: a[1] <= b[1] and a[2] >= b[2], "overlaps": lambda a, b: within(b[1], *a[1:3]) != within(b[2], *a[1:3])}


def some(rng, n, longest, width):
    rows = []
    for k in range(n):
        start = rng.randrange(width)
        rows.append((rng.choice([1, 1, 2, None]), start, start + rng.choice([-1, 0, 1, 3, longest]), f"n{k}"))
    return rows + rows[:3]


@pytest.mark.parametrize("how", sorted(TESTS))
@pytest.mark.parametrize(("seed", "longest", "stretch"), [(1, 5, 1 << 20), (2, 60, 16), (3, 200, 7), (4, 2, 1)])
def test_matches_equal_brute_force(spark, how, seed, longest, stretch):
    rng = random.Random(seed)
    left, right = some(rng, 80, longest, 100), some(rng, 80, longest, 100)
    extra = [(1, None, 5, "x"), (1, 5, None, "x"), (1, 9, 3, "x")]
    a, b = (spark.createDataFrame(r + extra, SEGMENTS) for r in (left, right))
    got = spans.matches(a, b.withColumn("extra", F.lit(1)), how, stretch).collect()
    want = [(x[0], x[1:], y[1:]) for x in left for y in right if x[0] == y[0] and TESTS[how](x, y)]
    assert sorted(((r.doc_id, tuple(r.left), tuple(r.right)[:3]) for r in got), key=repr) == sorted(want, key=repr)


def test_matches_of_nothing(spark):
    a = spark.createDataFrame([(1, 2, 3, "x")], SEGMENTS)
    for left, right in ((a, a.limit(0)), (a.limit(0), a)):
        assert spans.matches(left, right, "includes").count() == spans.matches(left, right, "overlaps").count() == 0


def test_a_sweep_shuffles_once_and_joins_nothing(spark):
    a = spark.createDataFrame([(1, 2, 3, "x")], SEGMENTS)
    text = spans.matches(a, a, "overlaps")._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


# Brackets.

KINDS = {"round": ("(", ")"), "square": ("[", "]"), "curly": ("{", "}")}


def stack_matched(text):
    """(open, kind, close, kind, level) of each pair, closer alone and opener alone."""
    opened, out, low = [], [], 0
    for k, c in enumerate(text):
        kind = next((n for n, sides in KINDS.items() if c in sides), None)
        if kind and c == KINDS[kind][0]:
            opened.append((k, kind))
        elif kind and opened:
            out.append((*opened.pop(), k, kind, low + len(opened)))
        elif kind:
            low -= 1
            out.append((None, None, k, kind, low))
    return out + [(k, kind, None, None, low + n) for n, (k, kind) in enumerate(opened)]


GRAMMAR = "ID : [a-z]+\nROUND : %left '(' %right ')'\nSQUARE : %left '[' %right ']'\nCURLY : %left '{' %right '}'\n\ntext = (ID | Any)*\n\n%%\n%parsing start text"


def test_brackets_equal_a_stack(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("()[]{}a") for _ in range(rng.choice([0, 3, 40, 300]))) for _ in range(20)]
    texts += ["(" * 200, ")" * 200, "(" * 100 + "[" * 50 + "]" * 50 + ")" * 100, "( ]", "([)]", "((a)", "a", "){", "()" * 100]
    rows = [(d, k, c) for d, t in enumerate(texts) for k, c in enumerate(t)]
    df = spark.createDataFrame(rows + [(0, None, "(")], "doc_id long, tok_idx int, text string")
    want = sorted(((d, *m) for d, t in enumerate(texts) for m in stack_matched(t)), key=repr)
    for stretch in (7, 1 << 16):
        found = nesting.brackets(df, KINDS, stretch=stretch)
        assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    errors = {r.doc_id: (r.tok_idx, r.kind, r.expected) for r in nesting.first_errors(found).collect()}
    parser = compile_grammar(GRAMMAR, "LL")
    for d, t in enumerate(texts):  # the lexer's own stack stops at the same place
        seen = [m for m in parser.lexer(t).messages if m.kind == "error"]
        assert (errors[d][0] if d in errors else None) == (seen[0].offset if seen else None)
        depths = {x.start: x.depth for x in parser.lexer(t).tokens if x.pair}
        for _, o, _, c, _, level in (m for m in want if m[0] == d):
            assert o not in depths or depths[o] == level
            assert o is None or c not in depths or depths[c] == level + 1


# Trees and sections.


def test_surplus_of_many_equal_rows(spark):
    a = spark.range(20_000).select(F.lit("x").alias("v")).unionByName(spark.createDataFrame([("y",)], "v string"))
    left, right = compare.difference(a, spark.createDataFrame([("x",), ("z",)], "v string"))
    assert {r.v: r.n for r in left.groupBy("v").agg(F.count("*").alias("n")).collect()} == {"x": 19_999, "y": 1} and [r.v for r in right.collect()] == ["z"]


def test_headings_without_text_and_shared_ids(spark):
    blocks = [(1, 0, "atx_heading", "## a", 0, 3), (1, 1, "text", "t", 4, 5), (1, 2, "atx_heading", None, 6, 7), (1, 3, "setext_heading_2", None, 8, 9), (None, 0, "atx_heading", "# n", 0, 2)]
    got = sections.sections(spark.createDataFrame(blocks, "doc_id long, seq int, type string, value string, start_off int, end_off int")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 0, None, 1, None, 0, 5), (1, 1, 0, 2, "a", 0, 5), (1, 2, None, 1, None, 6, 9), (1, 3, 2, 2, None, 8, 9), (None, 0, None, 1, "n", 0, 2)], key=repr)
    docs = spark.createDataFrame([(1, "class A { int x; }"), (1, "class B { }"), (None, "class C { }")], "doc_id long, text string")
    with pytest.raises(Exception, match="share a doc_id"):
        entities.select_entities(frames.nodes(docs, catalog.grammar("java")), ["class"]).collect()
    own = entities.select_entities(frames.nodes(trees.numbered_documents(docs), catalog.grammar("java")), ["class", "field"])
    assert sorted(r.value for r in own.collect()) == ["A", "B", "C", "x"]


# Blocks.


def random_tree(rng, first, size, depth):
    """A tree over [first, first + size), some nodes without a place, and single characters between siblings that are of no node."""
    node = Node(rng.choice(["a", "b"]))
    parts, at = [], first
    while depth and at < first + size:
        if rng.random() < 0.25:
            at += 1
            continue
        if rng.random() < 0.2:
            empty = Node("e")
            if rng.random() < 0.3:
                empty.adopt([Node("e")])
            parts.append(empty)
            continue
        n = min(rng.randint(1, max(1, size // 2)), first + size - at)
        parts.append(random_tree(rng, at, n, depth - 1))
        at += n
    node.adopt(parts)
    if not any(c.span() for c in parts):
        node.place(first, first + size - 1, 1)
    return node


def random_blocks(rng, first, last, depth=2):
    out, at = [], first
    while depth and at <= last:
        a = rng.randint(at, last)
        z = rng.randint(a, last)
        if rng.random() < 0.7:
            edge = lambda s, e: Token("NOTE", "", s, e, 1, 0)
            out.append(Block(edge(a, a), f"b{a}-{z}", edge(z, z), random_blocks(rng, a + 1, z - 1, depth - 1)))
        at = z + 1
    return out


def as_block_rows(doc, blocks):
    todo, out = list(blocks), []
    while todo:
        b = todo.pop()
        out.append((doc, len(out), None, b.name, b.start.start, b.end.end, b.start.end, b.end.start, 1, 1))
        todo += b.children
    return out


def test_blocks_equal_those_of_the_tree(spark):
    rng = random.Random(11)
    node_rows, block_rows, want, bad = [], [], [], []
    for doc in range(150):
        size = rng.choice([1, 4, 12, 30])
        root, blocks = random_tree(rng, 3, size, 3), random_blocks(rng, 0, size + 5)
        node_rows += list(frames.node_rows(doc, root))
        block_rows += as_block_rows(doc, blocks)
        top, messages = insert_blocks(root, blocks)
        bad += [(doc, m.text) for m in messages]
        want += list(frames.node_rows(doc, top))
    nodes = spark.createDataFrame([(*r[:-2], dict(r[-2]), dict(r[-1])) for r in node_rows], frames.NODES)
    blocks = spark.createDataFrame(block_rows, frames.BLOCKS)
    got = trees.insert_blocks(nodes, blocks).collect()
    shown = lambda r: (*r[:7], r[9], r[10], r[11], r[12])
    assert bad and sorted(map(shown, got), key=repr) == sorted(((*r[:7], r[9], r[10], r[11], r[12]) for r in want), key=repr)
    assert sorted((r.doc_id, f"the custom block {r.name!r} cuts a node") for r in trees.cutting_blocks(nodes, blocks).collect()) == sorted(bad)


def test_blocks_of_parsed_texts(spark):
    """Nodes of a grammar without custom blocks, with the blocks brought in afterwards, are those of the grammar with them."""
    begin, end = "\n/// block begin {}\n", "\n/// block end\n"
    block = lambda name, text: begin.format(name) + text + end
    texts = [
        "class A {" + block("x", "int a; int b;") + " int c; }", block("all", "class A { int a; }"), "class A { int a" + block("cut", "; int b; }"), "class A {" + block("o", "int a;" + block("i", "") + "void f() { }") + "}", "", block("e", ""),
        "class A { void f() {" + block("water", "x();") + "} }" + block("after", "class B { }") + block("last", ""),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with_blocks = catalog.grammar("java")
    without = compile_grammar(catalog.text("java").split("%customblock")[0], "LL")
    nodes, blocks = frames.nodes(docs, without), frames.blocks(docs, with_blocks)
    shown = lambda df: sorted(((r.doc_id, r.node_id, r.last_desc, r.parent_id, r.child_idx, r.level, r.type, r.value) for r in df.collect()), key=repr)
    assert shown(trees.insert_blocks(nodes, blocks)) == shown(frames.nodes(docs, with_blocks))
    messages = frames.messages(docs, with_blocks).filter("source = 'blocks'").collect()
    assert sorted(r.name for r in trees.cutting_blocks(nodes, blocks).collect()) == sorted(m.text.split("'")[1] for m in messages) != []
    assert trees.insert_blocks(nodes.limit(0), blocks).count() == 0 and trees.insert_blocks(nodes, blocks.limit(0)).count() == nodes.count()


def test_brackets_run_one_fold(spark):
    """What is left over and the places of stretches do not run the workers' fold again."""
    tokens = spark.createDataFrame([(1, k, t) for k, t in enumerate("(b)d)(pq")], "doc_id long, tok_idx long, text string")
    found = nesting.brackets(tokens, {"round": ("(", ")"), "b": ("b", "d"), "p": ("p", "q")}, stretch=2)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {tuple(r)[1:] for r in found.collect()}
    assert got == {(1, "b", 2, "round", 1), (0, "round", 3, "b", 0), (None, None, 4, "round", -1), (6, "p", 7, "p", 0), (5, "round", None, None, -1)}


def test_folds_of_empty_partitions_and_null_keys(spark):
    from tolparse.operators import folds

    def start():
        return lambda n=None: [("end",)] if n is None else []

    rows = spark.createDataFrame([(None, 1), (None, 2), (1, 1), (2, 1), (2, 2)], "doc_id long, n int").repartition(1)
    assert sorted(map(tuple, folds.emitted(rows, "n", ["n"], start, "what string").collect()), key=str) == [(1, "end"), (2, "end"), (None, "end")]


def test_bags_are_read_once(spark):
    a = spark.createDataFrame([(1, "x")] * 3 + [(2, None)], "doc_id long, value string")
    b = spark.createDataFrame([(1, "x")] + [(3, "y")] * 2, "doc_id long, value string")
    passed = lambda df: df.mapInArrow(lambda parts: parts, df.schema)
    both = compare.symmetric(passed(a), passed(b))
    assert both._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    left, right = compare.difference(a, b)
    want = [(1, "x"), (1, "x"), (2, None)], [(3, "y"), (3, "y")]
    assert [sorted(map(tuple, df.collect()), key=str) for df in (left, right)] == list(want) and sorted(map(tuple, both.collect()), key=str) == sorted(want[0] + want[1], key=str)


def test_folders_of_reports_are_listed(spark, tmp_path):
    from tolparse.sources import reports

    rows = spark.createDataFrame([("words_a", "f", 0, "x"), ("words_b", "f", 0, "x"), ("words_b", "g", 1, "y")], "type string, file string, seq int, value string")
    reports.write_value_report(rows, str(tmp_path / "r"))
    folders = reports.report_folders(spark, str(tmp_path / "r"))
    assert [f.rsplit("/", 1)[1] for f in folders] == ["type=words_a", "type=words_b"]
    reports.compare_reports(spark, folders[0], folders[1], str(tmp_path / "out"))
    assert [spark.read.parquet(str(tmp_path / "out" / side)).select("file", "value").collect() for side in ("left", "right")] == [[], [("g", "y")]]


def test_blocks_are_inserted_without_a_join_to_themselves(spark, sf_dir):
    """Which blocks cut a node is found from their ids alone; before, all blocks were found once more for that."""
    from tolparse.plans.queries import _leaves_and_blocks

    nodes, lines = _leaves_and_blocks(spark, sf_dir)
    plan = trees.insert_blocks(nodes, lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and plan.count("LeftAnti") == 1
