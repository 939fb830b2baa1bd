import time

from tolparse import catalog, frames
from tolparse.parsing.lexer import _may_begin
from tolparse.plans import queries


def test_many_blocks_take_linear_time():
    """Before, each block looked at all nodes: 3,000 blocks took minutes."""
    text = "".join(f"/// begin b{k}\nint a;\n/// end\nint b;\n" for k in range(3000))
    began = time.perf_counter()
    rows = list(frames.node_rows(0, queries.code().parse(text).root))
    assert time.perf_counter() - began < 20
    assert [r[10] for r in rows if r[9] == "custom_block_start"] == [[f"b{k}"] for k in range(3000)]


def test_literals_in_either_case_are_ruled_out_by_their_first_letter():
    assert _may_begin("(?:[pP][rR])", "P") and not _may_begin("(?:[pP][rR])", "x") and _may_begin("(?:[pP][rR])?x", "x") and _may_begin("(?:[pP]*x)", "x")
    lexer = catalog.grammar("pascal").lexer
    assert len(lexer._candidates("q")) < len(lexer.rules) / 4


def test_rows_of_wanted_nodes_and_columns_only():
    root = queries.code().parse("/// begin a\nint a;\n/// end\nint b; ??;").root
    rows = list(frames.node_rows(7, root))
    names = [c.split(" ")[0] for c in frames.NODES.split(", ")]
    some = [1, 2, 3, 0, 11]
    assert list(frames.node_rows(7, root, [names[k] for k in some], lambda n: n.type == "item")) == [tuple(r[k] for k in some) for r in rows if r[9] == "item"]
