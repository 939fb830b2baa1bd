"""Documents to DataFrames of tokens, nodes, diagnostics, statistics, entities and custom blocks.

Each function is one stateless pass of the workers over (doc_id, text); parsing crosses into Python once, through Arrow, and
emits only what was asked for. Everything after it is Catalyst's. A compiled grammar is plain data of bounded size that
travels with the task.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .grammar.model import UNDEFINED
from .parsing import flat
from .parsing.engine import Parsed, Parser
from .parsing.lexer import Block
from .parsing.shapes import Shapes, entity_parts, entity_value, message_rows
from .parsing.tree import Node, spans_of

#: Documents whose rows go to Spark as one batch; of short ones, so many that their texts have at most so many bytes.
_BATCH, _SHORT, _BYTES = 64, 1024, 2**15
#: New objects after which a worker looks for garbage: trees hold each other in cycles, but one look for many of them will do.
GARBAGE = 200_000

TOKENS = "doc_id long, tok_idx int, name string, text string, start_off int, end_off int, start_line int, start_col int, direction string, pair string, depth int"
NODES = (
    "doc_id long, node_id int, last_desc int, parent_id int, child_idx int, level int, symbol string, user_symbol string, alias string, type string, value array<string>, "
    "start_off int, end_off int, start_line int, options map<string,array<string>>, args map<string,array<string>>"
)
MESSAGES = "doc_id long, seq int, type string, text string, line int, col int, offset int, source string, unexpected_token string, unexpected_lexeme string, expected array<string>"
STATS = "doc_id long, chars_count long, tokens_count long, recovery_times long, recovery_times_any long, longest_rollback long, general_ms double, recovery_ms double, has_error boolean"
ENTITIES = "doc_id long, seq int, type string, value string"
BLOCKS = "doc_id long, block_id int, parent_block_id int, name string, start_off int, end_off int, head_end int, tail_start int, start_line int, end_line int"

_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "map<string,array<string>>": pa.map_(pa.string(), pa.list_(pa.string()))}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def slices(part: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of ``_BATCH`` documents, or of ``_SHORT`` where the texts in column ``at`` are short."""
    for k in range(0, part.num_rows, _SHORT):
        own = part.slice(k, _SHORT)
        step = _SHORT if own.column(at).nbytes <= _BYTES else _BATCH
        for j in range(0, own.num_rows, step):
            yield own.slice(j, step)


def per_document(docs: DataFrame, rows: Callable[[int, str], Iterable[tuple]], schema: str) -> DataFrame:
    """Applies ``rows`` to each (doc_id, text); null texts give no rows, bytes that are no UTF-8 become replacement characters."""
    kinds = arrow_schema(schema)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(GARBAGE, 20, 100)
        for part in parts:
            for own in slices(part, 1):
                found = [r for i, t in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True) if t is not None for r in rows(i, t)]
                columns = list(zip(*found, strict=True)) if found else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return docs.select(F.col("doc_id").cast("long"), F.make_valid_utf8(F.col("text").cast("string"))).mapInArrow(batches, schema)


def tokens(docs: DataFrame, parser: Parser) -> DataFrame:
    """All tokens with nesting depth; the end of the file is left out."""

    def rows(doc: int, text: str) -> Iterator[tuple]:
        for k, t in enumerate(parser.lexer(text).tokens[:-1]):
            yield doc, k, t.name, t.text, t.start, t.end, t.line, t.column, t.direction, t.pair, t.depth

    return per_document(docs, rows, TOKENS)


def plain_tokens(docs: DataFrame, parser: Parser) -> DataFrame:
    """(doc_id, tok_idx, name, text) of all tokens, without places and nesting.

    Where the lexer can be written as one expression (``parsing.flat``), Spark's own functions find the tokens and no worker runs.
    """
    pattern = flat.expression(parser.lexer)
    if pattern is None:
        return tokens(docs, parser).select("doc_id", "tok_idx", "name", "text")
    text = F.make_valid_utf8(F.col("text").cast("string"))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("tok_idx", "text"))
    name = F.lit(UNDEFINED)
    for rule, own in reversed(flat.alternatives(parser.lexer)):
        name = F.when(F.col("text").rlike(flat.name_pattern(own)), rule).otherwise(name)
    return found.select("doc_id", "tok_idx", name.alias("name"), "text")


_NODE_COLUMNS = [c.split(" ")[0] for c in NODES.split(", ")]


def node_rows(doc: int, root: Node | None, columns: Iterable[str] = (), only: Callable[[Node], bool] | None = None) -> Iterator[tuple]:
    """Rows of a tree in pre-order, of all ``NODES`` columns or those named, and of all nodes or those that are ``only`` wanted (ids count all)."""
    if root is None:
        return
    names = list(columns) or _NODE_COLUMNS
    spans = spans_of(root) if {"start_off", "end_off", "start_line"} & set(names) else {}
    picked = [_NODE_COLUMNS.index(c) for c in names]
    none, ends = (None, None, None), "last_desc" in names
    out: list[list] = []
    stack, nr = [(root, None, 0, 0)], -1
    while stack:
        node, parent, place, level = stack.pop()
        if isinstance(node, list):  # the way back: all descendants have their rows
            node[2] = nr
            continue
        nr += 1
        if only is None or only(node):
            options = [(g, list(n)) for g, n in node.options]
            arguments = [(k, sorted(v)) for k, v in node.arguments]
            row = [doc, nr, nr, parent, place, level, node.symbol, node.shown, node.alias, node.type, node.value, *spans.get(id(node), none), options, arguments]
            out.append(row)
            if ends and node.children:
                stack.append((row, None, 0, 0))
        if node.children:
            own = [(c, nr, k, level + 1) for k, c in enumerate(node.children)]
            own.reverse()
            stack += own
    for row in out:
        yield tuple([row[k] for k in picked])


def nodes(docs: DataFrame, parser: Parser, rewrite: bool = True, columns: Iterable[str] = (), only: Callable[[Node], bool] | None = None) -> DataFrame:
    """Syntax trees in pre-order; ``node_id`` to ``last_desc`` are a node's descendants. ``rewrite=False``: raw trees.

    ``columns`` and ``only``: the columns and the nodes that leave the workers, where not all are wanted.
    """
    kinds = dict(c.split(" ") for c in NODES.split(", "))
    columns = list(columns) or list(kinds)
    return per_document(docs, lambda d, t: node_rows(d, parser.parse(t, rewrite).root, columns, only), ", ".join(f"{c} {kinds[c]}" for c in columns))


def node_counts(docs: DataFrame, parsers: dict[str, Parser], symbol: str) -> DataFrame:
    """(doc_id, a count for each parser): how many nodes of ``symbol`` its rewritten tree of each text has, all from one pass; parsers of like lexers share a text's tokens."""
    shared: dict[tuple, list[tuple[int, Parser]]] = {}
    for k, p in enumerate(parsers.values()):
        shared.setdefault(p.lexer.tells, []).append((k, p))
    name = f"count {symbol}"

    def count(root: Node | None) -> int:
        return sum([n.symbol == symbol for n in root.walk()]) if root is not None else 0

    def rows(doc: int, text: str) -> Iterator[tuple]:
        counts = [0] * len(parsers)
        for group in shared.values():
            lexed = group[0][1].lexer(text)
            for k, p in group:
                found = None if lexed.blocks or p.rewriter.steps else p.pieces(lexed.tokens)
                counts[k] = count(p.parse_tokens(lexed).root) if found is None else sum([piece.read(name, count) for piece, _ in found]) + (p.grammar.start == symbol)
        yield doc, *counts

    return per_document(docs, rows, ", ".join(["doc_id long", *(f"{n} long" for n in parsers)]))


def messages(docs: DataFrame, parser: Parser, trace: bool = False) -> DataFrame:
    def rows(doc: int, text: str) -> Iterator[tuple]:
        for k, m in enumerate(parser.parse(text, rewrite=None, trace=trace).messages):
            yield doc, k, m.kind, m.text, m.line, m.column, m.offset, m.source, m.unexpected_token, m.unexpected_lexeme, list(m.expected)

    return per_document(docs, rows, MESSAGES)


def stats(docs: DataFrame, parser: Parser) -> DataFrame:
    """One row per document."""

    def rows(doc: int, text: str) -> Iterator[tuple]:
        s, has_error = parser.statistics_of(text)
        yield doc, s.chars_count, s.tokens_count, s.recovery_times, s.recovery_times_any, s.longest_rollback, s.general_ms, s.recovery_ms, has_error

    return per_document(docs, rows, STATS)


def entity_rows(parsed: Parsed, types: frozenset[str], names: frozenset[str]) -> Iterator[tuple[int, str, str]]:
    """(seq, type, value) in pre-order of the nodes whose alias or symbol is wanted."""
    for k, (kind, parts) in enumerate(entity_parts(parsed.root, types, names)):
        yield k, kind, entity_value(parts)


def entities(docs: DataFrame, parser: Parser, types: Iterable[str], names: Iterable[str] = ("name",), with_errors: bool = False) -> DataFrame:
    """Entities of the given types; documents with errors give none unless ``with_errors``."""
    types, names = frozenset(types), frozenset(names)

    def rows(doc: int, text: str) -> Iterator[tuple]:
        parsed = parser.parse(text)
        if with_errors or not parsed.has_error:
            for found in entity_rows(parsed, types, names):
                yield doc, *found

    return per_document(docs, rows, ENTITIES)


def entities_holding(docs: DataFrame, parser: Parser, types: Iterable[str], held: Iterable[str], names: Iterable[str] = ("name",)) -> DataFrame:
    """Entities of the given types with a column for each type in ``held``: how many of their children are of it. Documents with errors give theirs too."""
    types, names, held = frozenset(types), frozenset(names), tuple(held)

    def rows(doc: int, text: str) -> Iterator[tuple]:
        root = parser.parse(text).root
        found = (n for n in root.walk() if n.alias in types or n.symbol in types) if root is not None else ()
        for k, n in enumerate(found):
            kinds = [c.type for c in n.children]
            yield doc, k, n.type, entity_value([c.text() for c, kind in zip(n.children, kinds, strict=True) if kind in names]), *map(kinds.count, held)

    return per_document(docs, rows, ", ".join([ENTITIES, *(f"{h} long" for h in held)]))


def _rest(columns: str) -> str:
    """Columns (DDL) without the document's, as those of a struct."""
    return ",".join(c.replace(" ", ":", 1) for c in columns.split(", ")[1:])


#: What one pass can give of a document: a struct of statistics, arrays of structs of the rest.
OUTPUTS = {"stats": f"struct<{_rest(STATS)}>", "messages": f"array<struct<{_rest(MESSAGES)}>>", "entities": f"array<struct<{_rest(ENTITIES)}>>", "nodes": f"array<struct<{_rest(NODES)}>>"}


def _output(name: str) -> pa.DataType:
    columns = {"stats": STATS, "messages": MESSAGES, "entities": ENTITIES, "nodes": NODES}[name]
    row = pa.struct(list(arrow_schema(columns))[1:])
    return row if name == "stats" else pa.list_(row)


def outcomes(docs: DataFrame, parser: Parser, want: Iterable[str] = ("stats",), types: Iterable[str] = (), names: Iterable[str] = ("name",)) -> DataFrame:
    """``docs`` with ``has_error`` and the columns in ``want`` (of ``OUTPUTS``), all from one parse of each text.

    Documents with errors have no entities. A null text stays, without error, and what is wanted of it is null; columns of
    ``docs`` that are named like the added ones are replaced. No shuffle; each row is a document of its own, whatever its id.
    """
    want, types, names = tuple(want), frozenset(types), frozenset(names)
    kept = docs.drop("has_error", *want)
    at, kinds = kept.columns.index("text"), [_output(w) for w in want]
    tree = bool({"entities", "nodes"} & set(want))
    shapes = Shapes(parser, types, names, tree) if Shapes.fit(parser) and "nodes" not in want else None

    def one(text: str | None) -> list:
        if text is None:
            return [False, *(None for _ in want)]
        if shapes and not (parser.flat and want in (("stats",), ())):
            s, failed, found, own = shapes(text)
            made = {"messages": lambda: found, "entities": lambda: own}
        elif want in (("stats",), ()):
            s, failed = parser.statistics_of(text)
            made = {}
        else:
            parsed = parser.parse(text, True if tree else None)
            s, failed = parsed.statistics, parsed.has_error
            made = {
                "messages": lambda: message_rows(parsed.messages),
                "entities": lambda: [] if failed else list(entity_rows(parsed, types, names)),
                "nodes": lambda: [r[1:] for r in node_rows(0, parsed.root)],
            }
        made["stats"] = lambda: (s.chars_count, s.tokens_count, s.recovery_times, s.recovery_times_any, s.longest_rollback, s.general_ms, s.recovery_ms, failed)
        return [failed, *(made[w]() for w in want)]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(GARBAGE, 20, 100)
        for part in parts:
            for own in slices(part, at):
                found = list(zip(*map(one, own.column(at).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, kind) for c, kind in zip(found, [pa.bool_(), *kinds], strict=True))], [*own.schema.names, "has_error", *want])

    schema = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in kept.schema.fields)
    valid = kept.withColumn("text", F.make_valid_utf8(F.col("text").cast("string")))
    return valid.mapInArrow(batches, ", ".join([schema, "has_error boolean", *(f"{w} {OUTPUTS[w]}" for w in want)]))


def register_functions(spark: SparkSession, name: str, parser: Parser, types: Iterable[str] = (), names: Iterable[str] = ("name",)) -> None:
    """Table functions for SQL: ``<name>_tokens(text)``, ``<name>_nodes(text)``, ``<name>_messages(text)`` and ``<name>_entities(text)`` (of ``types``).

    ``SELECT d.doc_id, t.* FROM documents d, LATERAL java_entities(d.text) t``. A null text gives no rows. Rows go to Spark by Arrow.
    """
    kinds, texts = frozenset(types), frozenset(names)
    made: dict[str, tuple[str, Callable[[str], Iterable[tuple]]]] = {
        "tokens": (TOKENS, lambda t: ((k, x.name, x.text, x.start, x.end, x.line, x.column, x.direction, x.pair, x.depth) for k, x in enumerate(parser.lexer(t).tokens[:-1]))),
        "nodes": (NODES, lambda t: (r[1:-2] + (dict(r[-2]), dict(r[-1])) for r in node_rows(0, parser.parse(t).root))),
        "messages": (MESSAGES, lambda t: ((k, m.kind, m.text, m.line, m.column, m.offset, m.source, m.unexpected_token, m.unexpected_lexeme, list(m.expected)) for k, m in enumerate(parser.parse(t, rewrite=None).messages))),
        "entities": (ENTITIES, lambda t: entity_rows(parser.parse(t), kinds, texts)),
    }
    for kind, (schema, rows) in made.items():
        columns = schema.removeprefix("doc_id long, ")

        class Function:
            _rows = staticmethod(rows)

            def eval(self, text: str):
                if text is not None:
                    yield from self._rows(text)

        spark.udtf.register(f"{name}_{kind}", udtf(Function, returnType=columns, useArrow=True))


def blocks(docs: DataFrame, parser: Parser) -> DataFrame:
    """Closed custom blocks, outer ones before inner ones; the lexeme that begins one ends at ``head_end``, and the one that ends it begins at ``tail_start``."""

    def rows(doc: int, text: str) -> Iterator[tuple]:
        todo: list[tuple[Block, int | None]] = [(b, None) for b in reversed(parser.lexer(text).blocks)]
        nr = 0
        while todo:
            block, parent = todo.pop()
            yield doc, nr, parent, block.name, block.start.start, block.end.end, block.start.end, block.end.start, block.start.line, block.end.line
            todo += [(c, nr) for c in reversed(block.children)]
            nr += 1

    return per_document(docs, rows, BLOCKS)
