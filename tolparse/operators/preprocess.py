"""Texts without excluded segments, and offsets brought back to the whole text; conditional compilation; pipelines."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..frames import GARBAGE, messages, nodes, per_document
from ..parsing.engine import Parser
from ..parsing.lexer import Token
from ..parsing.pieces import Piece
from ..parsing.tree import Node

EXCLUDED = "doc_id long, start_off int, end_off int"
_CUTS = pa.list_(pa.struct([("start_off", pa.int32()), ("end_off", pa.int32())]))


def condition(node: Node, defined: frozenset[str] | set[str], word: Callable[[Node], str] = lambda n: "".join(n.value)) -> bool:
    """A C# condition: names, ``true``, ``! && ||`` and brackets; ``word`` gives a leaf's text."""
    names = {"condition": any, "both": all}
    if node.symbol in names:
        return names[node.symbol](condition(c, defined, word) for c in node.children if c.symbol in ("both", "atom"))
    if node.symbol == "atom":
        inner = next(c for c in node.children if c.symbol in ("atom", "condition", "ID"))
        return condition(inner, defined, word) != any(word(c) == "!" for c in node.children)
    name = word(node)
    return name == "true" or name in defined


def excluded_by_directives(text: str, parser: Parser, predefined: Iterable[str] = ()) -> list[tuple[int, int]]:
    """Closed segments that conditional compilation leaves out.

    A segment begins with the directive that turns compiling off and ends with the line of the one that turns it on again
    (for directives in braces: with the directive). Directives in a part left out do not count; an ``#if`` without end
    leaves out the rest.
    """
    lexed = parser.lexer(text)
    pieces = None if lexed.blocks or parser.rewriter.steps else parser.pieces(lexed.tokens)
    if pieces is None and (root := parser.parse_tokens(lexed).root) is None:
        return []
    found = _directives(root) if pieces is None else _directives_of(pieces, lexed.tokens)
    defined, out = set(predefined), []
    levels: list[dict] = []
    begin: int | None = None

    def off(at: int) -> None:
        nonlocal begin
        begin = at if begin is None else begin

    def on(end: int) -> None:
        nonlocal begin
        if begin is not None:
            out.append((begin, end))
        begin = None

    for kind, names, test, start, end in found:
        if not text.startswith("}", end) and not text.startswith("*)", end - 1):  # it reaches to its line's end
            stop = text.find("\n", end)
            end = len(text) - 1 if stop < 0 else stop
        live = not levels or levels[-1]["live"]
        if kind in ("if", "ifdef", "ifndef"):
            if kind == "if":
                holds = live and test(defined)
            else:
                holds = live and (names[0] in defined) == (kind == "ifdef")
            levels.append({"outer": live, "live": holds, "done": holds})
            if live and not holds:
                off(start)
        elif kind in ("elif", "else") and levels:
            own = levels[-1]
            if not own["outer"]:
                continue
            holds = not own["done"] and (kind == "else" or test(defined))
            if own["live"]:
                off(start)
            elif holds:
                on(end)
            own["live"], own["done"] = holds, own["done"] or holds
        elif kind == "endif" and levels:
            own = levels.pop()
            if own["outer"] and not own["live"]:
                on(end)
        elif kind == "define" and live:
            defined |= set(names)
        elif kind == "undef" and live:
            defined -= set(names)
    if begin is not None:
        out.append((begin, len(text) - 1))
    return out


_KINDS = ("if", "elif", "else", "endif", "define", "undef", "ifdef", "ifndef")
#: (kind, names, what tells whether its condition holds, first offset, last offset)
Directive = tuple[str, list[str], Callable[[set[str]], bool], int, int]


def _directive_nodes(root: Node) -> list[tuple[str, list[Node], Node | None, int, int]]:
    """(kind, nodes of names, condition, begin, end) of each directive."""
    out = []
    for n in root.walk():
        if n.type in _KINDS:
            outer = n.parent if n.parent is not None and n.parent.symbol == "directive" else n
            start, end, _ = outer.span()
            out.append((n.type, [c for c in n.children if c.symbol == "ID"], next((c for c in n.children if c.symbol == "condition"), None), start, end))
    return out


def _directives(root: Node) -> Iterator[Directive]:
    for kind, names, test, start, end in _directive_nodes(root):
        yield kind, ["".join(c.value) for c in names], partial(condition, test), start, end


def _directives_of(pieces: list[tuple[Piece, int]], tokens: list[Token]) -> Iterator[Directive]:
    """The same from the pieces of a text, whose nodes have numbers of tokens in place of texts and offsets."""
    for piece, at in pieces:
        for kind, names, test, start, end in piece.read("directives", _directive_nodes):
            word = lambda n, at=at: "".join([tokens[at + k].text for k in n.value])
            yield kind, [word(c) for c in names], partial(condition, test, word=word), tokens[at + start].start, tokens[at + end].end


def excluded(docs: DataFrame, parser: Parser, predefined: Iterable[str] = ()) -> DataFrame:
    """(doc_id, start_off, end_off) of what conditional compilation leaves out of each document."""
    names = frozenset(predefined)
    return per_document(docs, lambda d, t: ((d, s, e) for s, e in excluded_by_directives(t, parser, names)), EXCLUDED)


def excluded_by_pattern(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, start_off, end_off) of all matches of a regular expression."""
    compiled = re.compile(pattern, re.S)
    return per_document(docs, lambda d, t: ((d, m.start(), m.end() - 1) for m in compiled.finditer(t) if m.end() > m.start()), EXCLUDED)


def without_pattern(docs: DataFrame, pattern: str) -> DataFrame:
    """Documents' texts without the matches of a regular expression, for which no segments are needed."""
    return docs.withColumn("text", F.regexp_replace("text", f"(?s){pattern}", ""))


def cut(docs: DataFrame, find: Callable[[str], Iterable[tuple[int, int]]]) -> DataFrame:
    """``docs`` with the segments that ``find`` gives cut out of ``text``, and these as ``cuts``, in the pass that finds them.

    Where ``find`` fails, the text stays whole, and ``cut_error`` says why. Null texts stay null.
    """
    kept = docs.drop("cuts", "cut_error")
    at = kept.columns.index("text")

    def one(text: str | None) -> tuple[str | None, list, str | None]:
        if text is None:
            return None, [], None
        try:
            cuts = sorted(set(find(text)))
        except Exception as e:  # whatever it is, the document goes on as it was
            return text, [], f"{type(e).__name__}: {e}"
        parts, begin = [], 0
        for s, e in cuts:
            parts.append(text[begin:s])
            begin = e + 1
        return "".join([*parts, text[begin:]]), [{"start_off": s, "end_off": e} for s, e in cuts], None

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(GARBAGE, 20, 100)
        for part in parts:
            for k in range(0, part.num_rows, 256):
                own = part.slice(k, 256)
                found = [one(t) for t in own.column(at).to_pylist()]
                columns = [pa.array([f[0] for f in found], pa.string()) if n == at else c for n, c in enumerate(own.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([f[1] for f in found], _CUTS), pa.array([f[2] for f in found], pa.string())], [*own.schema.names, "cuts", "cut_error"])

    schema = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in kept.schema.fields)
    valid = kept.withColumn("text", F.make_valid_utf8(F.col("text").cast("string")))
    return valid.mapInArrow(batches, f"{schema}, cuts array<struct<start_off:int,end_off:int>>, cut_error string")


def segments(cut_docs: DataFrame) -> DataFrame:
    """(doc_id, start_off, end_off) of documents' ``cuts``."""
    return cut_docs.select("doc_id", F.explode("cuts").alias("c")).select("doc_id", "c.start_off", "c.end_off")


def without(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """Documents' texts without segments that came from elsewhere (repeated ones count once; they must not overlap)."""
    cuts = segments.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start_off", "end_off"))).alias("_cuts"))
    joined = docs.join(cuts, "doc_id", "left")
    cuts_or_none = F.coalesce("_cuts", F.array().cast("array<struct<start_off:int,end_off:int>>"))
    begins = F.concat(F.array(F.lit(0)), F.transform(cuts_or_none, lambda c: c["end_off"] + 1))
    ends = F.concat(F.transform(cuts_or_none, lambda c: c["start_off"]), F.array(F.length("text")))
    kept = F.zip_with(begins, ends, lambda b, e: F.substr(F.col("text"), b + 1, e - b))
    return joined.withColumn("text", F.array_join(kept, "")).drop("_cuts")


def _as_of(rows: DataFrame, marks: DataFrame, offset: str, fields: dict[str, str]) -> DataFrame:
    """``rows`` with the ``fields`` (column of ``marks`` -> new name) of the last of ``marks`` (doc_id, _at, ...) at or before their offset.

    Both are sorted together in one window; rows without an offset get null.
    """
    kept = [c for c in rows.columns if c not in ("doc_id", *fields.values())]
    right = rows.select("doc_id", F.col(offset).alias("_at"), F.lit(1).alias("_kind"), F.struct(*kept).alias("_row"), *(F.lit(None).cast(marks.schema[c].dataType).alias(c) for c in fields))
    left = marks.select("doc_id", "_at", F.lit(0).alias("_kind"), F.lit(None).cast(right.schema["_row"].dataType).alias("_row"), *fields)
    so_far = W.Window.partitionBy("doc_id").orderBy("_at", "_kind", *fields).rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    last = {f"_so_far_{c}": F.when(F.col("_at").isNotNull(), F.last(c, ignorenulls=True).over(so_far)) for c in fields}
    return left.unionByName(right).withColumns(last).filter("_kind = 1").select("doc_id", "_row.*", *(F.col(f"_so_far_{c}").alias(n) for c, n in fields.items()))


def remap(rows: DataFrame, segments: DataFrame, offset: str = "start_off", out: str = "whole_off") -> DataFrame:
    """Adds ``out``: the offset in the whole text of an offset in the text without ``segments``.

    As-of by one window: cuts, at their places in the shortened text, carry the length removed so far. Repeated segments, as
    of repeated documents, count once.
    """
    segments = segments.select("doc_id", "start_off", "end_off").distinct()
    removed = F.col("end_off") - F.col("start_off") + 1
    total = F.sum(removed).over(W.Window.partitionBy("doc_id").orderBy("start_off").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow))
    cuts = segments.select("doc_id", (F.col("start_off") - total + removed).cast("int").alias("_at"), total.cast("int").alias("_removed"))
    placed = _as_of(rows, cuts, offset, {"_removed": out})
    return placed.withColumn(out, (F.col(offset) + F.coalesce(out, F.lit(0))).cast("int"))


def located(rows: DataFrame, docs: DataFrame, offset: str = "start_off", line: str = "line", col: str = "col") -> DataFrame:
    """Adds the line (from 1) and column (from 0) of an offset in its document's text; documents of one id have one text."""
    sizes = docs.select("doc_id", "text").dropDuplicates(["doc_id"]).select("doc_id", F.posexplode(F.transform(F.split("text", "\n", -1), F.length)).alias("_nr", "_size"))
    before = W.Window.partitionBy("doc_id").orderBy("_nr").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = sizes.select("doc_id", F.coalesce(F.sum(F.col("_size") + 1).over(before), F.lit(0)).cast("int").alias("_at"), (F.col("_nr") + 1).alias("_line"))
    placed = _as_of(rows, starts.withColumn("_begin", F.col("_at")), offset, {"_line": line, "_begin": col})
    return placed.withColumn(col, F.col(offset) - F.col(col))


@dataclass(frozen=True)
class Preprocessor:
    """A change of documents before parsing, and of nodes and messages after it; ``settings`` are its own business.

    ``before`` may add columns to the documents it gives; ``after`` and ``messages`` get these documents as their second argument.
    """

    before: Callable[[DataFrame], DataFrame] = lambda docs: docs
    after: Callable[[DataFrame, DataFrame], DataFrame] = lambda nodes, docs: nodes
    messages: Callable[[DataFrame, DataFrame], DataFrame] = lambda messages, docs: messages
    name: str = "noop"
    settings: tuple[tuple[str, str], ...] = ()


def pipeline(*parts: Preprocessor) -> Preprocessor:
    """Several in a row: all directions run in the given order, each part on what the part before gave."""

    def before(docs: DataFrame) -> DataFrame:
        for p in parts:
            docs = p.before(docs)
        return docs

    def chain(which: str):
        def run(df: DataFrame, docs: DataFrame) -> DataFrame:
            for p in parts:
                df = getattr(p, which)(df, docs)
            return df

        return run

    return Preprocessor(before, chain("after"), chain("messages"), " | ".join(p.name for p in parts))


def conditional(parser: Parser, predefined: Iterable[str] = ()) -> Preprocessor:
    """Conditional compilation: documents without what is left out, found and cut in one pass; offsets, lines and columns brought back.

    A document whose directives cannot be read goes on whole (``cut_error``). Documents keep the whole text as ``whole_text``.
    """
    names = frozenset(predefined)

    def before(docs: DataFrame) -> DataFrame:
        return cut(docs.withColumn("whole_text", F.col("text")), lambda t: excluded_by_directives(t, parser, names))

    def back(rows: DataFrame, docs: DataFrame, columns: list[str]) -> DataFrame:
        for c in columns:
            rows = remap(rows, segments(docs), c, "_whole").withColumn(c, F.col("_whole")).drop("_whole")
        return rows

    def whole(docs: DataFrame) -> DataFrame:
        return docs.select("doc_id", F.col("whole_text").alias("text"))

    def after(nodes: DataFrame, docs: DataFrame) -> DataFrame:
        moved = back(nodes, docs, ["start_off", "end_off"])
        if "start_line" in nodes.columns:
            moved = located(moved, whole(docs), "start_off", "start_line", "_col")
        return moved.select(*nodes.columns)

    def messages(found: DataFrame, docs: DataFrame) -> DataFrame:
        return located(back(found, docs, ["offset"]), whole(docs), "offset").select(*found.columns)

    return Preprocessor(before, after, messages, "conditional", (("predefined", ";".join(sorted(names))),))


def nodes_through(docs: DataFrame, parser: Parser, prep: Preprocessor) -> DataFrame:
    """The nodes of preprocessed documents, with offsets and lines of the whole texts."""
    cut_docs = prep.before(docs)
    return prep.after(nodes(cut_docs, parser), cut_docs)


def messages_through(docs: DataFrame, parser: Parser, prep: Preprocessor) -> DataFrame:
    """The messages of preprocessed documents, with offsets, lines and columns of the whole texts."""
    cut_docs = prep.before(docs)
    return prep.messages(messages(cut_docs, parser), cut_docs)


def pascal_nodes(docs: DataFrame) -> DataFrame:
    """Pascal's chain: directives first, then parsing, then routines with all that belongs to them below them."""
    from .. import catalog
    from ..parsing import visitors

    return nodes_through(docs, visitors.with_visitors(catalog.grammar("pascal"), visitors.aggregate_routines), conditional(catalog.grammar("pascal_directives")))


#: Preprocessors by name, for configurations that name them.
REGISTRY: dict[str, Callable[..., Preprocessor]] = {"noop": Preprocessor, "conditional": conditional}


def register(name: str, make: Callable[..., Preprocessor]) -> None:
    REGISTRY[name] = make
