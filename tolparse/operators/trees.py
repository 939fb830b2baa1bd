"""Tree rewriting and tree queries on ``nodes`` tables, as relational algebra over the nested-set numbers.

A node's descendants are the rows of its document with ``node_id < id <= last_desc``. What needs a node's ancestors or all that
is below it comes from one window, or from one fold over the document's sorted rows (``folds``), never from a range join.

A document is told by ``doc_id``, and its rows by ``node_id``: the rows of two documents that share an id, or have none, are taken
for one document's, so give such documents numbers of their own first (``numbered_documents``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.types import StructType

from ..grammar.model import BLOCK
from . import folds
from . import spans as span_matches

DOC = "doc_id"


def _marked_below(nodes: DataFrame, marked: Column) -> Column:
    """Whether a row is below a marked one: the furthest end of the marked rows before it reaches it."""
    before = W.Window.partitionBy(DOC).orderBy("node_id").rowsBetween(W.Window.unboundedPreceding, -1)
    return F.coalesce(F.max(F.when(marked, F.col("last_desc"))).over(before) >= F.col("node_id"), F.lit(False))


def drop_subtrees(nodes: DataFrame, marked: Column) -> DataFrame:
    """Deletes marked nodes with all below them (void)."""
    return nodes.withColumn("_below", _marked_below(nodes, marked)).filter(~F.col("_below") & ~F.coalesce(marked, F.lit(False))).drop("_below")


def numbered_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with ``doc_id`` replaced by a number of each row's own, and the old one as ``given_id``: for documents that share ids or have none."""
    return docs.withColumn("given_id", F.col("doc_id")).withColumn("doc_id", F.monotonically_increasing_id())


def ancestors(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, ancestor_id) for all pairs, from the nodes that are open at each, in one sorted pass."""

    def start():
        stack: list[tuple[int, int]] = []

        def step(node: int | None = None, last: int = -1):
            if node is None:
                return ()
            while stack and stack[-1][0] < node:
                stack.pop()
            found = [(node, own) for _, own in stack]
            stack.append((last, node))
            return found

        return step

    return folds.emitted(nodes, "node_id", ["node_id", "last_desc"], start, "node_id int, ancestor_id int", DOC)


def _spliced(nodes: DataFrame, above: bool) -> DataFrame:
    """Without the nodes marked by ``_gone``; with ``above``, of these only those below a node of their own symbol."""

    def start():
        stack: list[list] = []  # open nodes: end, symbol, nearest kept ancestor (the node itself if it is kept), and the children that one has so far

        def step(node: int, last: int, parent: int | None, symbol: str | None, gone: bool | None) -> tuple[bool, int | None, int]:
            while stack and stack[-1][0] < node:
                stack.pop()
            gone = bool(gone) and parent is not None and (not above or bool(stack) and stack[-1][1] == symbol)
            kept, counter = (stack[-1][2], stack[-1][3]) if stack else (None, [0])
            if gone:
                stack.append([last, symbol, kept, counter])
                return True, None, 0
            place = counter[0]
            counter[0] += 1
            stack.append([last, symbol, node, [0]])
            return False, kept, place

        return step

    symbols = nodes if "symbol" in nodes.columns else nodes.withColumn("symbol", F.lit(None).cast("string"))
    folded = folds.add_columns(symbols, "node_id", ["node_id", "last_desc", "parent_id", "symbol", "_gone"], start, "_out boolean, _parent int, _place int", DOC)
    kept = folded.filter(~F.col("_out")).withColumns({"parent_id": F.col("_parent"), "child_idx": F.col("_place")})
    return kept.select(*(c for c in nodes.columns if c != "_gone"))


def splice(nodes: DataFrame, marked: Column) -> DataFrame:
    """Deletes marked nodes; their children take their place (ghost, generated nodes) and are numbered anew. The root is kept.

    One sorted pass finds each row's nearest kept ancestor: no join, and no round for each level of nested marked nodes.
    """
    return _spliced(nodes.withColumn("_gone", F.coalesce(marked, F.lit(False))), above=False)


def renumber(nodes: DataFrame) -> DataFrame:
    """Children of each parent numbered anew in the order of their ids."""
    return nodes.withColumn("child_idx", (F.row_number().over(W.Window.partitionBy(DOC, "parent_id").orderBy("node_id")) - 1).cast("int"))


def flatten_lists(nodes: DataFrame, symbols: Iterable[str]) -> DataFrame:
    """Splices list nodes into parents of the same symbol, however deep."""
    return _spliced(nodes.withColumn("_gone", F.col("symbol").isin(list(symbols))), above=True)


def collapse_leaves(nodes: DataFrame, symbols: Iterable[str]) -> DataFrame:
    """Nodes of the given symbols get the token texts below them as their value and lose their descendants; the outermost counts.

    One sorted pass: only the leaf that is open is held, with its texts.
    """
    leaves = frozenset(symbols)
    out = StructType([f for f in nodes.schema.fields if f.name != DOC])
    at_value, at_last = out.names.index("value"), out.names.index("last_desc")

    def start():
        leaf: list | None = None

        def step(node: int | None = None, last: int = -1, symbol: str | None = None, value=(), row: dict | None = None):
            nonlocal leaf
            found = []
            if leaf is not None:
                if node is not None and node <= leaf[0]:
                    leaf[1][at_value] += value or []
                    return ()
                found.append(leaf[1])
                leaf = None
            if node is not None:
                own = list(row.values())
                if symbol in leaves:
                    own[at_value], own[at_last] = list(value or ()), node
                    leaf = [last, own]
                else:
                    found.append(own)
            return found

        return step

    rows = nodes.withColumn("_row", F.struct(*(F.col(c) for c in out.names)))
    return folds.emitted(rows, "node_id", ["node_id", "last_desc", "symbol", "value", "_row"], start, out, DOC).select(*nodes.columns)


def merge_adjacent(rows: DataFrame, keys: Iterable[str], order: str, is_water: Column, is_empty: Column, value: str = "value", start: str = "start_off", end: str = "end_off") -> DataFrame:
    """Merges neighbouring water rows: each begins an island unless it is water, not empty, and follows water."""
    keys = list(keys)
    w = W.Window.partitionBy(*keys).orderBy(order)
    begins = ~(is_water & ~is_empty & F.coalesce(F.lag(is_water).over(w), F.lit(False)))
    islands = rows.withColumn("_b", begins).withColumn("_island", F.sum(F.col("_b").cast("int")).over(w))
    merged = {start: F.min(start).alias(start), end: F.max(end).alias(end)}
    merged[value] = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"])).alias(value)
    others = [F.min_by(c, F.col(order)).alias(c) for c in rows.columns if c not in (*keys, start, end, value)]
    return islands.groupBy(*keys, "_island").agg(*others, *merged.values()).select(*rows.columns)


def subtree_text(nodes: DataFrame, wanted: Column) -> DataFrame:
    """(doc_id, node_id, text): the concatenated token texts below each wanted node that has any, in one sorted pass."""

    def start():
        stack: list[tuple[int, int, list[str]]] = []  # open wanted nodes: end, id, texts

        def step(node: int | None = None, last: int = -1, value=(), asked: bool | None = None):
            out = []
            while stack and (node is None or stack[-1][0] < node):
                _, own, texts = stack.pop()
                if texts:
                    out.append((own, "".join(texts)))
            if asked:
                stack.append((last, node, []))
            if value:
                text = "".join(value)
                for _, _, texts in stack:
                    texts.append(text)
            return out

        return step

    return folds.emitted(nodes.withColumn("_asked", F.coalesce(wanted, F.lit(False))), "node_id", ["node_id", "last_desc", "value", "_asked"], start, "node_id int, text string", DOC)


def spans(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, start_off, end_off): the hull of a node's own place and those of all below it, in one sorted pass."""

    def start():
        stack: list[list] = []  # open nodes: end, id, first and last offset

        def step(node: int | None = None, last: int = -1, begin: int | None = None, end: int | None = None):
            out = []
            while stack and (node is None or stack[-1][0] < node):
                _, own, low, high = stack.pop()
                if low is not None:
                    out.append((own, low, high))
                    if stack:
                        up = stack[-1]
                        up[2], up[3] = (low, high) if up[2] is None else (min(low, up[2]), max(high, up[3]))
            if node is not None:
                stack.append([last, node, begin, end])
            return out

        return step

    return folds.emitted(nodes, "node_id", ["node_id", "last_desc", "start_off", "end_off"], start, "node_id int, start_off int, end_off int", DOC)


def water(nodes: DataFrame) -> DataFrame:
    """Segments of all wildcards that matched something."""
    return nodes.filter("symbol = 'Any' and start_off is not null").select(DOC, "node_id", "start_off", "end_off")


# Blocks.


def _cutting(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(_doc, _block): the ids of ``cutting_blocks``."""
    own = blocks.select(DOC, "block_id", "start_off", "end_off")
    below = nodes.filter("node_id > 0 and start_off is not null").select(DOC, "start_off", "end_off", (F.col("node_id") == F.col("last_desc")).alias("leaf"))
    across = span_matches.matches(own, below, "overlaps").filter("not (right.start_off <= left.start_off and left.end_off <= right.end_off)").select(DOC, "left.block_id")
    held = span_matches.matches(below.filter("leaf"), own, "includes").filter("left.start_off <> right.start_off or left.end_off <> right.end_off").select(DOC, "right.block_id")
    return across.unionByName(held).distinct().select(F.col(DOC).alias("_doc"), F.col("block_id").alias("_block"))


def cutting_blocks(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """The rows of ``blocks`` (doc_id, block_id, start_off, end_off, ...) that cannot be nodes: an end of theirs is within a node that they do not hold, or they are within a leaf.

    The root may be cut: blocks before, behind and across its ends come below it. By two plane sweeps (``spans.matches``).
    """
    bad = _cutting(nodes, blocks)
    return blocks.join(bad, F.col(DOC).eqNullSafe(F.col("_doc")) & (F.col("block_id") == F.col("_block")), "left_semi")


class _Frame:
    """An open node or block: its row, its id, its last descendant's old id or its last offset, and how many children it has."""

    __slots__ = ("block", "children", "end", "id", "last", "row", "waiting")

    def __init__(self, row: dict, own: int, last: int | None, end: int | None, block: dict | None):
        self.row, self.id, self.last, self.end, self.block = row, own, last, end, block
        self.children, self.waiting = 0, []


class _Inserting:
    """One document's nodes in pre-order, with its blocks opened and closed between them; rows are given as they close."""

    def __init__(self, columns: list[str]):
        self.columns = columns
        self.blocks: list[dict] = []
        self.next = self.count = 0
        self.root, self.hull, self.placed = -1, [], False
        self.stack: list[_Frame] = []
        self.out: list[tuple] = []

    def push(self, row: dict, last: int | None, end: int | None, block: dict | None = None) -> None:
        up = self.stack[-1] if self.stack else None
        row = row | {"node_id": self.count, "parent_id": up.id if up else None, "child_idx": up.children if up else 0, "level": len(self.stack)}
        if up:
            up.children += 1
        self.stack.append(_Frame(row, self.count, last, end, block))
        self.count += 1

    def pop(self) -> None:
        done = self.stack.pop()
        done.row["last_desc"] = self.count - 1
        if done.id == self.root and self.hull and (self.placed or done.row["start_off"] is None):  # a root that reaches as far as what is below it
            own = [x for x in (done.row["start_off"], done.row["end_off"]) if x is not None]
            done.row |= {"start_off": min([*own, *self.hull]), "end_off": max([*own, *self.hull])}
        self.out.append(tuple(done.row.get(c) for c in self.columns))

    def edge(self, block: dict, which: str, value: str, start: int, end: int, line: int) -> None:
        self.push({"symbol": which, "type": which, "value": [value], "start_off": start, "end_off": end, "start_line": line, "options": [], "args": []}, None, None)
        self.pop()

    def begin(self, b: dict) -> None:
        if self.stack and self.stack[-1].id == self.root:
            self.hull += [b["start_off"], b["end_off"]]
        self.push({"symbol": BLOCK, "type": BLOCK, "value": [], "start_off": b["start_off"], "end_off": b["end_off"], "start_line": b["start_line"], "options": [], "args": []}, None, b["end_off"], b)
        self.edge(b, f"{BLOCK}_start", b["name"], b["start_off"], b["head_end"], b["start_line"])

    def end_block(self) -> None:
        b = self.stack[-1].block
        self.empty_ones(b["end_off"])
        self.edge(b, f"{BLOCK}_end", "", b["tail_start"], b["end_off"], b["end_line"])
        self.pop()

    def empty_ones(self, upto: int | None) -> None:
        """Blocks that end there at the latest, and hold no node: each with those within it."""
        depth = len(self.stack)
        while self.next < len(self.blocks) and (upto is None or self.blocks[self.next]["end_off"] <= upto):
            b = self.blocks[self.next]
            while len(self.stack) > depth and self.stack[-1].end < b["start_off"]:
                self.end_block()
            self.next += 1
            self.begin(b)
        while len(self.stack) > depth:
            self.end_block()

    def unplaced(self, frame: _Frame) -> None:
        """The nodes without a place that have come below ``frame`` since the last one with a place."""
        rows, frame.waiting = frame.waiting, []
        depth = len(self.stack)
        for node, last, row in rows:
            while len(self.stack) > depth and self.stack[-1].last < node:
                self.pop()
            self.push(row, last, None)
        while len(self.stack) > depth:
            self.pop()

    def finish(self) -> None:
        """Closes the innermost node, and the blocks open within it."""
        at = max(k for k, f in enumerate(self.stack) if f.block is None)
        while len(self.stack) > at + 1:
            self.end_block()
        frame = self.stack[at]
        self.unplaced(frame)
        if frame.id == self.root:
            self.empty_ones(None)
        elif frame.end is not None:
            self.empty_ones(frame.end)
        self.pop()

    def add(self, node: int, last: int, start: int | None, end: int | None, row: dict) -> None:
        if not self.count:
            self.blocks.sort(key=lambda b: (b["start_off"], -b["end_off"]))
            around = [b for b in self.blocks if start is not None and b["start_off"] <= start and end <= b["end_off"]]
            self.blocks = [b for b in self.blocks if not any(b is a for a in around)]
            for b in around:
                self.begin(b)
            self.root = self.count
            self.push(row, last, end)
            return
        while True:
            host = next(f for f in reversed(self.stack) if f.block is None)
            if host.last >= node:
                break
            self.finish()
        if start is None:
            host.waiting.append((node, last, row))
            return
        self.placed = self.placed or host.id == self.root
        while self.stack[-1].block is not None and self.stack[-1].end < start:
            self.end_block()
        self.unplaced(host)
        self.empty_ones(start - 1)
        while self.next < len(self.blocks) and self.blocks[self.next]["start_off"] <= start and end <= self.blocks[self.next]["end_off"]:
            self.next += 1
            self.begin(self.blocks[self.next - 1])
        self.push(row, last, end)

    def close(self) -> None:
        while self.stack:
            if self.stack[-1].block is not None and not any(f.block is None for f in self.stack):
                self.end_block()
            else:
                self.finish()

    def given(self) -> list[tuple]:
        rows, self.out = self.out, []
        return rows


def insert_blocks(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """``nodes`` with a node for each of ``blocks`` (as ``frames.blocks`` gives them) around the siblings, or the root, that it holds; ids and places are new.

    Blocks that cut a node are left out (``cutting_blocks`` has them). A block that holds nothing comes before the first sibling behind
    it; one outside the root's segment comes below the root; nodes without a place stay between the same neighbours, outside a block that
    ends or begins there. Two streams in one sorted pass: a document's blocks are held, and of its nodes those that are open.
    """
    bad = _cutting(nodes, blocks)
    good = blocks.join(bad, F.col(DOC).eqNullSafe(F.col("_doc")) & (F.col("block_id") == F.col("_block")), "left_anti")
    out = StructType([f for f in nodes.schema.fields if f.name != DOC])
    edges = ["name", "start_off", "end_off", "head_end", "tail_start", "start_line", "end_line"]
    block = F.struct(*edges)
    columns = lambda kind, own, row: [DOC, F.lit(kind).alias("_kind"), own.alias("_block"), row.alias("_row")]
    both = good.select(*columns(0, block, F.lit(None).cast(out)), F.lit(-1).alias("node_id")).unionByName(
        nodes.select(*columns(1, F.lit(None).cast(good.select(*edges).schema), F.struct(*(F.col(c) for c in out.names))), "node_id")
    )

    def start():
        state = _Inserting(out.names)

        def step(own: dict | None = None, row: dict | None = None):
            if own is not None:
                state.blocks.append(own)
                return ()
            if row is None:
                state.close()
            else:
                state.add(row["node_id"], row["last_desc"], row["start_off"], row["end_off"], row)
            return state.given()

        return step

    return folds.emitted(both, "node_id", ["_block", "_row"], start, out, DOC)
