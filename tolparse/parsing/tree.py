"""Syntax trees, and their rewriting in the fixed order: generated nodes, void and ghost, list, leaf, water, names, blocks."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

from ..grammar.model import ANY, AUTO_RULE, BLOCK, Grammar, Message
from .lexer import Block


def spans_of(root: Node) -> dict[int, tuple[int, int, int | None]]:
    """``span()`` of every node that has one, by ``id``, from one pass from the leaves to the root."""
    found: dict[int, tuple[int, int, int | None]] = {}
    for n in _bottom_up(root):
        if n.own_start is not None:
            found[id(n)] = n.own_start, n.end, n.line
            continue
        first = None
        for c in n.children:
            if (s := found.get(id(c))) is not None:
                if first is None:
                    first, last, line = s
                    continue
                if s[0] <= first:
                    first, line = s[0], s[2]
                last = max(last, s[1])
        if first is not None:
            found[id(n)] = first, last, line
    return found


class Node:
    __slots__ = ("alias", "arguments", "children", "end", "line", "options", "own_start", "parent", "shown", "symbol", "value")

    def __init__(self, symbol: str, options: tuple = (), arguments: tuple = (), parent: Node | None = None):
        self.symbol, self.options, self.arguments = symbol, options, arguments
        self.alias: str | None = None
        self.shown: str | None = None
        self.children: list[Node] = []
        self.parent = parent
        self.value: list[str] = []
        self.own_start: int | None = None
        self.end: int | None = None
        self.line: int | None = None

    @property
    def type(self) -> str:
        return self.alias or self.shown or self.symbol

    def place(self, start: int, end: int, line: int | None = None) -> None:
        self.own_start, self.end, self.line = start, end, line

    def span(self) -> tuple[int, int, int | None] | None:
        """(start, end, line): its own, or the hull of the located nodes below that are outermost."""
        if self.own_start is not None:
            return self.own_start, self.end, self.line
        first, last, stack = None, -1, list(self.children)
        while stack:
            n = stack.pop()
            if n.own_start is None:
                stack += n.children
            else:
                last = max(last, n.end)
                if first is None or n.own_start < first[0]:
                    first = (n.own_start, n.line)
        return (first[0], last, first[1]) if first else None

    def text(self) -> list[str]:
        """Token texts of the subtree, in order."""
        if not self.children:
            return list(self.value)
        return [t for n in self.walk() if not n.children for t in n.value]

    def local(self) -> set[str]:
        return {n for group, names in self.options if group == "nodes" for n in names}

    def adopt(self, children: list[Node]) -> None:
        self.children = children
        for c in children:
            c.parent = self

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            if n.children:
                stack += n.children[::-1]


def _flattened(node: Node, gone: Callable[[Node], bool], deeper: Callable[[Node], bool] = lambda _: True) -> list[Node]:
    """A node's children, with those that go replaced by theirs, and so on below the ``deeper`` ones."""
    kept, stack = [], [(c, True) for c in reversed(node.children)]
    while stack:
        c, on = stack.pop()
        if on and gone(c):
            below = deeper(c)
            stack += [(x, below) for x in reversed(c.children)]
        else:
            kept.append(c)
    return kept


def _merge(node: Node) -> None:
    """Water that follows water among a node's children becomes one."""
    if sum([c.symbol == ANY for c in node.children]) < 2:
        return
    kept: list[Node] = []
    for c in node.children:
        last = kept[-1] if kept else None
        if last is not None and last.symbol == ANY == c.symbol and c.value:
            if (span := c.span()) is not None:
                own = last.span()
                last.place(own[0] if own else span[0], span[1], own[2] if own else span[2])
            last.value = last.value + c.value
        else:
            kept.append(c)
    node.adopt(kept)


def _bottom_up(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        if n.children:
            stack += n.children[::-1]
    out.reverse()
    return out


class Rewriter:
    """Applies a grammar's node options to a raw tree.

    ``single_pass``: void and ghost nodes that come up only by flattening a list stay, as in a rewriting in one pass.
    """

    def __init__(self, grammar: Grammar, single_pass: bool = False, steps: tuple[Callable[[Node], Node], ...] = ()):
        self.grammar, self.single_pass, self.steps = grammar, single_pass, steps
        self.named = {o: frozenset(grammar.options.symbols("nodes", o)) for o in ("void", "ghost", "list", "leaf")}
        local = {n for r in grammar.rules.values() for a in r.alternatives for e in a.entries for group, names in e.options if group == "nodes" for n in names}
        #: Options that some node can have; without any, a step has nothing to do.
        self.used = local | {o for o, own in self.named.items() if own}
        self.generates = any(r.startswith(AUTO_RULE) for r in grammar.rules)
        self._shown: dict[str, str] = {}

    def has(self, node: Node, option: str) -> bool:
        """Local options, if there are any, hide all global ones."""
        if node.options and (local := node.local()):
            return option in local
        return node.symbol in self.named[option] or node.alias is not None and node.alias in self.named[option]

    def __call__(self, root: Node, blocks: list[Block] | None = None) -> tuple[Node, list[Message]]:
        self.structure(root)
        self.finish(root)
        return self.last(root, blocks)

    def structure(self, root: Node) -> None:
        """What changes the tree's nodes, but for water."""
        if self.generates:
            self.drop_generated(root)
        if self.used & {"void", "ghost", "list"}:
            self.splice(root)
        if "leaf" in self.used:
            self.leaves(root)

    def last(self, root: Node, blocks: list[Block] | None) -> tuple[Node, list[Message]]:
        """What needs the whole tree: custom blocks, then visitors."""
        messages: list[Message] = []
        if blocks:
            root, messages = insert_blocks(root, blocks)
        for step in self.steps:
            root = step(root)
        return root, messages

    @staticmethod
    def drop_generated(root: Node) -> None:
        """Children of generated nodes take their place; the deepest alias along the last ones becomes their parent's.

        Each node is moved once, however long the chain of a repetition is.
        """
        todo = [root] if root.children else []
        while todo:
            n = todo.pop()
            last = n.children[-1]
            while last is not None and last.symbol.startswith(AUTO_RULE):
                n.alias = last.alias or n.alias
                last = last.children[-1] if last.children else None
            if any([c.symbol.startswith(AUTO_RULE) for c in n.children]):
                n.adopt(_flattened(n, lambda c: c.symbol.startswith(AUTO_RULE)))
            todo += [c for c in n.children if c.children]

    def splice(self, root: Node) -> None:
        either = self.named["void"] | self.named["ghost"]
        for n in _bottom_up(root):
            if not n.children or not any([c.options or c.symbol in either or c.alias in either for c in n.children]):
                continue
            kept: list[Node] = []
            for c in n.children:
                if self.has(c, "void"):
                    continue
                if self.has(c, "ghost"):
                    kept += c.children
                else:
                    kept.append(c)
            n.adopt(kept)
        if "list" not in self.used:
            return
        todo = [root]
        while todo:
            n = todo.pop()
            if self.has(n, "list"):
                same = lambda c, n=n: c.symbol == n.symbol or n.alias is not None and c.alias == n.alias
                kept = _flattened(n, same, lambda c: self.has(c, "list"))
                n.adopt(kept if self.single_pass else [c for c in kept if not self.has(c, "void")])
            todo += n.children

    def leaves(self, root: Node) -> None:
        stack = [root]
        while stack:
            n = stack.pop()
            if self.has(n, "leaf"):
                span, n.value = n.span(), n.text()
                if span:
                    n.place(*span)
                n.children = []
            stack.extend(n.children)

    @staticmethod
    def merge_water(root: Node) -> None:
        for n in root.walk():
            if len(n.children) > 1:
                _merge(n)

    def finish(self, root: Node) -> None:
        """Merges water and names all nodes, in one walk."""
        known, stack = self._shown, [root]
        while stack:
            n = stack.pop()
            n.shown = known.get(n.symbol) or known.setdefault(n.symbol, self.grammar.shown(n.symbol))
            if n.children:
                if len(n.children) > 1:
                    _merge(n)
                stack += n.children


def _block_node(block: Block) -> Node:
    node = Node(BLOCK)
    for token, symbol, value in ((block.start, "custom_block_start", block.name), (block.end, "custom_block_end", "")):
        edge = Node(symbol)
        edge.place(token.start, token.end, token.line)
        edge.value = [value]
        node.children.append(edge)
        edge.parent = node
    node.place(block.start.start, block.end.end, block.start.line)
    return node


def insert_blocks(root: Node, blocks: list[Block]) -> tuple[Node, list[Message]]:
    """Wraps whole runs of siblings (or the root) in nodes for the blocks; blocks that cut a node are reported instead.

    A node's located children are in the order of the text, so a block meets a run of them that is found by bisection.
    """
    bad: list[Block] = []
    span_of = lambda b: (b.start.start, b.end.end)
    spans = spans_of(root)
    known: dict[int, tuple[list[int], list[int], list[Node]]] = {}

    def located(node: Node) -> tuple[list[int], list[int], list[Node]]:
        """Starts, ends and nodes of a node's located children."""
        if id(node) not in known:
            own = [(c, s) for c in node.children if (s := spans.get(id(c)))]
            known[id(node)] = [s[0] for _, s in own], [s[1] for _, s in own], [c for c, _ in own]
        return known[id(node)]

    def made(block: Block) -> Node:
        new = _block_node(block)
        for n in (new, *new.children):
            spans[id(n)] = n.own_start, n.end, n.line
        return new

    def fill(node: Node, own: list[Block]) -> None:
        todo = own[::-1]
        starts, ends, kids = located(node)
        while todo:
            block = todo.pop()
            a, z = span_of(block)
            lo, hi = bisect_left(ends, a), bisect_right(starts, z)  # what ends before or starts behind does not meet the block
            met = [(c, (s, e)) for c, s, e in zip(kids[lo:hi], starts[lo:hi], ends[lo:hi], strict=True)]
            outer = next((c for c, s in met if c.symbol != BLOCK and c.children and s[0] <= a and z <= s[1] and s != (a, z)), None)
            if outer is not None:
                fill(outer, [block])
                continue
            if any((a <= s[0] <= z) != (a <= s[1] <= z) or s[0] < a and z < s[1] for _, s in met):
                bad.append(block)
                todo += block.children[::-1]
                continue
            new = made(block)
            if met:
                at, last = node.children.index(met[0][0]), node.children.index(met[-1][0])
                inside = node.children[at : last + 1]
                node.children[at : last + 1] = [new]
                new.adopt([new.children[0], *inside, new.children[1]])
            else:
                at = node.children.index(kids[hi]) if hi < len(kids) else len(node.children)
                node.children.insert(at, new)
            starts[lo:hi], ends[lo:hi], kids[lo:hi] = [a], [z], [new]
            new.parent = node
            fill(new, block.children)

    own, top = list(blocks), root
    whole = spans.get(id(root))
    while whole and (outer := next((b for b in own if b.start.start <= whole[0] and whole[1] <= b.end.end), None)):
        wrap = made(outer)
        if root.parent is not None:
            place = root.parent.children.index(root)
            root.parent.children[place] = wrap
            wrap.parent = root.parent
        else:
            top = wrap
        wrap.adopt([wrap.children[0], root, wrap.children[1]])
        at = own.index(outer)
        own[at : at + 1] = outer.children
    fill(root, own)
    return top, [Message("error", f"the custom block {b.name!r} cuts a node", b.start.line, b.start.column, b.start.start, "blocks") for b in bad]
