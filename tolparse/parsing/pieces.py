"""Texts of ever the same pieces: a start rule that is a loop is parsed one turn of the loop at a time, and what a turn gives is remembered.

At the begin of a turn the parser expects the same, wherever in a text it is. So what it makes of the turn depends on the names (and
the nesting) of its tokens and of the one behind alone, and a piece that was met before is found by these names in a trie. Its rewritten
tree stands there with numbers of tokens in place of texts and places. Texts that bring any message of the parser are parsed as a whole.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from ..grammar.model import ANY, AUTO_RULE, EOF, Entry
from .lexer import Token
from .tree import Node, _merge

if TYPE_CHECKING:
    from .engine import Parser

#: Tokens of the longest piece that is remembered, and how many pieces are.
LONGEST, PIECES = 256, 4096
#: After so many tokens it is seen whether half of them were in new pieces; if so, so many texts are parsed as a whole.
LOOKED_AT, REST = 20_000, 200


class Piece:
    """One turn of the loop: its rewritten nodes below ``root``, and how many tokens it takes."""

    def __init__(self, root: Node, size: int):
        self.root, self.size = root, size
        self.known: dict[str, object] = {}
        self.rows: list[tuple] = []
        at = {id(root): -1}
        for k, n in enumerate(n for n in root.walk() if n is not root):
            at[id(n)] = k
            self.rows.append((at[id(n.parent)], n.symbol, n.options, n.arguments, n.alias, n.shown, n.value, n.own_start, n.end, n.line))

    def read(self, name: str, of: Callable[[Node], object]):
        """What ``of`` says of the piece's nodes, asked once."""
        if name not in self.known:
            self.known[name] = of(self.root)
        return self.known[name]

    def grow(self, root: Node, tokens: list[Token], begin: int) -> None:
        """Puts the piece's nodes below ``root``, with the texts and places of the tokens from ``begin`` on."""
        made, new = [], Node.__new__
        for parent, symbol, options, arguments, alias, shown, value, start, end, line in self.rows:
            n = new(Node)
            n.symbol, n.options, n.arguments, n.alias, n.shown, n.children = symbol, options, arguments, alias, shown, []
            n.value = [tokens[begin + k].text for k in value] if value else []
            if start is None:
                n.own_start = n.end = n.line = None
            else:
                n.own_start, n.end, n.line = tokens[begin + start].start, tokens[begin + end].end, tokens[begin + line].line
            n.parent = above = root if parent < 0 else made[parent]
            above.children.append(n)
            made.append(n)


class Pieces:
    """The pieces of a parser's texts. ``loop`` is its start rule's loop, or None where there is none that pieces can be made of."""

    def __init__(self, parser: Parser):
        self.parser, self.rewriter = parser, parser.rewriter
        rules, start = parser.grammar.rules, parser.grammar.rules.get(parser.grammar.start or "")
        self.loop: Entry | None = None
        if parser.grammar.kind == "LL" and start is not None and len(start.alternatives) == 1 and len(start.alternatives[0].entries) == 1:
            entry, root = start.alternatives[0].entries[0], Node(start.name)
            loop = rules.get(entry.symbol)
            turns = sorted(loop.alternatives, key=lambda a: len(a.entries)) if loop else []
            plain = len(turns) == 2 and not turns[0].entries and turns[1].symbols[-1:] == (entry.symbol,) and not any(a.alias for a in (*turns, *start.alternatives))
            if plain and entry.symbol.startswith(AUTO_RULE) and not entry.options and not turns[1].entries[-1].options and not parser.rewriter.has(root, "leaf"):
                self.loop = entry
        both = [p.left & p.right for p in parser.grammar.pairs.values()]
        #: Terminals that open or close as what is open says.
        self.either = frozenset().union(*both)
        self.trie: dict = {}
        self.count = self.seen = self.new = self.rest = 0

    def __call__(self, tokens: list[Token]) -> list[tuple[Piece, int]] | None:
        """(piece, number of its first token) of a text's tokens with their nesting, or None where the text is to be parsed as a whole."""
        if self.loop is None or tokens[-1].name != EOF:
            return None
        if self.rest:
            self.rest -= 1
            return None
        if self.rewriter is not self.parser.rewriter:
            self.rewriter, self.trie, self.count = self.parser.rewriter, {}, 0
        keys = [t.name for t in tokens] if not self.either else [(t.name, t.direction) if t.name in self.either else t.name for t in tokens]
        out, at, last, trie, run = [], 0, len(tokens) - 1, self.trie, None
        while at < last:
            found, k = trie.get(keys[at]), at
            while type(found) is dict:
                k += 1
                found = found.get(keys[k])
            if found is None:
                run = run or self._run(tokens)
                found = self._made(run, at)
                if found is None:
                    self.new += len(tokens)
                    break
                self.new += found.size
                if found.size <= LONGEST:
                    if self.count >= PIECES:
                        trie.clear()
                        self.count = 0
                    self.count += 1
                    own = trie
                    for key in keys[at : at + found.size]:
                        own = own.setdefault(key, {})
                    own[keys[at + found.size]] = found
            out.append((found, at))
            at += found.size
        self.seen += len(tokens)
        if self.seen > LOOKED_AT:
            self.rest = REST if 2 * self.new > self.seen else 0
            self.seen = self.new = 0
        return out if at >= last else None

    def _run(self, tokens: list[Token]):
        from .engine import Silent
        from .lexer import Lexed

        numbered = [Token(t.name, k, k, k, k, k, t.direction, t.pair, t.depth) for k, t in enumerate(tokens)]
        return Silent(self.parser, Lexed(numbered, [], []), False)

    def _made(self, run, at: int) -> Piece | None:
        """The piece that begins at a token, parsed."""
        top = Node(self.loop.symbol)
        if not run.turn(top, self.loop, at):
            return None
        rewriter, root = self.rewriter, Node(self.parser.grammar.start)
        root.adopt([top])
        rewriter.structure(root)
        for n in root.walk():
            n.value = [v - at for v in n.value]
            if n.own_start is not None:
                n.own_start, n.end, n.line = n.own_start - at, n.end - at, n.line - at
        for n in root.children:
            rewriter.finish(n)
        return Piece(root, run.at - at)

    def tree(self, found: list[tuple[Piece, int]], tokens: list[Token]) -> Node:
        """The rewritten tree that the pieces make together, before blocks and visitors."""
        root = Node(self.parser.grammar.start)
        root.shown = self.parser.grammar.shown(root.symbol)
        for piece, begin in found:
            piece.grow(root, tokens, begin)
        if sum([c.symbol == ANY for c in root.children]) > 1:
            _merge(root)
        return root
