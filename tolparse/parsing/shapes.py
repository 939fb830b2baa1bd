"""Texts of one shape: tokens of the same names in the same order.

What a parse does depends on its tokens' names alone, custom blocks and visitors aside; their texts and places only show up in what
comes of it. So a text is scanned, and what is known of its shape is filled with its own tokens. Records of one schema have few shapes,
whatever their values. Shapes that need recovery are parsed anew, as recovery has a time of its own.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from ..grammar.model import EOF, Message
from .engine import Parser, Statistics
from .lexer import Lexed, Token
from .tree import Node

#: Tokens of the longest text whose shape is remembered, and how many shapes are.
LONGEST, SHAPES = 256, 2048
_BREAKS = re.compile(r"[\n\r\t\f]+")


def entity_parts(root: Node | None, types: frozenset[str], names: frozenset[str]) -> Iterator[tuple[str, list[list]]]:
    """(type, texts of each name) in pre-order of the nodes whose alias or symbol is wanted."""
    for n in root.walk() if root is not None else ():
        if n.alias in types or n.symbol in types:
            yield n.type, [c.text() for c in n.children if c.type in names]


def entity_value(parts: Iterable[Iterable[str]]) -> str:
    return " ".join([_BREAKS.sub(" ", "".join(p)) for p in parts])


def message_rows(messages: Iterable[Message]) -> list[tuple]:
    return [(k, m.kind, m.text, m.line, m.column, m.offset, m.source, m.unexpected_token, m.unexpected_lexeme, list(m.expected)) for k, m in enumerate(messages)]


@dataclass
class Shape:
    """What a parse gives; of short texts with the tokens' numbers in place of their texts and places."""

    statistics: Statistics
    has_error: bool
    messages: list[Message]
    entities: list[tuple[str, list[list]]]


class Shapes:
    """Statistics, errors, messages and entities of texts; trees only while a shape is new."""

    def __init__(self, parser: Parser, types: Iterable[str] = (), names: Iterable[str] = ("name",), tree: bool = True):
        self.parser, self.types, self.names, self.tree = parser, frozenset(types), frozenset(names), tree
        self.known: dict[tuple[str, ...], Shape] = {}

    @staticmethod
    def fit(parser: Parser) -> bool:
        """Whether token names are all that a parse looks at."""
        return not parser.lexer.base and not parser.rewriter.steps

    def parsed(self, tokens: list[Token]) -> Shape:
        messages: list[Message] = []
        self.parser.lexer.nest(tokens, messages)
        done = self.parser.parse_tokens(Lexed(tokens, messages, []), self.tree or None)
        done.statistics.tokens_count = len(tokens) - 1
        failed = done.has_error
        return Shape(done.statistics, failed, done.messages, [] if failed or not self.tree else list(entity_parts(done.root, self.types, self.names)))

    def of(self, tokens: list[Token]) -> Shape:
        """The shape of a short text, remembered or parsed, with numbers in place of the tokens."""
        key = tuple([t.name for t in tokens])
        shape = self.known.get(key)
        if shape is None:
            shape = self.parsed([Token(name, "" if name == EOF else k, k, k, k, k) for k, name in enumerate(key)])
            if not shape.statistics.recovery_times and not shape.statistics.recovery_times_any:
                if len(self.known) >= SHAPES:
                    self.known.clear()
                self.known[key] = shape
        return shape

    def __call__(self, text: str) -> tuple[Statistics, bool, list[tuple], list[tuple[int, str, str]]]:
        """(statistics, has_error, messages and entities as the rows of their tables without the document)."""
        since = time.perf_counter()
        tokens = self.parser.lexer.scan(text)
        if len(tokens) > LONGEST:
            shape = self.parsed(tokens)
            messages = message_rows(shape.messages)
            entities = [(k, kind, entity_value(parts)) for k, (kind, parts) in enumerate(shape.entities)]
        else:
            shape, messages = self.of(tokens), []
            for k, m in enumerate(shape.messages):
                t = tokens[m.line] if m.line is not None else None
                lexeme = t.text if t and isinstance(m.unexpected_lexeme, int) else m.unexpected_lexeme
                messages.append((k, m.kind, m.text, t and t.line, t and t.column, t and t.start, m.source, m.unexpected_token, lexeme, list(m.expected)))
            entities = [(k, kind, entity_value([[tokens[i].text for i in p] for p in parts])) for k, (kind, parts) in enumerate(shape.entities)]
        s = shape.statistics
        own = Statistics(len(text), s.tokens_count, s.recovery_times, s.recovery_times_any, s.longest_rollback, 1000 * (time.perf_counter() - since), s.recovery_ms)
        return own, shape.has_error, messages, entities
