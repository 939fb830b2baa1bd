"""Tolerant LL(1) and LR(1) parsing with water, skipped tokens and recovery."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import cached_property

from ..grammar.analysis import EMPTY, Sets, check
from ..grammar.dsl import read_grammar
from ..grammar.model import ANY, EOF, ERROR, Entry, Grammar, GrammarError, Message
from ..grammar.tables import TableLL, TableLR
from .lexer import Lexed, Lexer, Token
from .pieces import Pieces
from .tree import Node, Rewriter


@dataclass
class Statistics:
    chars_count: int = 0
    tokens_count: int = 0
    recovery_times: int = 0
    recovery_times_any: int = 0
    longest_rollback: int = 0
    general_ms: float = 0.0
    recovery_ms: float = 0.0


@dataclass
class Parsed:
    root: Node | None
    lexed: Lexed
    messages: list[Message]
    statistics: Statistics

    @property
    def has_error(self) -> bool:
        return any(m.kind == "error" for m in self.messages)


_END = Entry(EOF)


class _Stopped(Exception):
    """Parsing cannot go on."""


class _Run:
    """What LL and LR share: the place in the tokens, water, and the record of one text's parse."""

    def __init__(self, parser: Parser, lexed: Lexed, trace: bool):
        self.parser, self.grammar, self.tokens, self.trace = parser, parser.grammar, lexed.tokens, trace
        self.messages = list(lexed.messages)
        self.statistics = Statistics()
        self.at = 0
        self.recovered_at: set[int] = set()
        self.last_problem: int | None = None

    @property
    def token(self) -> Token:
        return self.tokens[self.at]

    def step(self) -> None:
        if self.token.name not in (EOF, ERROR):
            self.at += 1

    def to_level(self, level: int) -> list[Token]:
        """Goes on to the next token at a nesting level; returns those in between."""
        passed = []
        while True:
            before = self.at
            self.step()
            if self.at == before or self.token.depth == level or self.token.name in (EOF, ERROR):
                return passed
            passed.append(self.token)

    def say(self, kind: str, text: str, expected=(), token: Token | None = None) -> int:
        t = token or self.token
        self.messages.append(Message(kind, text, t.line, t.column, t.start, "parser", t.name, t.text, tuple(sorted(map(self.grammar.shown, expected)))))
        return len(self.messages) - 1

    def note(self, text: str) -> None:
        if self.trace:
            self.say("trace", text)

    def promote(self, entry: Entry) -> None:
        """``AnyError``: the problem that led to this water is an error after all."""
        if entry.argument("Error") is not None and self.last_problem is not None:
            m = self.messages[self.last_problem]
            self.messages[self.last_problem] = Message("error", m.text, m.line, m.column, m.offset, m.source, m.unexpected_token, m.unexpected_lexeme, m.expected)

    def fill(self, node: Node, entry: Entry, stop: frozenset[str]) -> bool:
        """Takes water up to a stop token; false if something else ended it."""
        ignore_pairs, avoid = entry.argument("IgnorePairs") is not None, entry.argument("Avoid") or ()
        level, span = self.token.depth, node.span()
        start, line, end = (span[0], span[2], span[1]) if span else (self.token.start, self.token.line, None)
        while (t := self.token).name not in stop and (ignore_pairs or t.direction != "up") and t.name not in avoid and t.name not in (EOF, ERROR):
            node.value.append(t.text)
            end = t.end
            if ignore_pairs:
                self.step()
            elif passed := self.to_level(level):
                node.value += [p.text for p in passed]
                end = passed[-1].end
        if end is not None:
            node.place(start, end, line)
        if self.token.name == ERROR:
            raise _Stopped
        return self.token.name in stop

    def begin_recovery(self) -> None:
        if not self.grammar.recovers():
            self.say("error", "recovery is not enabled")
            raise _Stopped
        if self.at in self.recovered_at:
            self.say("error", "recovery was already tried at this token")
            raise _Stopped
        self.recovered_at.add(self.at)
        self.say("warning", "recovery begins")
        self.since = time.perf_counter()

    def end_recovery(self) -> None:
        self.statistics.recovery_times += 1
        self.statistics.recovery_ms += 1000 * (time.perf_counter() - self.since)

    def give_up(self) -> None:
        self.messages.append(Message("error", "parsing could not go on", source="parser"))
        raise _Stopped

    def rolled_back(self, begin: int) -> None:
        self.statistics.recovery_times_any += 1
        self.statistics.longest_rollback = max(self.statistics.longest_rollback, self.at - begin)
        self.at = begin


class _RunLL(_Run):
    def parse(self) -> Node | None:
        self.levels: dict[int, int] = {}
        root = Node(self.parser.first.symbol)
        self.stack: list[tuple[Node, Entry]] = [(Node(EOF), _END), (root, self.parser.first)]
        try:
            self.run()
        except _Stopped:
            pass
        return root

    def run(self, begin: int = 0, depth: int = 0) -> None:
        """Goes on until the stack is empty, or as deep as ``depth`` with tokens from ``begin`` on taken."""
        table, skipped, tokens, stack = self.parser.table.cells, self.parser.skipped, self.tokens, self.stack
        water = False  # whether the current token is to be the beginning of water
        while stack and (water or len(stack) != depth or self.at == begin):
            t = tokens[self.at]
            look = t.name
            if look == ERROR:
                return
            node, entry = stack[-1]
            if water:
                look = ANY
            if entry.symbol == look:
                if water:
                    self.skip()
                    water = False
                else:
                    stack.pop()
                    node.own_start, node.end, node.line = t.start, t.end, t.line
                    node.value = [t.text]
                    if look == EOF:
                        continue
                    self.at += 1
                continue
            options = table.get((entry.symbol, look))  # cells are those of rules
            if options:
                if not water:
                    self.apply(options[0])
                    continue
                # the water must really be able to begin here, in view of all that is still expected
                expected = self.parser.sets.first(e.symbol for _, e in reversed(self.stack))
                if ANY in expected:
                    self.skip()
                else:
                    self.last_problem = self.say("warning", "unexpected token", expected - {EMPTY})
                    self.recover()
                water = False
            elif water:
                expected = self.parser.table.expected(entry.symbol) if self.grammar.is_rule(entry.symbol) else [entry.symbol]
                self.last_problem = self.say("warning", "unexpected token", expected)
                self.recover()
                water = False
            elif look in skipped:
                self.step()
            else:
                self.note("taken for the beginning of water")
                water = True

    def apply(self, alternative) -> None:
        node = self.stack.pop()[0]
        if alternative.alias:
            node.alias = alternative.alias
        self.levels[id(node)] = self.tokens[self.at].depth
        node.children = own = [Node(e.symbol, e.options, e.arguments, node) for e in alternative.entries]
        self.stack += zip(own[::-1], alternative.backwards)

    def stops(self, entry: Entry, rest) -> frozenset[str]:
        if (given := entry.argument("Except")) is not None:
            return given
        return self.parser.sets.first(rest, past_water=True) - {ANY, EMPTY} - (entry.argument("Include") or frozenset())

    def skip(self, node: Node | None = None) -> None:
        """Matches water: descends to the wildcard and takes tokens up to what may follow it. ``node`` is given in recovery."""
        begin, recovering = self.at, node is not None
        while self.grammar.is_rule(self.stack[-1][1].symbol):
            self.apply(self.parser.table.cells[self.stack[-1][1].symbol, ANY][0])
        old, entry = self.stack.pop()
        node = node or Node(ANY)
        node.options, node.arguments = entry.options, entry.arguments
        self.promote(entry)
        node.parent = old.parent
        old.parent.children[next(k for k, c in enumerate(old.parent.children) if c is old)] = node
        stop = self.stops(entry, [e.symbol for _, e in reversed(self.stack)])
        if self.token.name in stop or self.fill(node, entry, stop):
            return
        problem = self.say("error" if recovering else "warning", "water ends at an unexpected token", stop)
        if recovering:
            self.give_up()
        avoided = self.token.name if self.token.name in (entry.argument("Avoid") or ()) else None
        self.rolled_back(begin)
        node.value, node.own_start = [], None
        self.stack.append((node, entry))
        self.last_problem = problem
        self.recover(stop, avoided)

    def recover(self, stop: frozenset[str] | None = None, avoided: str | None = None) -> None:
        self.begin_recovery()
        node = self.stack.pop()[0]
        while True:
            parent = node.parent
            if parent is not None:
                later = len(parent.children) - next(k for k, c in enumerate(parent.children) if c is node) - 1
                if later:
                    del self.stack[-later:]
            node = parent
            if node is None:
                self.give_up()
            if node.symbol in self.grammar.recovery() and not _begins_with_water(node) and not self.unsafe(node, stop, avoided):
                break
        level = self.levels[id(node)]
        passed = []
        if self.token.depth != level:
            passed = [self.token, *self.to_level(level)]
        water = Node(ANY)
        water.value = node.text() + [t.text for t in passed] if node.children else [t.text for t in passed]
        span = node.span()
        if passed:
            span = (span[0] if span else passed[0].start, passed[-1].end, span[2] if span else passed[0].line)
        if span:
            water.place(*span)
        node.children, node.own_start = [], None
        self.stack.append((node, Entry(node.symbol, node.options, node.arguments)))
        self.say("warning", f"parsing goes on with {self.grammar.shown(node.symbol)}")
        self.skip(water)
        self.end_recovery()

    def unsafe(self, node: Node, stop: frozenset[str] | None, avoided: str | None) -> bool:
        """Whether the water of this rule would end where the failed one did."""
        if stop is None or self.token.depth != self.levels[id(node)]:
            return False
        entry, rest = self.parser.waters[node.symbol]
        avoid = entry.argument("Avoid") or frozenset()
        own = self.stops(entry, [*rest, *(e.symbol for _, e in reversed(self.stack))])
        return self.token.name in avoid or own <= stop and (avoided is None or avoided in avoid)


class Silent(_RunLL):
    """Parses turns of a loop, and gives up where there is anything to say."""

    def say(self, kind: str, text: str, expected=(), token: Token | None = None) -> int:
        raise _Stopped

    def turn(self, top: Node, loop: Entry, begin: int) -> bool:
        """Parses from a token up to the loop's next turn, below ``top``."""
        self.levels, self.at, self.last_problem = {}, begin, None
        self.stack = [(Node(EOF), _END), (top, loop)]
        try:
            self.run(begin, len(self.stack))
        except _Stopped:
            return False
        return len(self.stack) == 2 and self.stack[-1][1].symbol == loop.symbol


class _RunLR(_Run):
    def parse(self) -> Node | None:
        self.states, self.nodes, self.levels = [0], [], [0]
        try:
            return self.run()
        except _Stopped:
            return None

    def run(self) -> Node | None:
        table, skipped = self.parser.table, self.parser.skipped
        water = False
        while True:
            if self.token.name == ERROR:
                return None
            look = ANY if water else self.token.name
            action = table.action(self.states[-1], look)
            if action and water:
                self.skip()
                water = False
            elif action and action[0] == "shift":
                t = self.token
                node = Node(t.name)
                node.value = [t.text]
                node.place(t.start, t.end, t.line)
                self.push(node, action[1])
                self.step()
            elif action and action[0] == "reduce":
                self.reduce(action[1])
            elif action:
                return self.nodes[-1]
            elif water:
                self.last_problem = self.say("warning", "unexpected token", table.expected(self.states[-1]) - {ANY})
                self.recover()
                water = False
            elif look in skipped:
                self.step()
            else:
                self.note("taken for the beginning of water")
                water = True

    def push(self, node: Node, state: int) -> None:
        self.nodes.append(node)
        self.states.append(state)
        self.levels.append(self.token.depth)

    def reduce(self, number: int) -> None:
        alternative = self.parser.table.alternatives[number]
        node, n = Node(alternative.rule), len(alternative.entries)
        if n:
            node.adopt(self.nodes[-n:])
            del self.nodes[-n:], self.states[-n:], self.levels[-n:]
        self.push(node, self.parser.table.states[self.states[-1]].moves[alternative.rule])

    def stops(self, entry: Entry, state: int) -> frozenset[str]:
        given = entry.argument("Except")
        found = given if given is not None else self.parser.table.expected(state) - (entry.argument("Include") or frozenset())
        return found - {ANY}

    def skip(self, node: Node | None = None) -> None:
        begin, recovering = self.at, node is not None
        table = self.parser.table
        while len(own := table.actions[self.states[-1]].get(ANY, [])) == 1 and own[0][0] == "reduce":
            self.reduce(own[0][1])
        entry = table.water_entry(self.states[-1])
        shift = next((a for a in own if a[0] == "shift"), None)
        if entry is None or shift is None:
            self.give_up()
        node = node or Node(ANY)
        node.options, node.arguments = entry.options, entry.arguments
        self.promote(entry)
        self.push(node, shift[1])
        stop = self.stops(entry, shift[1])
        if self.fill(node, entry, stop):
            return
        goes_on = not recovering and self.grammar.recovers()
        problem = self.say("warning" if goes_on else "error", "water ends at an unexpected token", stop)
        if not goes_on:
            if recovering:
                self.give_up()
            raise _Stopped
        avoided = self.token.name if self.token.name in (entry.argument("Avoid") or ()) else None
        self.rolled_back(begin)
        self.last_problem = problem
        self.recover(stop, avoided)

    def recover(self, stop: frozenset[str] | None = None, avoided: str | None = None) -> None:
        """Pops states until what was popped began a derivation of a recovery rule, which then begins with water instead."""
        self.begin_recovery()
        table, wanted = self.parser.table, self.grammar.recovery()
        value: list[str] = []
        start = end = line = None
        paths: set[tuple[int, int]] = set()
        while True:
            popped = self.nodes.pop() if self.nodes else None
            self.states.pop()
            self.levels.pop()
            if not self.states or popped is None:
                self.give_up()
            if span := popped.span():
                start, line = span[0], span[2]
                end = span[1] if end is None else end
            value = popped.text() + value
            markers = {(m[0], m[1]) for m in table.states[self.states[-1]].markers}
            symbol_at = lambda p: table.bodies[p[0]][p[1]] if p[1] < len(table.bodies[p[0]]) else None
            direct = {p for p in markers if symbol_at(p) == popped.symbol and (not paths or (p[0], p[1] + 1) in paths)}
            paths = set(direct)
            while grown := {p for p in markers - paths if any(q[1] == 0 and table.alternatives[q[0]].rule == symbol_at(p) for q in paths)}:
                paths |= grown
            if any(symbol_at(p) in wanted for p in paths - direct) and not _begins_with_water(popped) and not self.unsafe(stop, avoided):
                break
        if self.token.depth != self.levels[-1]:
            passed = [self.token, *self.to_level(self.levels[-1])]
            value += [t.text for t in passed]
            start, line = (passed[0].start, passed[0].line) if start is None else (start, line)
            end = passed[-1].end
        water = Node(ANY)
        water.value = value
        if start is not None:
            water.place(start, end, line)
        self.say("warning", "parsing goes on with water")
        self.skip(water)
        self.end_recovery()

    def unsafe(self, stop: frozenset[str] | None, avoided: str | None) -> bool:
        if stop is None or self.token.depth != self.levels[-1]:
            return False
        table, state = self.parser.table, self.states[-1]
        entry = next((table.alternatives[m[0]].entries[0] for m in sorted(table.states[state].markers) if m[1] == 0 and table._next(m) == ANY), None)
        shift = next((a for a in table.actions[state].get(ANY, ()) if a[0] == "shift"), None)
        if entry is None or shift is None:
            return False
        avoid = entry.argument("Avoid") or frozenset()
        return self.token.name in avoid or self.stops(entry, shift[1]) <= stop and (avoided is None or avoided in avoid)


def _begins_with_water(node: Node) -> bool:
    while node.symbol != ANY and node.children:
        node = node.children[0]
    return node.symbol == ANY


@dataclass
class Parser:
    """A compiled grammar. Plain data, so it is pickled once and sent to the workers."""

    grammar: Grammar
    messages: list[Message] = field(default_factory=list)
    single_pass: bool = False

    def __post_init__(self):
        self.sets = Sets(self.grammar)
        self.messages = [*self.messages, *check(self.grammar, self.sets)]
        if not any(m.kind == "error" for m in self.messages):
            self.table = (TableLL if self.grammar.kind == "LL" else TableLR)(self.grammar, self.sets)
            self.messages += self.table.check()
        if errors := [m for m in self.messages if m.kind == "error"]:
            raise GrammarError("\n".join(f"line {m.line}: {m.text}" if m.line else m.text for m in errors))
        self.lexer = Lexer(self.grammar)
        self.rewriter = Rewriter(self.grammar, self.single_pass)
        self.first, self.skipped = Entry(self.grammar.start), self.grammar.skipped()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "pieces"}  # what is remembered stays where it was found

    @cached_property
    def waters(self) -> dict[str, tuple[Entry, tuple[str, ...]]]:
        return {r: found for r in self.grammar.rules if (found := self.sets.water_entry(r))}

    @cached_property
    def pieces(self) -> Pieces:
        return Pieces(self)

    @cached_property
    def flat(self) -> bool:
        """Whether the grammar is a loop over lone terminals and water, without pairs: no text can then need recovery or fail in the parser."""
        rules, start = self.grammar.rules, self.grammar.rules.get(self.grammar.start or "")
        if self.grammar.pairs or start is None or len(start.alternatives) != 1 or len(start.alternatives[0].entries) != 1:
            return False
        loop = rules.get(start.alternatives[0].entries[0].symbol)
        if loop is None or sorted(len(a.entries) for a in loop.alternatives) != [0, 2]:
            return False
        one, again = max((a.entries for a in loop.alternatives), key=len)
        leaves, todo = [], [one]
        while todo:
            entry = todo.pop()
            if entry.symbol in rules:
                own = [a.entries for a in rules[entry.symbol].alternatives]
                if any(len(e) != 1 for e in own) or len(leaves) > len(rules) + len(self.grammar.terminals):
                    return False
                todo += [e[0] for e in own]
            else:
                leaves.append(entry)
        return again.symbol == loop.name and any(e.symbol == ANY and not e.arguments for e in leaves) and all(e.symbol != ANY or not e.arguments for e in leaves)

    def statistics_of(self, text: str) -> tuple[Statistics, bool]:
        """A text's statistics and whether it has errors, without a tree where the tokens alone tell."""
        if not self.flat:
            p = self.parse(text, rewrite=None)
            return p.statistics, p.has_error
        since = time.perf_counter()
        lexed = self.lexer(text)
        s = Statistics(len(text), len(lexed.tokens) - 1, general_ms=1000 * (time.perf_counter() - since))
        return s, any(m.kind == "error" for m in lexed.messages)

    def parse(self, text: str, rewrite: bool | None = True, trace: bool = False) -> Parsed:
        """Parses one text; LL gives what it has even after an error, LR no tree then.

        ``rewrite=None``: the tree is rewritten only where custom blocks may still bring messages.
        """
        since = time.perf_counter()
        lexed = self.lexer(text)
        parsed = self.parse_tokens(lexed, rewrite, trace)
        s = parsed.statistics
        s.chars_count, s.tokens_count, s.general_ms = len(text), len(lexed.tokens) - 1, 1000 * (time.perf_counter() - since)
        return parsed

    def parse_tokens(self, lexed: Lexed, rewrite: bool | None = True, trace: bool = False) -> Parsed:
        """Parses what the lexer gave; only recovery is in the statistics. Looks at tokens' names and nesting, never at their texts, but for custom blocks."""
        if rewrite and not trace and (found := self.pieces(lexed.tokens)) is not None:
            root, more = self.rewriter.last(self.pieces.tree(found, lexed.tokens), lexed.blocks)
            return Parsed(root, lexed, [*lexed.messages, *more], Statistics())
        run = (_RunLL if self.grammar.kind == "LL" else _RunLR)(self, lexed, trace)
        root = run.parse()
        if root is not None and (lexed.blocks if rewrite is None else rewrite):
            root, more = self.rewriter(root, lexed.blocks)
            run.messages += more
        return Parsed(root, lexed, run.messages, run.statistics)


def compile_grammar(text: str, kind: str = "LL", single_pass: bool = False) -> Parser:
    """A parser from a grammar text; raises ``GrammarError`` with all errors found."""
    grammar, messages = read_grammar(text, kind)
    return Parser(grammar, messages, single_pass)
