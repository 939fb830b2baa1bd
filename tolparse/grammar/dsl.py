"""Reads grammar texts.

    NAME : [%linestart] pattern                 a terminal; the pattern is the rest of the line
    NAME : %left border %right border           a nesting pair; a border is a name, a literal, or (one | another)
    name = entries [=> alias] | ...             a rule; it goes on until the next definition at a line's beginning
    %%                                          options follow
    %group option(parameters) symbols           or  %group { one option on each line }

An entry is a literal, a name or a group in brackets, with ``? * +`` and ``!`` behind it, ``%nodes(option)`` before it.
``Any`` takes arguments: ``AnyInclude('x')``, ``Any(Avoid(';'), IgnorePairs)`` and so on.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .model import ANY, ANY_ARGUMENTS, AUTO_RULE, AUTO_TOKEN, BLOCK, EOF, ERROR, OPTION_GROUPS, Alternative, Entry, Grammar, GrammarError, Message, Pair, Rule, Terminal

_HEAD = re.compile(r"(?P<name>[^\W\d]\w*)[ \t]*(?P<sign>[:=])(?!>)[ \t]*")
_LEXEME = re.compile(
    r"(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<literal>'(?:\\.|[^'\\\n])*')|(?P<string>\"(?:\\.|[^\"\\\n])*\")"
    r"|(?P<number>-?\d+(?:\.\d+)?)|(?P<option>%[^\W\d]\w*)|(?P<name>[^\W\d]\w*)|(?P<arrow>=>)|(?P<sign>[()|?*+!,{}])",
    re.S,
)


#: A rule's body of nothing but names and bars, which needs no lexemes.
_PLAIN = re.compile(r"(?:\s++|\||[^\W\d]\w*+)*+")


@dataclass(slots=True)
class _Lexeme:
    kind: str
    text: str
    line: int
    #: Whether it stands right behind the one before.
    joined: bool = False


def _lexemes(text: str, line: int) -> list[_Lexeme]:
    out, at, joined = [], 0, False
    while at < len(text):
        m = _LEXEME.match(text, at)
        if not m:
            raise GrammarError(f"line {line}: unexpected {text[at]!r}")
        if m.lastgroup != "space":
            out.append(_Lexeme(m.lastgroup, m[0], line, joined))
        line += m[0].count("\n")
        joined, at = m.lastgroup != "space", m.end()
    return out


class _Cursor:
    def __init__(self, lexemes: list[_Lexeme], line: int):
        self.lexemes, self.at, self.line = lexemes, 0, line

    def peek(self, *texts: str) -> bool:
        return self.at < len(self.lexemes) and (not texts or self.lexemes[self.at].text in texts)

    def kind(self) -> str | None:
        return self.lexemes[self.at].kind if self.peek() else None

    def next(self) -> _Lexeme:
        if not self.peek():
            raise GrammarError(f"line {self.line}: definition ends too early")
        self.at += 1
        self.line = self.lexemes[self.at - 1].line
        return self.lexemes[self.at - 1]

    def take(self, *texts: str) -> bool:
        if self.peek(*texts):
            self.at += 1
            return True
        return False

    def expect(self, text: str) -> None:
        if not self.take(text):
            found = self.lexemes[self.at].text if self.peek() else "the end"
            raise GrammarError(f"line {self.line}: expected {text}, found {found}")


def _unquoted(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text[1:-1])


class _Names(dict):
    """The entry of a name alone, the same one wherever it stands."""

    def __missing__(self, symbol: str) -> Entry:
        entry = self[symbol] = Entry(symbol)
        return entry


class _Reader:
    def __init__(self, kind: str):
        self.grammar = Grammar(kind)
        self.messages: list[Message] = []
        self.literals: dict[str, str] = {}
        self.generated: dict[tuple, str] = {}
        self.borders: list[tuple[str, list, list]] = []
        self.names = _Names()
        self.defined = {ANY, EOF, ERROR, BLOCK}
        self.counter = 0

    # definitions

    def define(self, name: str, line: int) -> None:
        if name in self.defined:
            self.messages.append(Message("error", f"{name} is defined again or is a reserved name", line))
        self.defined.add(name)
        self.grammar.lines[name] = line

    def literal(self, text: str) -> str:
        if text not in self.literals:
            name = f"{AUTO_TOKEN}{len(self.literals)}"
            self.literals[text] = name
            self.grammar.terminals[name] = Terminal(name, text)
            self.defined.add(name)
        return self.literals[text]

    def terminal(self, name: str, rest: str, line: int) -> None:
        self.define(name, line)
        if rest.lstrip().startswith("%left"):
            c = _Cursor(_lexemes(rest, line), line)
            c.expect("%left")
            left = self.border(c)
            c.expect("%right")
            self.grammar.pairs[name] = Pair(name, frozenset(left), frozenset(self.border(c)))
            return
        pattern = rest.strip()
        at_start = pattern.startswith("%linestart")
        if at_start:
            pattern = pattern.removeprefix("%linestart").strip()
        if not pattern:
            self.messages.append(Message("error", f"{name} has no pattern", line))
        self.grammar.terminals[name] = Terminal(name, pattern, at_start)

    def border(self, c: _Cursor) -> list[str]:
        if c.take("("):
            found = self.border(c)
            while c.take("|"):
                found += self.border(c)
            c.expect(")")
            return found
        x = c.next()
        return [self.literal(x.text) if x.kind == "literal" else x.text]

    def rule(self, name: str, rest: str, line: int) -> None:
        self.define(name, line)
        if ANY not in rest and _PLAIN.fullmatch(rest):
            of = self.names.__getitem__
            self.grammar.rules[name] = Rule(name, [Alternative(name, tuple(map(of, part.split()))) for part in rest.split("|")], line=line)
            return
        c = _Cursor(_lexemes(rest, line), line)
        self.grammar.rules[name] = Rule(name, line=line)
        self.grammar.rules[name].alternatives = [Alternative(name, e, alias) for e, alias in self.body(c)]
        if c.peek():
            raise GrammarError(f"line {c.line}: unexpected {c.next().text}")

    def body(self, c: _Cursor) -> list[tuple[tuple[Entry, ...], str | None]]:
        out = []
        while True:
            entries = []
            while c.peek() and not c.peek("|", ")", "=>"):
                entries.append(self.entry(c))
            alias = c.next().text if c.take("=>") else None
            out.append((tuple(entries), alias))
            if not c.take("|"):
                return out

    def entry(self, c: _Cursor) -> Entry:
        options: list[tuple[str, tuple[str, ...]]] = []
        while c.kind() == "option":
            group, line = c.next().text[1:], c.line
            c.expect("(")
            names = []
            while not c.take(")"):
                if not c.take(","):
                    names.append(str(self.parameter(c)))
            if group not in ("parsing", "nodes"):
                self.messages.append(Message("error", f"options of group {group} cannot be local", line))
            elif unknown := [n for n in names if n not in OPTION_GROUPS[group]]:
                self.messages.append(Message("error", f"unknown local options {', '.join(unknown)}", line))
            options.append((group, tuple(names)))
        x = c.next()
        arguments: tuple[tuple[str, frozenset[str]], ...] = ()
        if x.kind == "literal":
            symbol = self.literal(x.text)
        elif x.text == "(":
            inner = self.body(c)
            c.expect(")")
            symbol = self.group(inner, x.line)
        elif x.kind == "name":
            symbol = x.text
            if symbol == ANY or symbol.startswith(ANY) and symbol[len(ANY) :] in ANY_ARGUMENTS:
                arguments, symbol = self.any_arguments(c, symbol[len(ANY) :]), ANY
        else:
            raise GrammarError(f"line {x.line}: unexpected {x.text}")
        if c.peek("?", "*", "+"):
            sign, greedy = c.next().text, c.take("!")
            if symbol == ANY:
                self.messages.append(Message("warning", f"{sign} after {ANY} is ignored: it may be empty and long as it is", x.line))
            else:
                return Entry(self.quantified(Entry(symbol, tuple(options), arguments), sign, greedy, x.line))
        return Entry(symbol, tuple(options), arguments)

    def any_arguments(self, c: _Cursor, suffix: str) -> tuple[tuple[str, frozenset[str]], ...]:
        """``AnyInclude('a', b)``: the names of one argument; ``Any(Include('a'), IgnorePairs)``: several arguments."""
        out: dict[str, frozenset[str]] = {suffix: frozenset()} if suffix else {}
        if c.peek("(") and c.lexemes[c.at].joined:  # with a blank between, a group follows
            c.next()
            while not c.take(")"):
                if c.take(","):
                    continue
                x = c.next()
                if suffix:
                    out[suffix] |= {self.literal(x.text) if x.kind == "literal" else x.text}
                    continue
                if x.text not in ANY_ARGUMENTS:
                    self.messages.append(Message("error", f"{ANY} has no argument {x.text}", x.line))
                names: set[str] = set()
                if c.take("("):
                    while not c.take(")"):
                        if not c.take(","):
                            y = c.next()
                            names.add(self.literal(y.text) if y.kind == "literal" else y.text)
                out[x.text] = frozenset(names)
        return tuple(out.items())

    def parameter(self, c: _Cursor):
        x = c.next()
        if x.kind == "number":
            return float(x.text) if "." in x.text else int(x.text)
        if x.kind in ("string", "literal"):
            return _unquoted(x.text)
        if x.kind == "name":
            if c.take("("):
                inner = []
                while not c.take(")"):
                    if not c.take(","):
                        inner.append(self.parameter(c))
                return {x.text: inner}
            return x.text
        raise GrammarError(f"line {x.line}: unexpected {x.text}")

    # generated rules

    def fresh(self, key: tuple, shown: str, greedy: bool, line: int) -> tuple[str, bool]:
        """A generated rule's name, and whether it is new; LR grammars share equal ones, to keep their states few."""
        if self.grammar.kind == "LR" and key in self.generated:
            return self.generated[key], False
        name = f"{AUTO_RULE}{self.counter}"
        self.counter += 1
        self.generated[key] = name
        self.grammar.rules[name] = Rule(name, shown=shown, greedy=greedy, line=line)
        self.defined.add(name)
        return name, True

    def group(self, inner: list[tuple[tuple[Entry, ...], str | None]], line: int) -> str:
        shown = "(" + " | ".join(" ".join(self.grammar.shown(e.symbol) for e in entries) or "ε" for entries, _ in inner) + ")"
        name, new = self.fresh(("group", tuple(inner)), shown, False, line)
        if new:
            self.grammar.rules[name].alternatives = [Alternative(name, e, alias) for e, alias in inner]
        return name

    def quantified(self, entry: Entry, sign: str, greedy: bool, line: int) -> str:
        name, new = self.fresh((sign, entry, greedy), self.grammar.shown(entry.symbol) + sign, greedy, line)
        if new:
            rest = entry if sign == "?" else None
            if sign == "?":
                bodies = [(rest,), ()]
            elif sign == "*":
                bodies = [(entry, Entry(name)) if self.grammar.kind == "LL" else (Entry(name), entry), ()]
            elif self.grammar.kind == "LL":
                bodies = [(entry, Entry(self.quantified(entry, "*", greedy, line)))]
            else:
                bodies = [(Entry(name), entry), (entry,)]
            self.grammar.rules[name].alternatives = [Alternative(name, b) for b in bodies]
        return name

    # options

    def options(self, text: str, line: int) -> None:
        lexemes = _lexemes(text, line)
        c = _Cursor(lexemes, line)
        while c.peek():
            x = c.next()
            if x.kind != "option":
                raise GrammarError(f"line {x.line}: expected an option group, found {x.text}")
            if c.take("{"):
                while not c.take("}"):
                    self.option(c, x.text[1:])
            else:
                self.option(c, x.text[1:])

    def option(self, c: _Cursor, group: str) -> None:
        x = c.next()
        parameters: list = []
        if c.peek("(") and c.lexemes[c.at].line == x.line:
            c.next()
            while not c.take(")"):
                if not c.take(","):
                    parameters.append(self.parameter(c))
        symbols = []
        while c.kind() in ("name", "literal") and c.lexemes[c.at].line == x.line:
            y = c.next()
            symbols.append(self.literals.get(y.text, y.text) if y.kind == "literal" else y.text)
        if group.lower() in OPTION_GROUPS and x.text.lower() not in OPTION_GROUPS[group.lower()]:
            self.messages.append(Message("error", f"group {group} has no option {x.text}", x.line))
        self.grammar.options.set(group, x.text, symbols, parameters)


def _without_comments(text: str) -> str:
    """Blanks comments that begin a line; those inside definitions are left to their readers."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(r"^[ \t]*(?://[^\n]*|/\*.*?\*/)", blank, text, flags=re.S | re.M)


def read_grammar(text: str, kind: str = "LL") -> tuple[Grammar, list[Message]]:
    """The grammar and what was noticed while reading it; texts that cannot be read raise ``GrammarError``."""
    if kind not in ("LL", "LR"):
        raise GrammarError(f"kind is LL or LR, not {kind}")
    text = _without_comments(text.replace("\r\n", "\n").replace("﻿", ""))
    head, mark, tail = text.partition("\n%%") if "\n%%" in text else ("", "%%", text[2:]) if text.startswith("%%") else (text, "", "")
    reader = _Reader(kind)
    lines, definitions = head.split("\n"), []
    for nr, line in enumerate(lines, 1):
        if m := _HEAD.match(line):
            name, sign = m.groups()
            definitions.append([name, sign, line[m.end() :], nr, 0])
        elif definitions:
            definitions[-1][4] += 1
        elif line.strip():
            raise GrammarError(f"line {nr}: expected a definition")
    # terminals first, so that rules may use those that follow
    for name, sign, rest, nr, more in definitions:
        if sign == ":":
            if more and any(r.strip() for r in lines[nr : nr + more]):
                raise GrammarError(f"line {nr}: a terminal's definition is one line")
            reader.terminal(name, rest, nr)
    for name, sign, rest, nr, more in definitions:
        if sign == "=":
            reader.rule(name, "\n".join([rest, *lines[nr : nr + more]]) if more else rest, nr)
    if mark:
        reader.options(re.sub(r"\A%*", lambda m: " " * len(m[0]), tail), head.count("\n") + 2)
    return reader.grammar, reader.messages
